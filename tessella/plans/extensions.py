"""Extensions beyond the reference's own operators: event-time windows and star joins over the driver's other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.common import rounded, sql_round
from tessella.session import table


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(e.select(F.col("w.start").alias("start"), "event_type", "n", "total"), 4)


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n")
    )
    return rounded(out, 2)


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    n, c, o, li = (table(spark, d, t) for t in ("nation", "customer", "orders", "lineitem"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rounded(joined.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count_distinct("o_orderkey").alias("orders")), 2)


QUERIES = {f.__name__: f for f in (event_windows, pricing_summary, nation_revenue)}
SQL = {
    "event_windows": f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {sql_round('sum(value)', 'total', 4)} FROM events GROUP BY ALL",
    "pricing_summary": f"""
        SELECT l_returnflag, l_linestatus, {sql_round('sum(l_quantity)', 'sum_qty', 2)}, {sql_round('sum(l_extendedprice * (1 - l_discount))', 'sum_price', 2)},
            {sql_round('avg(l_discount)', 'avg_disc', 2)}, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "nation_revenue": f"""
        SELECT n_name, {sql_round('sum(l_extendedprice * (1 - l_discount))', 'revenue', 2)}, count(DISTINCT o_orderkey) AS orders
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
