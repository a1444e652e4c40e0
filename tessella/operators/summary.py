"""Aggregates behind charts and tables: group summaries, box statistics, correlations, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import number, pearson, pvalue
from tessella.operators.ranks import exact_percentiles
from tessella.session import materialise, ship

# Labels of the metrics in charts.
LABELS = {"_thinking": "Thinking", "_output": "Output", "": "Overall"}


def category_filter(df: DataFrame, categories: list[str], column: str = "category") -> DataFrame:
    """Rows of the chosen categories; no choice means no filter."""
    return df.where(F.col(column).isin(categories)) if categories else df


def chosen(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Rows whose columns have one of the values chosen for each; an empty choice is none. Null is never chosen."""
    for column, values in choices.items():
        df = category_filter(df, values, column)
    return df


def report(section: str, df: DataFrame) -> DataFrame:
    """(section, metric, value) of a one-row table of numbers: its columns as lines."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value").select(F.lit(section).alias("section"), "metric", "value")


def drill_down(df: DataFrame, category: str | None) -> tuple[DataFrame, str]:
    """One category's rows grouped by persona, or all rows grouped by category."""
    return (df, "category") if category is None else (df.where(F.col("category") == category), "persona")


def melt_metrics(df: DataFrame, metric: str, ids: list[str]) -> DataFrame:
    """(ids..., section, value): a metric's three columns as rows, labelled; missing values stay."""
    names = {f"{metric}{k}": v for k, v in LABELS.items()}
    long = df.select(*ids, *names).unpivot(ids, list(names), "metric", "value")
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return long.select(*ids, label[F.col("metric")].alias("section"), "value")


def group_summary(df: DataFrame, group: str, columns: list[str], digits: int = 4, extremes: bool = False) -> DataFrame:
    """Mean, sample deviation and median (and extremes) of each column by group, rounded half to even; null groups are left out.

    Medians are exact, by counting.
    """
    rows = df.where(F.col(group).isNotNull())
    aggs, shown = [], []
    for c in columns:
        x = number(c)
        stats = [("mean", F.avg(x)), ("std", F.stddev_samp(x))] + ([("min", F.min(x)), ("max", F.max(x))] if extremes else [])
        aggs += [v.alias(f"{c}_{k}") for k, v in stats]
        shown += [F.bround(f"{c}_{k}", digits).alias(f"{c}_{k}") for k, _ in stats] + [F.bround(f"m.{c}_median", digits).alias(f"{c}_median")]
    long = rows.select(F.col(group).alias("g"), F.explode(F.array(*[F.struct(F.lit(c).alias("c"), number(c).alias("x")) for c in columns])).alias("v")).select("g", "v.c", "v.x")
    medians = exact_percentiles(long, ["g", "c"], "x", (0.5,)).groupBy("g").pivot("c", columns).agg(F.first(F.get("q", F.lit(0))))
    medians = medians.select(F.col("g").alias("_key"), *[F.col(f"`{c}`").alias(f"{c}_median") for c in columns])
    stats = rows.groupBy(group).agg(*aggs)
    return stats.join(medians.alias("m"), F.col(group) == F.col("m._key"), "left").select(group, *shown)


def box_stats(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles, mean and the whiskers (the outermost values within 1.5 interquartile ranges) by group.

    Quartiles are exact and interpolated, found by counting. The whiskers take a second pass over the values, joined with
    their fences.
    """
    rows = df.select(*groups, number(value).alias("x")).where("x is not null")
    q = exact_percentiles(rows, groups, "x", (0.25, 0.5, 0.75))
    fences = q.select(*groups, "n", *[F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    fences = fences.withColumns({"lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    same = " and ".join(f"r.`{g}` <=> f.`{g}`" for g in groups)
    joined = rows.alias("r").join(fences.alias("f"), F.expr(same)).select("r.x", "f.*")
    inside = F.when((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")), F.col("x"))
    return joined.groupBy(*groups, "n", "q1", "median", "q3").agg(
        F.avg("x").alias("mean"), F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"), F.count_if(inside.isNull()).alias("outliers")
    )


def density(df: DataFrame, group: str, value: str, points: int = 50) -> DataFrame:
    """(group, at, density): Gaussian kernel density on an even grid over each group's range, bandwidth by Scott's rule.

    Values are first counted on a grid eight times as fine, so the kernel sum is over cells, not over pairs of rows.
    """
    x = df.select(F.col(group).alias("g"), number(value).alias("x")).where("x is not null and g is not null")
    s = x.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n")).where("hi > lo")
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    fine = 8 * points
    cell = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * fine), F.lit(fine - 1))
    cells = x.join(s, "g").groupBy("g", "lo", "hi", "h", "n", cell.alias("cell")).agg(F.count("*").alias("c"))
    mid = F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / fine
    grid = cells.withColumn("mid", mid).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    k = F.exp(-0.5 * F.pow((at - F.col("mid")) / F.col("h"), 2)) / (F.col("h") * 2.5066282746310002)
    return grid.groupBy(F.col("g").alias(group), at.alias("at")).agg((F.sum(k * F.col("c")) / F.first("n")).alias("density"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, n, r, p) for all pairs of columns over the rows that have both; 1 and 0 on the diagonal; null for n < 3.

    All coefficients come from one pass; only the finished rows go through the p-value function.
    """
    ship(df.sparkSession)
    aggs = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            x, y = number(a), number(b)
            both = x.isNotNull() & y.isNotNull()
            aggs += [F.count_if(both).alias(f"n{i}_{j}"), (F.lit(1.0) if i == j else pearson(x, y)).alias(f"r{i}_{j}")]
    one = df.agg(*aggs)
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}_{j}").alias("n"), F.when((F.col(f"n{i}_{j}") > 2) | F.lit(i == j), F.col(f"r{i}_{j}")).alias("r"))
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    long = one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.withColumn("p", F.when(F.col("x") == F.col("y"), F.lit(0.0)).otherwise(pvalue(F.col("r"), F.col("n"))))


def dataset_info(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and of distinct values in each column, nulls not counted."""
    return df.agg(F.count("*").alias("total"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def ranked(df: DataFrame, columns: list[str], by: list[Column]) -> DataFrame:
    return df.select(*columns).orderBy(*by)


def places(df: DataFrame, groups: list[str], by: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 1, in its group by an order. Rows with a null group are left out.

    The table is sorted in ranges, so a hot group is spread over tasks. A row's place is its place in its range, less the
    group's first there, plus the group's rows in earlier ranges; these counts are a row per group and range.
    """
    keep = df.dropna(subset=groups).repartitionByRange(*[F.asc(g) for g in groups], *by).sortWithinPartitions(*[F.asc(g) for g in groups], *by)
    at = F.monotonically_increasing_id()
    ranges = materialise(keep.withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = ranges.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = ranges.join(starts, [*groups, "_range"])
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_range", "_at", "_first", "_before")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
