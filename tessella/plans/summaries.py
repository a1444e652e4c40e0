"""Tables and charts of the two dashboards, over results and embedding_variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.stats import number
from tessella.functions.text import format_pvalue, preview
from tessella.operators import summary, variance
from tessella.plans.common import rounded, sql_number, sql_round
from tessella.session import table

ENTROPY = ["avg_entropy_thinking", "avg_entropy_output", "avg_entropy"]
MASS = ["avg_top_k_mass_thinking", "avg_top_k_mass_output", "avg_top_k_mass"]
CATEGORIES = ["beast", "scholar"]


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results")


def _variance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_variance")


def melt_metrics(spark: SparkSession, d: str) -> DataFrame:
    long = summary.melt_metrics(_results(spark, d), "avg_entropy", ["ordinal", "category", "persona", "prompt_id"])
    return rounded(long.withColumn("value", number("value")))


def entropy_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.group_summary(_results(spark, d), "category", ENTROPY)


def mass_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.group_summary(_results(spark, d), "category", MASS)


def thinking_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.group_summary(_results(spark, d), "category", ["think_end_position"], digits=2, extremes=True)


def drill_down_summary(spark: SparkSession, d: str) -> DataFrame:
    rows, group = summary.drill_down(_results(spark, d), "scholar")
    return summary.group_summary(rows, group, ENTROPY)


def category_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = summary.category_filter(_results(spark, d), CATEGORIES)
    return kept.select("ordinal", "category", "persona", "prompt_id", "think_end_position")


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    long = summary.melt_metrics(_results(spark, d), "avg_entropy", ["category"])
    return rounded(summary.box_stats(long, ["category", "section"], "value"))


def mass_box_stats(spark: SparkSession, d: str) -> DataFrame:
    long = summary.melt_metrics(_results(spark, d), "avg_top_k_mass", ["category"])
    return rounded(summary.box_stats(long, ["category", "section"], "value"))


def thinking_box_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.box_stats(_results(spark, d), ["category"], "think_end_position"))


def violin_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary.density(_results(spark, d), "category", "avg_entropy"))


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = summary.correlation_matrix(_results(spark, d), ["avg_entropy", "avg_top_k_mass", "think_end_position"])
    return rounded(m.select("x", "y", "n", "r"))


def correlation_pvalues(spark: SparkSession, d: str) -> DataFrame:
    m = summary.correlation_matrix(_results(spark, d), ["avg_entropy", "avg_top_k_mass", "think_end_position"])
    return m.select("x", "y", "n", F.bround("r", 3).cast("string").alias("r"), format_pvalue(F.col("p")).alias("p"))


def dataset_info(spark: SparkSession, d: str) -> DataFrame:
    return summary.dataset_info(_results(spark, d), ["category", "persona", "prompt_id"])


def category_list(spark: SparkSession, d: str) -> DataFrame:
    return summary.distinct_sorted(_results(spark, d), "category")


def variance_info(spark: SparkSession, d: str) -> DataFrame:
    return summary.dataset_info(_variance(spark, d), ["persona", "prompt_id", "embedding_column"])


def variance_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Three filters: one embedding column, two categories, and the first twenty personae by name."""
    names = [r.persona for r in table(spark, d, "personae").select("persona").orderBy("persona").limit(20).collect()]
    kept = summary.chosen(_variance(spark, d), {"embedding_column": ["embedding_response1_full"], "category": CATEGORIES, "persona": names})
    return rounded(kept.select("prompt_id", "persona", "category", number("total_variance").alias("total_variance"), "n_samples"))


def variance_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of one prompt (here the one with the least id): its personae by descending variance, with their places."""
    v = _variance(spark, d).where("embedding_column = 'embedding_response1_full'")
    first = v.agg(F.min("prompt_id").alias("prompt_id"))
    one = v.join(F.broadcast(first), "prompt_id").select("prompt_id", "persona", "category", number("total_variance").alias("total_variance")).dropna(subset=["persona", "total_variance"])
    # equal bars come in order of persona and category; wholly equal rows are alike
    return rounded(summary.places(one, ["prompt_id"], [F.desc("total_variance"), F.asc("persona"), F.asc("category")], "place"))


def prompt_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation and extremes of the variance by prompt and embedding column."""
    v = number("total_variance")
    stats = _variance(spark, d).where("prompt_id is not null").groupBy("prompt_id", "embedding_column")
    return rounded(stats.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")))


def prompt_titles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct prompts with a title: the question, cut at 80 characters, or the id."""
    q = _variance(spark, d).where("prompt_id is not null").select("prompt_id", "question").distinct()
    return q.select("prompt_id", F.coalesce(preview(F.col("question"), 80), F.concat(F.lit("Prompt "), F.col("prompt_id").cast("string"))).alias("title")).orderBy("prompt_id", "title")


def prompts_with_data(spark: SparkSession, d: str) -> DataFrame:
    has = _variance(spark, d).where("embedding_column = 'embedding_response1_full'")
    return table(spark, d, "prompts").join(has.select(F.col("prompt_id").alias("id")), "id", "left_semi").select("id", "question")


def variance_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ends of each prompt and column's ranking: personas with the highest and lowest variance. All ranks: variance_ranks."""
    v = _variance(spark, d).select("prompt_id", "embedding_column", "persona", number("total_variance").alias("v")).dropna()
    best = v.groupBy("prompt_id", "embedding_column").agg(F.max(F.struct("v", "persona")).alias("top"), F.min(F.struct("v", "persona")).alias("low"), F.count("*").alias("n"))
    return rounded(best.select("prompt_id", "embedding_column", "n", F.col("top.v").alias("highest"), F.col("low.v").alias("lowest"), F.col("top.persona").alias("highest_persona"), F.col("low.persona").alias("lowest_persona")))


def variance_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every persona of each prompt and column by descending variance, for a chart: ranks instead of an order, as a table keeps none."""
    v = _variance(spark, d).select("prompt_id", "embedding_column", "persona", number("total_variance").alias("total_variance")).dropna()
    ranked = summary.places(v, ["prompt_id", "embedding_column"], [F.desc("total_variance"), F.asc("persona")], "rank_no")
    return rounded(ranked.select("prompt_id", "embedding_column", "persona", "total_variance", "rank_no"))


def variance_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = _variance(spark, d).where("embedding_column = 'embedding_response2_full'").withColumn("total_variance", number("total_variance"))
    by = [F.asc("prompt_id"), F.desc("total_variance"), F.asc("persona")]
    return rounded(summary.ranked(rows, ["prompt_id", "persona", "total_variance", "n_samples"], by))


def variance_records(spark: SparkSession, d: str) -> DataFrame:
    """Variance of the embeddings by label and parity, with a looked-up name; labels from 7 on are not in the lookup."""
    e = table(spark, d, "embeddings").withColumns({"prompt_id": F.col("label").cast("bigint"), "embedding_all": F.col("embedding")})
    look = spark.range(7).select(F.col("id").alias("prompt_id"), F.concat(F.lit("group "), F.col("id").cast("string")).alias("category"), F.col("id").alias("ordinal"))
    columns = variance.embedding_columns(e)
    return rounded(variance.variance_records(e, ["prompt_id"], columns, {"prompt_id": (look, "category", "unknown")}))


def variance_by_persona(spark: SparkSession, d: str) -> DataFrame:
    """Variance records of two-turn rows by prompt and persona over two embedding columns, with question and category.

    Rows get vectors of the embeddings table by their ordinals. Prompts above 30 are not in the questions' lookup: null there.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("v"), "embedding")
    n = e.agg(F.count("*").alias("n"))
    rows = table(spark, d, "consistency_results").select("prompt_id", "persona", "ordinal").crossJoin(F.broadcast(n))  # one row
    for i, step in ((1, 1), (2, 7)):
        rows = rows.withColumn("v", F.col("ordinal") * step % F.col("n")).join(e.withColumnRenamed("embedding", f"embedding_response{i}_full"), "v").drop("v")
    asked = table(spark, d, "consistency_prompts").where("id <= 30").select(F.col("id").alias("prompt_id"), "question", F.lit(0).alias("ordinal"))
    known = table(spark, d, "personae").select("persona", "category", F.lit(0).alias("ordinal"))
    records = variance.variance_records(rows.drop("ordinal", "n"), ["prompt_id", "persona"], variance.embedding_columns(rows), {"persona": (known, "category", "unknown"), "prompt_id": (asked, "question", None)})
    return rounded(records)


def _group_sql(cols: list[str], group: str = "category", digits: int = 4, where: str = "", extremes: bool = False) -> str:
    parts = []
    for c in cols:
        x = f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END"
        stats = [("mean", f"avg({x})"), ("std", f"stddev_samp({x})"), ("median", f"median({x})")] + ([("min", f"min({x})"), ("max", f"max({x})")] if extremes else [])
        parts += [f"round_even({e}, {digits}) AS {c}_{k}" for k, e in stats]
    return f"SELECT {group}, {', '.join(parts)} FROM results WHERE {group} IS NOT NULL {where} GROUP BY {group}"


def _melt(metric: str, ids: str) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{label}' AS section, {sql_number(metric + k)} AS value FROM results" for k, label in summary.LABELS.items())


def _box(rows: str, keys: str) -> str:
    same = " AND ".join(f"v.{k} IS NOT DISTINCT FROM q.{k}" for k in keys.split(", "))
    return f"""
        WITH v AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL),
        q AS (SELECT {keys}, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL),
        f AS (SELECT q.*, v.value, v.value >= q1 - 1.5 * (q3 - q1) AND v.value <= q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q ON {same})
        SELECT {keys}, n, {sql_round('mean', 'mean')}, {sql_round('q1', 'q1')}, {sql_round('median', 'median')}, {sql_round('q3', 'q3')},
            {sql_round('min(value) FILTER (inside)', 'whisker_low')}, {sql_round('max(value) FILTER (inside)', 'whisker_high')}, count(*) FILTER (NOT inside) AS outliers
        FROM f GROUP BY {keys}, n, mean, q1, median, q3"""


_CORR_COLS = ["avg_entropy", "avg_top_k_mass", "think_end_position"]


def _corr_cell(a: str, b: str) -> str:
    x, y = (f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END" for c in (a, b))
    n = f"count(*) FILTER (({x}) IS NOT NULL AND ({y}) IS NOT NULL)"
    r = "1.0::DOUBLE" if a == b else f"corr({x}, {y})"
    return f"SELECT '{a}' AS x, '{b}' AS y, {n} AS n, {sql_round(r, 'r')} FROM results"


QUERIES = {f.__name__: f for f in (
    melt_metrics, entropy_summary, mass_summary, thinking_summary, drill_down_summary, category_filter, box_stats, mass_box_stats, thinking_box_stats, violin_density, correlation_matrix, correlation_pvalues,
    dataset_info, category_list, variance_info, variance_filtered, prompt_stats, prompt_titles, prompts_with_data, variance_ranking, variance_ranks, variance_bars, variance_sorted, variance_records, variance_by_persona,
)}
_IN = "category IN ('beast', 'scholar')"
SQL = {
    "melt_metrics": f"SELECT ordinal, category, persona, prompt_id, section, {sql_round('value', 'value')} FROM ({_melt('avg_entropy', 'ordinal, category, persona, prompt_id')})",
    "entropy_summary": _group_sql(ENTROPY),
    "mass_summary": _group_sql(MASS),
    "thinking_summary": _group_sql(["think_end_position"], digits=2, extremes=True),
    "drill_down_summary": _group_sql(ENTROPY, "persona", where="AND category = 'scholar'"),
    "category_filter": f"SELECT ordinal, category, persona, prompt_id, think_end_position FROM results WHERE {_IN}",
    "box_stats": _box(f"SELECT * FROM ({_melt('avg_entropy', 'category')})", "category, section"),
    "mass_box_stats": _box(f"SELECT * FROM ({_melt('avg_top_k_mass', 'category')})", "category, section"),
    "thinking_box_stats": _box("SELECT category, think_end_position::DOUBLE AS value FROM results", "category"),
    "violin_density": f"""
        WITH x AS (SELECT category AS g, avg_entropy AS x FROM results WHERE category IS NOT NULL AND avg_entropy IS NOT NULL AND NOT isnan(avg_entropy)),
        s AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM x GROUP BY g HAVING max(x) > min(x)),
        c AS (SELECT g, lo, hi, h, n, least(floor((x - lo) / (hi - lo) * 400), 399) AS cell, count(*) AS c FROM x JOIN s USING (g) GROUP BY ALL),
        m AS (SELECT *, lo + (cell + 0.5) * (hi - lo) / 400 AS mid FROM c), k AS (SELECT *, lo + i * (hi - lo) / 49.0::DOUBLE AS place FROM m, range(50) AS r(i))
        SELECT g AS category, {sql_round('place', '"at"')}, {sql_round('sum(c * exp(-0.5 * pow((place - mid) / h, 2)) / (h * 2.5066282746310002)) / any_value(n)', 'density')} FROM k GROUP BY g, place""",
    "correlation_matrix": " UNION ALL ".join(_corr_cell(a, b) for a in _CORR_COLS for b in _CORR_COLS),
    "dataset_info": "SELECT count(*) AS total, count(DISTINCT category) AS distinct_category, count(DISTINCT persona) AS distinct_persona, count(DISTINCT prompt_id) AS distinct_prompt_id FROM results",
    "category_list": "SELECT DISTINCT category FROM results WHERE category IS NOT NULL ORDER BY 1",
    "variance_info": "SELECT count(*) AS total, count(DISTINCT persona) AS distinct_persona, count(DISTINCT prompt_id) AS distinct_prompt_id, count(DISTINCT embedding_column) AS distinct_embedding_column FROM embedding_variance",
    "variance_filtered": f"SELECT prompt_id, persona, category, {sql_round(sql_number('total_variance'), 'total_variance')}, n_samples FROM embedding_variance WHERE embedding_column = 'embedding_response1_full' AND {_IN} AND persona IN (SELECT persona FROM personae ORDER BY persona LIMIT 20)",
    "prompt_stats": f"""
        WITH v AS (SELECT prompt_id, embedding_column, {sql_number('total_variance')} AS v FROM embedding_variance WHERE prompt_id IS NOT NULL)
        SELECT prompt_id, embedding_column, count(v) AS n, {sql_round('avg(v)', 'mean')}, {sql_round('stddev_samp(v)', 'std')}, {sql_round('min(v)', 'min')}, {sql_round('max(v)', 'max')} FROM v GROUP BY ALL""",
    "prompt_titles": """
        SELECT DISTINCT prompt_id, title FROM (SELECT prompt_id, coalesce(CASE WHEN length(question) > 80 THEN substr(question, 1, 80) || '...' ELSE question END, 'Prompt ' || prompt_id) AS title
            FROM (SELECT DISTINCT prompt_id, question FROM embedding_variance WHERE prompt_id IS NOT NULL))""",
    "prompts_with_data": "SELECT id, question FROM prompts WHERE id IN (SELECT prompt_id FROM embedding_variance WHERE embedding_column = 'embedding_response1_full')",
    "variance_ranking": f"""
        WITH v AS (SELECT prompt_id, embedding_column, persona, {sql_number('total_variance')} AS v FROM embedding_variance),
        r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, embedding_column ORDER BY v DESC, persona DESC) AS a, row_number() OVER (PARTITION BY prompt_id, embedding_column ORDER BY v, persona) AS b
            FROM v WHERE prompt_id IS NOT NULL AND embedding_column IS NOT NULL AND persona IS NOT NULL AND v IS NOT NULL)
        SELECT prompt_id, embedding_column, count(*) AS n, {sql_round('max(v)', 'highest')}, {sql_round('min(v)', 'lowest')}, max(persona) FILTER (a = 1) AS highest_persona, max(persona) FILTER (b = 1) AS lowest_persona FROM r GROUP BY ALL""",
    "variance_ranks": f"""
        WITH v AS (SELECT prompt_id, embedding_column, persona, {sql_number('total_variance')} AS v FROM embedding_variance)
        SELECT prompt_id, embedding_column, persona, {sql_round('v', 'total_variance')}, row_number() OVER (PARTITION BY prompt_id, embedding_column ORDER BY v DESC, persona) AS rank_no
        FROM v WHERE prompt_id IS NOT NULL AND embedding_column IS NOT NULL AND persona IS NOT NULL AND v IS NOT NULL""",
    "variance_bars": f"""
        WITH v AS (SELECT prompt_id, persona, category, {sql_number('total_variance')} AS v FROM embedding_variance WHERE embedding_column = 'embedding_response1_full'),
        o AS (SELECT * FROM v WHERE prompt_id = (SELECT min(prompt_id) FROM v) AND persona IS NOT NULL AND v IS NOT NULL)
        SELECT prompt_id, persona, category, {sql_round('v', 'total_variance')}, row_number() OVER (ORDER BY v DESC, persona, category NULLS FIRST) AS place FROM o""",
    "variance_by_persona": f"""
        WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT prompt_id, persona, ordinal % n AS v1, ordinal * 7 % n AS v2 FROM consistency_results, n),
        l AS (SELECT prompt_id, persona, 'embedding_response1_full' AS c, embedding FROM r JOIN embeddings ON vec_id = v1 UNION ALL SELECT prompt_id, persona, 'embedding_response2_full', embedding FROM r JOIN embeddings ON vec_id = v2),
        x AS (SELECT prompt_id, persona, c, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM l WHERE prompt_id IS NOT NULL AND persona IS NOT NULL),
        v AS (SELECT prompt_id, persona, c, d, var_samp(v) AS s, count(*) AS n FROM x GROUP BY ALL)
        SELECT prompt_id, persona, c AS embedding_column, {sql_round('sum(s)', 'total_variance')}, max(n) AS n_samples, (SELECT coalesce(max(category), 'unknown') FROM personae p WHERE p.persona = v.persona) AS category,
            (SELECT max(question) FROM consistency_prompts q WHERE q.id = v.prompt_id AND q.id <= 30) AS question FROM v GROUP BY prompt_id, persona, c""",
    "variance_sorted": f"SELECT prompt_id, persona, {sql_round(sql_number('total_variance'), 'total_variance')}, n_samples FROM embedding_variance WHERE embedding_column = 'embedding_response2_full'",
    "variance_records": f"""
        WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings), v AS (SELECT label, d, var_samp(v) AS s, count(*) AS n FROM x GROUP BY label, d)
        SELECT label::BIGINT AS prompt_id, 'embedding_all' AS embedding_column, {sql_round('sum(s)', 'total_variance')}, max(n) AS n_samples, CASE WHEN label < 7 THEN 'group ' || label ELSE 'unknown' END AS category FROM v GROUP BY label""",
}
