"""Two runs over the same tasks: results as run A, results_copy as run B."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import preview, remaining
from tessella.operators import compare
from tessella.operators.summary import report
from tessella.plans.common import rounded, sql_number, sql_round
from tessella.session import materialise, table


_SAME = ["response", "avg_entropy"]
_CLASS = [*_SAME, "num_tokens"]


def _pairs(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    return compare.pairs(table(spark, d, "results"), table(spark, d, "results_copy"), fields)


def run_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = compare.with_class(_pairs(spark, d, _CLASS))
    return rounded(p.select(*compare.KEY, "pair_class", "num_tokens_a", "num_tokens_b", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("avg_entropy_a", "avg_entropy_b")]))


def pair_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.class_counts(_pairs(spark, d, _CLASS)))


def paired_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.metric_stats(_pairs(spark, d, compare.METRICS)))


def response_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.response_agreement(_pairs(spark, d, ["response"])))


def entropy_by_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.entropy_by_agreement(_pairs(spark, d, _SAME)))


def ratio_of_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.ratio_of_means(_pairs(spark, d, _SAME)))


def diff_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.diff_percentiles(_pairs(spark, d, _CLASS)))


def class_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.class_summary(_pairs(spark, d, [*_CLASS, "avg_top_k_mass"])))


def token_differences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.token_differences(_pairs(spark, d, _CLASS)))


def _listed(rows: DataFrame) -> DataFrame:
    return rounded(rows.select(*compare.KEY, "entropy_a", "entropy_b", "diff", "num_tokens_a", "num_tokens_b"))


def worst_underestimates(spark: SparkSession, d: str) -> DataFrame:
    same = compare.with_entropy(_pairs(spark, d, _CLASS)).where("response_a <=> response_b")
    return _listed(compare.extremes(same, F.desc("diff"), 5))


def most_negative(spark: SparkSession, d: str) -> DataFrame:
    return _listed(compare.extremes(compare.anomalies(_pairs(spark, d, _CLASS)), F.asc("diff"), 5))


def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare.anomaly_counts(_pairs(spark, d, [*_CLASS, "think_end_position"]))


def different_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first three pairs, by key, of different answers, with the beginnings of prompt and answers.

    Three keys are found first, by hashes; only their texts are fetched.
    """
    p = compare.with_entropy(compare.with_class(_pairs(spark, d, [*_CLASS, "ordinal"]))).where("pair_class = 'different_response'")
    first = compare.extremes(p, F.asc("persona"), 3).select(*compare.KEY, "ordinal_a", "ordinal_b")
    shown = first
    for s, name in (("a", "results"), ("b", "results_copy")):
        texts = table(spark, d, name).select(F.col("ordinal").alias(f"ordinal_{s}"), F.col("response").alias(f"response_{s}"), F.col("prompt").alias(f"prompt_{s}"))
        shown = texts.join(F.broadcast(shown), f"ordinal_{s}")  # three rows
    parts = [F.substring(f"response_{s}", 1, 500).alias(f"shown_{s}") for s in "ab"] + [remaining(F.col(f"response_{s}"), 500).cast("bigint").alias(f"more_{s}") for s in "ab"]
    return shown.select(*compare.KEY, preview(F.col("prompt_a"), 100).alias("prompt"), *parts)


def entropy_histogram(spark: SparkSession, d: str) -> DataFrame:
    same = compare.with_entropy(_pairs(spark, d, _SAME)).where("response_a <=> response_b")
    return rounded(compare.histogram(same, "diff", 50))


def agreement_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Differences of identical and different answers in 60 bins of [-0.3, 0.3], in one pass."""
    p = compare.with_entropy(_pairs(spark, d, _SAME)).withColumn("identical", F.expr("response_a <=> response_b"))
    return rounded(compare.histogram(p, "diff", 60, -0.3, 0.3, by="identical"))


def report_of(paired: DataFrame) -> DataFrame:
    """(section, metric, value): what a printed report on two runs says, as a table."""
    parts = {"responses": compare.response_agreement(paired), "ratio of means": compare.ratio_of_means(paired), "tokens": compare.token_differences(paired), "anomalies": compare.anomaly_counts(paired)}
    return reduce(DataFrame.unionByName, [report(k, v) for k, v in parts.items()])


def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report_of(materialise(_pairs(spark, d, [*_CLASS, "think_end_position"]))))  # one join for all parts


_FIELDS = ", ".join(compare.FIELDS)
_SIDE = "SELECT persona, prompt_id, rep_idx, {f} FROM (SELECT *, row_number() OVER (PARTITION BY persona, prompt_id, rep_idx ORDER BY ordinal DESC) AS rn FROM {t} WHERE persona IS NOT NULL AND prompt_id IS NOT NULL AND rep_idx IS NOT NULL) WHERE rn = 1"
_P = (
    f"a AS ({_SIDE.format(f=_FIELDS, t='results')}), b AS ({_SIDE.format(f=_FIELDS, t='results_copy')}), "
    "p AS (SELECT a.persona, a.prompt_id, a.rep_idx, " + ", ".join(f"a.{f} AS {f}_a, b.{f} AS {f}_b" for f in compare.FIELDS) + " FROM a JOIN b USING (persona, prompt_id, rep_idx)), "
    "c AS (SELECT *, CASE WHEN response_a IS DISTINCT FROM response_b THEN 'different_response' WHEN num_tokens_a IS DISTINCT FROM num_tokens_b THEN 'same_text_diff_tokens' ELSE 'truly_identical' END AS pair_class, "
    f"{sql_number('avg_entropy_a')} AS entropy_a, {sql_number('avg_entropy_b')} AS entropy_b, {sql_number('avg_top_k_mass_b')} - {sql_number('avg_top_k_mass_a')} AS mass_diff FROM p), "
    "e AS (SELECT *, entropy_b - entropy_a AS diff, (entropy_b - entropy_a) / nullif(entropy_b, 0) * 100 AS rel FROM c WHERE entropy_a IS NOT NULL AND entropy_b IS NOT NULL)"
)
_CORR = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
_KEY = "persona, prompt_id, rep_idx"
_LIST = f"{_KEY}, {sql_round('entropy_a', 'entropy_a')}, {sql_round('entropy_b', 'entropy_b')}, {sql_round('diff', 'diff')}, num_tokens_a, num_tokens_b"
_POS, _NEG = ("avg(CASE WHEN diff {} 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100".format(s) for s in "><")


def _long() -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {sql_number(m + '_a')} AS a, {sql_number(m + '_b')} AS b FROM p" for m in compare.METRICS)


def _hist(src: str, bins: int, lo: str, hi: str, extra: str = "") -> str:
    """Bins by comparing with every edge."""
    edges = f"SELECT i AS bin, {lo} + i * (({hi} - {lo}) / {bins}.0::DOUBLE) AS lower, {lo} + (i + 1) * (({hi} - {lo}) / {bins}.0::DOUBLE) AS upper FROM range({bins}) AS r(i)"
    return f"SELECT CAST(bin AS INT) AS bin, {sql_round('any_value(lower)', 'lower')}, {sql_round('any_value(upper)', 'upper')}, count(x) AS n{extra} FROM ({edges}) g LEFT JOIN (SELECT diff AS x FROM {src}) v ON v.x >= g.lower AND (v.x < g.upper OR (g.bin = {bins - 1} AND v.x <= {hi})) GROUP BY bin"


QUERIES = {f.__name__: f for f in (
    run_pairs, pair_classes, paired_stats, response_agreement, entropy_by_agreement, ratio_of_means, diff_percentiles, class_summary, token_differences,
    worst_underestimates, most_negative, anomaly_counts, different_examples, entropy_histogram, agreement_histograms, comparison_report,
)}
SQL = {
    "run_pairs": f"WITH {_P} SELECT {_KEY}, pair_class, num_tokens_a, num_tokens_b, {sql_round('entropy_a', 'avg_entropy_a')}, {sql_round('entropy_b', 'avg_entropy_b')} FROM c",
    "pair_classes": f"""
        WITH {_P} SELECT pair_class, count(*) FILTER (entropy_a IS NOT NULL AND entropy_b IS NOT NULL) AS n, (SELECT count(*) FROM c) AS matched,
            {sql_round('count(*) FILTER (entropy_a IS NOT NULL AND entropy_b IS NOT NULL) * 100.0::DOUBLE / (SELECT count(*) FROM c)', 'percent')} FROM c GROUP BY pair_class""",
    "paired_stats": f"""
        WITH {_P}, l AS ({_long()}), d AS (SELECT *, b - a AS diff, (b - a) / nullif(b, 0) * 100 AS rel FROM l WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT metric, count(*) AS n, """ + ", ".join(f"{sql_round(f'avg({c})', f'mean_{c}')}, {sql_round(f'stddev_pop({c})', f'std_{c}')}" for c in ("a", "b", "diff", "rel")) + ", "
        + ", ".join(f"{sql_round(f'min({c})', f'min_{c}')}, {sql_round(f'max({c})', f'max_{c}')}" for c in ("diff", "rel")) + f", {sql_round(_CORR.format(x='a', y='b'), 'corr')} FROM d GROUP BY metric",
    "response_agreement": f"""
        WITH {_P}, s AS (SELECT response_a IS NOT DISTINCT FROM response_b AS same, length(response_b) - length(response_a) AS d FROM p)
        SELECT count(*) FILTER (same) AS identical, count(*) FILTER (NOT same) AS different, {sql_round('count(*) FILTER (same) * 100.0::DOUBLE / count(*)', 'identical_percent')},
            {sql_round('avg(d) FILTER (NOT same)', 'length_diff_mean')}, {sql_round('stddev_pop(d) FILTER (NOT same)', 'length_diff_std')} FROM s""",
    "entropy_by_agreement": f"""
        WITH {_P} SELECT response_a IS NOT DISTINCT FROM response_b AS identical, count(*) AS n, {sql_round('avg(diff)', 'mean')}, {sql_round('stddev_pop(diff)', 'std')},
            {sql_round('min(diff)', 'min')}, {sql_round('max(diff)', 'max')}, {sql_round(_POS, 'positive_percent')}, {sql_round(_NEG, 'negative_percent')} FROM e GROUP BY 1""",
    "ratio_of_means": f"""
        WITH {_P} SELECT count(*) AS n, {sql_round('avg(diff)', 'mean_diff')}, {sql_round('avg(nullif(entropy_b, 0))', 'mean_b')}, {sql_round('avg(diff) / avg(nullif(entropy_b, 0)) * 100', 'percent')}
        FROM e WHERE response_a IS NOT DISTINCT FROM response_b""",
    "diff_percentiles": f"WITH {_P}, q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS p) " + " UNION ALL ".join(
        f"SELECT pair_class, {p}::DOUBLE AS p, {sql_round(f'quantile_cont(diff, {p})', 'diff')}, {sql_round(f'quantile_cont(rel, {p})', 'rel')} FROM e GROUP BY pair_class" for p in (0.1, 0.25, 0.5, 0.75, 0.9)
    ),
    "class_summary": f"""
        WITH {_P} SELECT pair_class, count(*) AS n, {sql_round('avg(diff)', 'mean')}, {sql_round('stddev_pop(diff)', 'std')}, {sql_round('median(diff)', 'median')}, {sql_round('min(diff)', 'min')},
            {sql_round('max(diff)', 'max')}, {sql_round('max(diff) - min(diff)', 'range')}, {sql_round('stddev_pop(diff) / nullif(avg(diff), 0) * 100', 'cv_percent')},
            {sql_round(_POS, 'positive_percent')}, {sql_round(_NEG, 'negative_percent')}, {sql_round('avg(rel)', 'mean_rel')}, {sql_round('stddev_pop(rel)', 'std_rel')},
            {sql_round(_CORR.format(x='entropy_a', y='entropy_b'), 'corr')}, {sql_round('avg(mass_diff)', 'mass_mean')}, {sql_round('stddev_pop(mass_diff)', 'mass_std')} FROM e GROUP BY pair_class""",
    "token_differences": f"""
        WITH {_P}, t AS (SELECT num_tokens_a - num_tokens_b AS d FROM e WHERE pair_class = 'same_text_diff_tokens')
        SELECT count(*) AS n, {sql_round('avg(d)', 'mean')}, min(d) AS min, max(d) AS max, count(*) FILTER (d > 0) AS more, count(*) FILTER (d < 0) AS fewer FROM t""",
    "worst_underestimates": f"WITH {_P} SELECT {_LIST} FROM (SELECT * FROM e WHERE response_a IS NOT DISTINCT FROM response_b ORDER BY e.diff DESC, {_KEY} LIMIT 5)",
    "most_negative": f"WITH {_P} SELECT {_LIST} FROM (SELECT * FROM e WHERE response_a IS NOT DISTINCT FROM response_b AND diff < -0.001 ORDER BY e.diff, {_KEY} LIMIT 5)",
    "anomaly_counts": f"""
        WITH {_P} SELECT count(*) AS n, count(*) FILTER (num_tokens_a IS DISTINCT FROM num_tokens_b) AS token_count_differs, count(*) FILTER (num_tokens_a IS NOT DISTINCT FROM num_tokens_b) AS token_count_same,
            count(*) FILTER (think_end_position_a IS DISTINCT FROM think_end_position_b) AS think_position_differs FROM e WHERE response_a IS NOT DISTINCT FROM response_b AND diff < -0.001""",
    "different_examples": f"""
        WITH {_P} SELECT {_KEY}, CASE WHEN length(prompt_a) > 100 THEN substr(prompt_a, 1, 100) || '...' ELSE prompt_a END AS prompt, substr(response_a, 1, 500) AS shown_a, substr(response_b, 1, 500) AS shown_b,
            CAST(greatest(length(response_a) - 500, 0) AS BIGINT) AS more_a, CAST(greatest(length(response_b) - 500, 0) AS BIGINT) AS more_b FROM e WHERE pair_class = 'different_response' ORDER BY {_KEY} LIMIT 3""",
    "entropy_histogram": f"WITH {_P}, s AS (SELECT diff FROM e WHERE response_a IS NOT DISTINCT FROM response_b), r AS (SELECT min(diff) AS lo, max(diff) AS hi FROM s) " + _hist("s", 50, "(SELECT lo FROM r)", "(SELECT hi FROM r)"),
    "agreement_histograms": f"WITH {_P}, s AS (SELECT diff FROM e WHERE response_a IS NOT DISTINCT FROM response_b), t AS (SELECT diff FROM e WHERE response_a IS DISTINCT FROM response_b) "
        + _hist("s", 60, "-0.3::DOUBLE", "0.3::DOUBLE", ", true AS identical") + " UNION ALL " + _hist("t", 60, "-0.3::DOUBLE", "0.3::DOUBLE", ", false AS identical"),
}
_REPORTED = {
    "responses": ("response_agreement", "identical different identical_percent length_diff_mean length_diff_std"), "ratio of means": ("ratio_of_means", "n mean_diff mean_b percent"),
    "tokens": ("token_differences", "n mean min max more fewer"), "anomalies": ("anomaly_counts", "n token_count_differs token_count_same think_position_differs"),
}
SQL["comparison_report"] = " UNION ALL ".join(
    f"SELECT '{k}' AS section, m.metric, m.value FROM (SELECT unnest([{', '.join(f"{{'metric': '{c}', 'value': CAST({c} AS DOUBLE)}}" for c in cols.split())}]) AS m FROM ({SQL[q]}))" for k, (q, cols) in _REPORTED.items()
)
