from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.stats import pearson, pearson_pvalue
from tessella.operators import compare, summary

FIELDS = "prompt string, response string, avg_entropy double, avg_entropy_thinking double, avg_entropy_output double, avg_top_k_mass double, avg_top_k_mass_thinking double, avg_top_k_mass_output double, num_tokens long, think_end_position long"
SCHEMA = f"ordinal long, persona string, prompt_id long, rep_idx long, {FIELDS}"


def line(n, persona, response="r", e=1.0, m=0.9, tokens=5, think=None):
    return (n, persona, 1, 0, "p", response, e, None, e, m, None, m, tokens, think)


@pytest.fixture(scope="module")
def paired(spark):
    a = [line(0, "dup", e=9.0), line(1, "dup", e=1.0), line(2, "text", "x", e=1.0), line(3, "tok", e=0.5, tokens=7, think=3), line(4, "nul", e=None), line(5, "onlya"), line(6, None), line(7, "zero", e=0.2)]
    b = [line(0, "dup", e=1.2), line(1, "text", "y", e=2.0), line(2, "tok", e=0.4, tokens=5), line(3, "nul", e=1.0), line(4, "onlyb"), line(5, "zero", e=0.0)]
    return compare.pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), compare.FIELDS).cache()


def test_pairs_take_the_last_line(paired):
    rows = {r.persona: r for r in paired.collect()}
    assert set(rows) == {"dup", "text", "tok", "nul", "zero"}
    assert rows["dup"].avg_entropy_a == 1.0


def test_class_counts(paired):
    got = {r.pair_class: (r.n, r.matched) for r in compare.class_counts(paired).collect()}
    assert got == {"truly_identical": (2, 5), "same_text_diff_tokens": (1, 5), "different_response": (1, 5)}


def test_metric_stats(paired):
    r = {x.metric: x for x in compare.metric_stats(paired).collect()}["avg_entropy"]
    a, b = np.array([1.0, 1.0, 0.5, 0.2]), np.array([1.2, 2.0, 0.4, 0.0])
    assert r.n == 4
    assert r.std_diff == pytest.approx((b - a).std())
    rel = ((b - a)[b != 0] / b[b != 0]) * 100  # a zero in b has no ratio
    assert r.mean_rel == pytest.approx(rel.mean())
    assert r.corr == pytest.approx(np.corrcoef(a, b)[0, 1])
    mass = {x.metric: x for x in compare.metric_stats(paired).collect()}["avg_top_k_mass"]
    assert mass.corr is None  # constant columns


def test_ratio_of_means_leaves_zeros_out(paired):
    r = compare.ratio_of_means(paired).first()
    assert r.n == 3 and r.mean_b == pytest.approx(0.8)


def test_anomalies(paired):
    r = compare.anomaly_counts(paired).first()
    assert tuple(r) == (2, 1, 1, 1)
    first = compare.extremes(compare.anomalies(paired), F.asc("diff"), 1).first()
    assert first.persona == "zero"


def test_percentiles_interpolate(spark, paired):
    rows = compare.diff_percentiles(paired, (0.5,)).where("pair_class = 'truly_identical'").collect()
    assert rows[0].diff == pytest.approx((0.2 - 0.2) / 2)


def test_histogram_edges(spark):
    xs = [-0.3, 0.3, 0.0, 0.1, 0.3000001, None, float("nan")]
    got = {r.bin: r.n for r in compare.histogram(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 6, -0.3, 0.3).collect()}
    want, edges = np.histogram([-0.3, 0.3, 0.0, 0.1], bins=6, range=(-0.3, 0.3))
    assert [got[i] for i in range(6)] == want.tolist()
    one = compare.histogram(spark.createDataFrame([(2.0,)], "x double"), "x", 4).collect()
    assert (min(r.lower for r in one), max(r.upper for r in one), sum(r.n for r in one)) == (1.5, 2.5, 1)
    assert compare.histogram(spark.createDataFrame([], "x double"), "x", 4).count() == 0


@pytest.mark.parametrize(("r", "n", "p"), [(0.5, 3, 0.6666666667), (0.5, 10, 0.1411132813), (-0.3, 50, 0.03428618003), (0.9, 20, 6.574284544e-08), (0.1, 1000, 0.001544116107)])
def test_pvalues(r, n, p):
    assert pearson_pvalue(r, n) == pytest.approx(p, rel=1e-8)
    assert pearson_pvalue(None, n) is None and pearson_pvalue(r, 2) is None and pearson_pvalue(1.0, n) == 0.0


def test_pearson_of_one_pair_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.select(pearson(F.col("x"), F.col("y")).alias("r")).first().r is None
    assert df.limit(1).agg(pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_correlation_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 1.0), (3.0, 5.0, 2.0), (4.0, 4.0, None)], "a double, b double, c double")
    got = {(r.x, r.y): r for r in summary.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "a"].r == 1.0 and got["a", "a"].p == 0.0
    assert got["a", "b"].r == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 5, 4])[0, 1])
    assert got["a", "c"].n == 2 and got["a", "c"].r is None


def test_summary_rounds_half_even_and_keeps_groups(spark):
    df = spark.createDataFrame([("a", 0.00005), ("a", 0.00005), ("b", None), (None, 1.0)], "g string, x double")
    got = {r.g: r for r in summary.group_summary(df, "g", ["x"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].x_mean == 0.0 and got["b"].x_mean is None


def test_melt_keeps_missing(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3.0)], "i int, m_thinking double, m_output double, m double")
    got = {r.section: r.value for r in summary.melt_metrics(df, "m", ["i"]).collect()}
    assert got == {"Thinking": None, "Output": 2.0, "Overall": 3.0}


def test_box_whiskers(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    r = summary.box_stats(spark.createDataFrame([(None, x) for x in xs], "g string, x double"), ["g"], "x").first()
    assert (r.n, r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_filters(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q")], "category string, persona string")
    assert summary.category_filter(df, []).count() == 2 and summary.category_filter(df, ["a"]).count() == 1
    assert summary.drill_down(df, None)[1] == "category" and summary.drill_down(df, "b")[1] == "persona"
