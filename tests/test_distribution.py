from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import distribution as dist

vectors = st.lists(st.floats(-30, 30), min_size=1, max_size=12)


def reference(x, k):
    x = np.array(x, float)
    lp = x - x.max() - np.log(np.exp(x - x.max()).sum())
    p = np.exp(lp)
    return -(p * lp).sum(), np.sort(p)[::-1][:k].sum(), lp


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(vectors, min_size=1, max_size=6), st.integers(1, 15))
def test_entropy_and_mass(spark, rows, k):
    df = dist.with_distribution(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>"), "x")
    top = dist.largest(F.col("lp"), k)
    got = df.select("i", dist.entropy(F.col("p"), F.col("lp")).alias("e"), dist.top_k_mass(F.col("p"), k).alias("m"), dist.entropy_of_logprobs(top).alias("t"), dist.top_k_mass_of_logprobs(top, k).alias("tm"))
    for r in got.collect():
        e, m, _ = reference(rows[r.i], k)
        assert r.e == pytest.approx(e, abs=1e-9)
        assert r.m == pytest.approx(m, abs=1e-9)
        assert r.t <= r.e + 1e-9  # the truncated entropy is a lower bound
        assert r.tm == pytest.approx(m, abs=1e-9)  # truncation to k leaves the mass of k
        assert -1e-12 <= r.e <= math.log(len(rows[r.i])) + 1e-9


def test_edges(spark):
    df = spark.createDataFrame([([],), (None,), ([float("-inf"), 0.0],)], "x array<double>")
    got = df.select(dist.entropy_of_logprobs(F.col("x")).alias("e"), dist.top_k_mass_of_logprobs(F.col("x"), 3).alias("m"), dist.entropy_of_logprobs(dist.finite_only(F.col("x"))).alias("f")).collect()
    assert (got[0].e, got[0].m) == (0.0, 0.0)
    assert (got[1].e, got[1].m) == (0.0, 0.0)
    assert math.isnan(got[2].e) and got[2].f == 0.0 and got[2].m == 1.0
    with pytest.raises(ValueError, match="positive"):
        dist.top_k_mass(F.col("x"), 0)


def test_argmax_pool_normalise(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1, 1, 0]), ([], [0, 1, 1])], "x array<double>, m array<int>")
    got = df.select(dist.argmax(F.col("x")).alias("a"), dist.last_token_pool(F.array(F.lit("p"), F.lit("q"), F.lit("r")), F.col("m")).alias("h"), dist.l2_normalise(F.col("x")).alias("n")).collect()
    assert [r.a for r in got] == [1, None]
    assert [r.h for r in got] == ["q", "r"]
    assert sum(v * v for v in got[0].n) == pytest.approx(1.0) and got[1].n == []


def test_sections(spark):
    rows = [("mid", i, t) for i, t in enumerate([1, 9, 2, 9])] + [("none", i, 1) for i in range(3)] + [("last", 0, 1), ("last", 1, 9)] + [("first", 5, 9), ("first", 6, 1)]
    df = spark.createDataFrame([(s, p, t, float(p)) for s, p, t in rows], "s string, p int, t int, e double")
    got = {r.s: r for r in dist.section_metrics(df, "s", "p", "t", "e", "e", 9).collect()}
    assert (got["mid"].avg_entropy_thinking, got["mid"].avg_entropy_output, got["mid"].think_end_position) == (0.5, 2.5, 1)
    assert (got["none"].avg_entropy_thinking, got["none"].avg_entropy_output, got["none"].think_end_position) == (None, 1.0, None)
    assert (got["last"].avg_entropy_output, got["last"].think_end_position) == (None, 1)
    assert (got["first"].avg_entropy_thinking, got["first"].think_end_position) == (5.0, 0)
    for r in got.values():  # weighted sections recombine to the whole
        if r.think_end_position is not None and r.avg_entropy_output is not None:
            n = r.think_end_position + 1
            assert (n * r.avg_entropy_thinking + (r.num_tokens - n) * r.avg_entropy_output) / r.num_tokens == pytest.approx(r.avg_entropy)


def test_draws_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    from tessella.functions import distribution as dist

    df = spark.range(20000).select("id", F.array(F.lit(0.2), F.lit(0.0), F.lit(0.5), F.lit(0.3)).alias("p"))
    draw = lambda seed: df.select(dist.sampled(F.col("p"), dist.uniform(seed, F.col("id"))).alias("t"))
    n = {r.t: r["count"] for r in draw(1).groupBy("t").count().collect()}
    assert set(n) == {0, 2, 3} and all(abs(n[k] / 20000 - p) < 0.02 for k, p in ((0, 0.2), (2, 0.5), (3, 0.3)))
    assert draw(1).collect() == draw(1).collect() != draw(2).collect()
    edge = spark.createDataFrame([([0.5, 0.5, 0.0], 1.0), ([], 0.1), ([1.0], 0.0)], "p array<double>, u double")
    assert [r.t for r in edge.select(dist.sampled(F.col("p"), F.col("u")).alias("t")).collect()] == [1, None, 0]
