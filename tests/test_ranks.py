from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grid, ranks

SCHEMA = "g string, x double, q string, n string"


@pytest.mark.parametrize(("bits", "most"), [(10, 10**6), (1, 10**6), (3, 2)])
def test_percentiles_against_numpy(spark, monkeypatch, bits, most):
    """A hot group of half the rows, ties, extremes, infinities, and groups of one; with and without broadcast."""
    monkeypatch.setattr(ranks, "BROADCAST_GROUPS", most)
    monkeypatch.setattr(ranks, "BITS", bits)
    rng = random.Random(bits)
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 5e-324, 2.0, 2.0]
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([*values, rng.gauss(0, 1), rng.random()]), "", "") for _ in range(600)] + [("one", 3.0, "", ""), ("none", None, "", "")]
    ps = (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)
    got = {r.g: (r.n, r.q) for r in ranks.exact_percentiles(spark.createDataFrame(rows, SCHEMA), ["g"], "x", ps).collect()}
    by: dict = {}
    for g, x, *_ in rows:
        if x is not None and x == x:
            by.setdefault(g, []).append(x)
    assert set(got) == set(by) and None in got
    for g, v in by.items():
        v.sort()
        assert got[g][0] == len(v)
        for p, q in zip(ps, got[g][1], strict=True):
            t = p * (len(v) - 1)
            lo, hi = v[math.floor(t)], v[math.ceil(t)]
            if lo == hi or t == math.floor(t):
                assert q == lo
            elif np.isfinite([lo, hi]).all():
                assert q == pytest.approx(lo + (hi - lo) * (t - math.floor(t)), rel=1e-9, abs=1e-300)


def test_without_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranks.exact_percentiles(df, ["g"], "x", (0.5,)).count() == 0
    assert ranks.exact_percentiles(df, [], "x", (0.5,)).count() == 0


def test_values_at_ranks(spark):
    rows = spark.range(1000).select(F.struct(F.lit(1).alias("k")).alias("g"), (F.col("id") * 3 - 700).alias("code"))
    wanted = spark.createDataFrame([(r,) for r in (-1, 0, 1, 500, 999, 1000)], "rank long").select(F.struct(F.lit(1).alias("k")).alias("g"), "rank")
    assert {r["rank"]: r.code for r in ranks.values_at(rows, wanted, 4).collect()} == {r: r * 3 - 700 for r in (0, 1, 500, 999)}


def test_numbers_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("_n")).repartition(9)
    assert grid.numbered(df, "v").where("ordinal <> v").count() == 0
    assert grid.numbered(df.limit(0), "v").count() == 0
