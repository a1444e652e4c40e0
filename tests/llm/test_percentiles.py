from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import percentiles as P

PS = (0.05, 0.25, 0.5, 0.75, 0.95)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-1e6, 1e6)), max_size=400), st.integers(10, 500))
def test_clusters_keep_mass_and_order(rows, delta):
    g = np.array([a for a, _ in rows], dtype="int64")
    v = np.array([b for _, b in rows])
    gg, m, w = P.cluster(g, v, np.ones(len(g), "int64"), delta)
    for k in range(4):
        own = gg == k
        assert w[own].sum() == (g == k).sum() and own.sum() <= delta / 2 + 2
        assert (np.diff(m[own]) >= -1e-6).all()
        if own.any():
            assert (m[own] * w[own]).sum() == pytest.approx(v[g == k].sum(), abs=1e-3)


def rank_error(values, estimate, p):
    """How far rank p (n - 1) lies outside the ranks where the estimate stands, by n."""
    v = np.sort(values)
    t = p * (len(v) - 1)
    return max(0.0, (v < estimate).sum() - 1 - t, t - (v <= estimate).sum()) / len(v)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(30000):
        d = rng.choice(["hot", "hot", "a", "b", None])  # one group holds two fifths of all rows
        x = rng.choice([rng.gauss(0, 1), rng.expovariate(1) ** 4, 5.0, None, float("nan")])
        rows.append((d, f"day {i % 7}", x, 1.0, "clash"))
    rows += [("two", "day 1", 1.0, 1.0, ""), ("two", "day 2", 2.0, 1.0, ""), ("none", "day 1", None, None, ""), ("inf", "d", float("inf"), 0.0, ""), ("inf", "d", 1.0, 0.0, "")]
    return rows, spark.createDataFrame(rows, "d string, day string, x double, c double, mean string").repartition(6).cache()


def test_errors_are_counted_right_and_bounded(table):
    rows, df = table
    got = P.percentiles(df, ["d"], ["x", "c"], F.col("day")).collect()
    seen = set()
    for r in got:
        values = np.array([x[2] if r.metric == "x" else x[3] for x in rows if x[0] == r.key and (x[2] if r.metric == "x" else x[3]) is not None], dtype=float)
        values = values[~np.isnan(values)]
        assert r.n == len(values)
        assert r.rank_error == pytest.approx(rank_error(values, r.estimate, r.p), abs=1e-12)
        assert r.rank_error <= P.BOUND
        seen.add((r.key, r.metric))
    assert ("none", "x") not in seen and (None, "x") in seen and ("two", "x") in seen
    two = {r.p: r.estimate for r in got if r.key == "two" and r.metric == "x"}
    assert two[0.5] == 1.5 and two[0.25] == 1.25  # small groups are exact


def test_failed_groups_are_digested_again(table, monkeypatch):
    _, df = table
    got = P.percentiles(df, ["d"], ["x"], None, delta=4, bound=0.002, rounds=4)
    assert got.where("rank_error > 0.002").count() == 0 and got.groupBy("dim", "key", "metric", "p").count().where("count > 1").count() == 0


def test_what_stays_beyond_the_bound_is_counted_exactly(table):
    rows, df = table
    got = P.percentiles(df, ["d"], ["x"], None, delta=4, bound=1e-9, rounds=1).collect()
    assert len({(r.key, r.p) for r in got}) == len(got) and max(r.rank_error for r in got) <= 1e-9
    values = np.array([x[2] for x in rows if x[0] == "hot" and x[2] is not None and x[2] == x[2]])
    for r in got:
        if r.key == "hot":
            assert r.n == len(values) and r.estimate == pytest.approx(np.percentile(values, 100 * r.p), rel=1e-12)


def test_digests_of_many_tasks_merge_in_a_tree(table, monkeypatch):
    _, df = table
    want = {(r.key, r.slice): r.n for r in P.estimates(P.digest(df, ["d"], ["x"], F.col("day"))).collect()}
    monkeypatch.setattr(P, "FAN_IN", 2)
    got = P.estimates(P.digest(df, ["d"], ["x"], F.col("day"))).collect()
    assert {(r.key, r.slice): r.n for r in got} == want


def test_days_merge_to_the_whole(table):
    rows, df = table
    daily = P.merge(P.digest(df, ["d"], ["x"], F.col("day")))
    assert daily.select("slice").distinct().count() >= 7
    parts = [daily.where(F.col("slice").isin([f"day {i}" for i in days])) for days in ((0, 1, 2), (3, 4), (5, 6))]
    whole = P.merge(*parts, over_slices=True)
    for r in P.estimates(whole).collect():
        if r.key != "hot":
            continue
        values = np.array([x[2] for x in rows if x[0] == "hot" and x[2] is not None and x[2] == x[2]])
        assert r.n == len(values)
        assert max(rank_error(values, e, p) for e, p in zip(r.est, PS, strict=True)) < P.BOUND


def test_many_groups_per_task_and_salted_join(table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(P, "GATHERED", 50)
    monkeypatch.setattr(P, "BROADCAST_GROUPS", 2)
    got = P.percentiles(df.limit(2000), ["d", "day"], ["x"])
    assert got.count() > 0 and got.where("rank_error > 0.01").count() == 0


def test_empty(table):
    _, df = table
    assert P.percentiles(df.limit(0), ["d"], ["x"]).count() == 0
