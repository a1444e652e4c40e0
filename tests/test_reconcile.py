from __future__ import annotations

import random

import pandas as pd
import pytest

from tessella.operators import reconcile
from tessella.operators.reconcile import differences

SCHEMA = "ordinal long, k string, n long, s string, x double, extra string"


def brute(left, right, tolerance=1e-6):
    def stand(rows):
        best = {}
        for r in rows:
            if r[1] is not None and r[2] is not None and (r[1:3] not in best or best[r[1:3]][0] < r[0]):
                best[r[1:3]] = r
        return best

    a, b = stand(left), stand(right)
    out = {(*k, "only_in_left", "row") for k in a.keys() - b.keys()} | {(*k, "only_in_right", "row") for k in b.keys() - a.keys()}
    for k in a.keys() & b.keys():
        if a[k][3] != b[k][3]:
            out.add((*k, "differs", "s"))
        x, y = a[k][4], b[k][4]
        same = x is None and y is None or x is not None and y is not None and (x == y or x != x and y != y or abs(x - y) <= tolerance)
        if not same:
            out.add((*k, "differs", "x"))
    return out


def rows_of(rng, n):
    out = []
    for i in range(n):
        out.append((i, rng.choice(["", "a", "b", "é", None, "long " * 50]), rng.choice([0, 1, 2, 3, None]), rng.choice(["", None, "s", "t"]), rng.choice([None, 0.0, -0.0, float("nan"), float("inf"), 1e300, rng.random()]), "z"))
    return out


@pytest.mark.parametrize(("seed", "keys_per_bucket", "third"), [(1, 4096, 512), (2, 4096, 1), (3, 2, 1)])
def test_against_brute_force(spark, seed, keys_per_bucket, third):
    """Also with tables far too small for the differences, so that retries and the outright listing are taken."""
    rng = random.Random(seed)
    left = rows_of(rng, 200)
    right = [(o, k, n, s if rng.random() < 0.8 else "u", x + 1e-9 if x is not None and x == x and rng.random() < 0.5 else x, e) for o, k, n, s, x, e in left if rng.random() < 0.9] + [(900, "only", 7, "s", 1.0, "z")]
    got = differences(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k", "n"], "ordinal", ["s", "x"], keys_per_bucket=keys_per_bucket, third=third)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(left, right)


def test_many_keys_and_one_hot_key(spark):
    left = [(i, f"k{i}", 0, "s", 1.0, "e") for i in range(3000)] + [(10_000 + i, "hot", 0, f"v{i}", 1.0, "e") for i in range(1500)]
    right = [(i, f"k{i}", 0, "s" if i % 100 else "t", 1.0 if i % 50 else 1.1, "e") for i in range(2990)] + [(10_000 + i, "hot", 0, "last", 1.0, "e") for i in range(1500)]
    got = differences(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k", "n"], "ordinal", ["s", "x"], keys_per_bucket=512, third=64)
    assert {tuple(r) for r in got.collect()} == brute(left, right)


def test_empty_sides(spark):
    one = spark.createDataFrame([(0, "a", 1, "s", 1.0, "e")], SCHEMA)
    none = one.limit(0)
    assert [tuple(r) for r in differences(one, none, ["k", "n"], "ordinal", ["s", "x"]).collect()] == [("a", 1, "only_in_left", "row")]
    assert differences(none, none, ["k", "n"], "ordinal", ["s", "x"]).count() == 0


def test_peel_gives_up_when_the_table_is_too_full(spark):
    pairs = spark.createDataFrame([(i, i * 7, i * 13) for i in range(1, 400)], "k1 long, k2 long, h long")
    cells = reconcile.subtracted_tables(pairs, pairs.limit(0), 1, 16).toPandas()
    found, whole = reconcile.peel(cells, 16)
    assert not whole
    cells = reconcile.subtracted_tables(pairs, pairs.limit(0), 1, 512).toPandas()
    found, whole = reconcile.peel(cells, 512)
    assert whole and sorted(found) == [(i, i * 7) for i in range(1, 400)]
    assert reconcile.peel(pd.DataFrame(columns=["cell", "n", "k1", "k2", "h", "c"]), 16) == ([], True)
