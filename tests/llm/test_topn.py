from __future__ import annotations

import collections
import random

import pytest

from tessella.llm import topn
from tessella.llm.topn import top_n
from tessella.operators import ranks

SCHEMA = "g long, h string, i string, v double, rank_no string, lo string"


def brute(rows, n):
    best: dict = {}
    for g, h, i, v, *_ in rows:
        if g is not None and i is not None and v is not None and v == v:
            best[g, h, i] = max(best.get((g, h, i), float("-inf")), v)
    by = collections.defaultdict(list)
    for (g, h, i), v in best.items():
        by[g, h].append((-(v + 0.0), i.encode(), i))
    return {(g, h, i, r) for (g, h), x in by.items() for r, (_, _, i) in enumerate(sorted(x)[:n], 1)}


def rows_of(seed, n=2500):
    rng = random.Random(seed)
    ids = [None, "", *["p" * rng.randint(1, 20) + rng.choice(["", "a", "é", "\x00", "zz", "😀"]) + str(rng.randint(0, 30)) for _ in range(60)]]
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.0, 1.0, 2.0, 2.0, 2.0, 1e300, -1e-300]
    return [(rng.choice([1, 1, 1, 1, 2, 3, None, 4]), rng.choice(["x", None]), rng.choice(ids), rng.choice([*values, rng.random()]), "clash", "clash") for _ in range(n)]


@pytest.mark.parametrize(("split", "broadcast"), [(64, 10**6), (2, 10**6), (4, 0), (8, 3)])
def test_against_brute_force(spark, monkeypatch, split, broadcast):
    """With many ties, a group of half the rows, few parts a round, and joins of hot and other groups without broadcast."""
    monkeypatch.setattr(ranks, "BROADCAST_GROUPS", broadcast)
    rows = rows_of(split)
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g", "h"], "i", "v", 7, split=split)
    assert got.columns == ["g", "h", "i", "rank_no"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == brute(rows, 7)


def test_all_scores_equal(spark):
    rows = [(1, "x", f"same beginning {k:04d}", 1.0, "", "") for k in range(500)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "i", "v", 3)
    assert sorted((r.rank_no, r.i) for r in got.collect()) == [(k + 1, f"same beginning {k:04d}") for k in range(3)]


def test_scores_one_last_bit_apart(spark, monkeypatch):
    """They need no more rounds than others: nine bits tell 300 of them apart."""
    import math

    rounds = []
    divide = topn.with_division
    monkeypatch.setattr(topn, "with_division", lambda *a: rounds.append(1) or divide(*a))
    v, rows = 0.7, []
    for k in range(300):
        rows.append((1, "x", f"i{k}", v, "", ""))
        v = math.nextafter(v, 1)
    rows += [(1, "x", "low", -1e300, "", ""), (1, "x", "high", 1e300, "", "")]
    got = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "i", "v", 4)
    assert [r.i for r in got.orderBy("rank_no").collect()] == ["high", "i299", "i298", "i297"]
    assert len(rounds) <= 4


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["g", "h"], "i", "v", 3).count() == 0
