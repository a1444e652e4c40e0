from __future__ import annotations

import random

import pytest

from tessella.llm import leakage as L

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 9))) for _ in range(900)]


def text(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(text(70))) for i in range(30)]


def planted(item, begin, n):
    return " ".join(ITEMS[item][1].split()[begin : begin + n])


@pytest.fixture(scope="module")
def patterns():
    return L.Patterns(ITEMS)


@pytest.mark.parametrize("seed", range(5))
def test_hits_are_those_of_brute_force(patterns, seed):
    rng = random.Random(seed)
    doc = text(200, rng)
    for _ in range(5):
        at, item = rng.randrange(200), rng.randrange(30)
        doc[at:at] = planted(item, rng.randrange(60), rng.randint(2, 9)).split()
    got = {(n, d, i) for n, h in patterns.hits(doc).items() for d, i in h}
    want = set()
    for n, (_, t) in enumerate(ITEMS):
        w = t.split()
        want |= {(n, d, i) for d in range(len(doc) - 3) for i in range(len(w) - 3) if doc[d : d + 4] == w[i : i + 4]}
    assert got == want


def test_passages_in_disguise(patterns):
    pad = " ".join(text(30))
    p = planted(3, 10, 30)
    w = p.split()
    for form in (
        p, p.upper(), ", ".join(w), "\r\n> ".join(w), " ".join(f"**{x}**" if i % 5 == 0 else x for i, x in enumerate(w)), "\\n".join(w), " ".join(f"<b>{x}</b>" for x in w),
        " ".join("changed" if i % 7 == 3 else x for i, x in enumerate(w)), " ".join(x for i, x in enumerate(w) if i % 8 != 3), " ".join(f"{x} added" if i % 8 == 3 else x for i, x in enumerate(w)),
    ):
        assert patterns.leaked(f"{pad} {form} {pad}") == [3], form


def test_short_runs_are_no_case(patterns):
    pad = " ".join(text(30))
    assert patterns.leaked(f"{pad} {planted(3, 10, 11)} {pad}") == []
    assert patterns.leaked(" ".join(f"{planted(3, 6 * k, 5)} {' '.join(text(6))}" for k in range(10))) == []
    assert patterns.leaked(f"{pad} {planted(3, 10, 15)} {pad}") == []  # one passage, but under twenty words
    assert patterns.leaked(f"{planted(3, 0, 13)} {pad} {planted(3, 30, 13)}") == [3]  # two passages together
    assert sorted(patterns.leaked(f"{planted(3, 0, 30)} {planted(9, 5, 40)}")) == [3, 9]


def test_table(spark):
    schema = "doc_id long, text string, item_id string"
    docs = spark.createDataFrame([(1, planted(2, 0, 40), "x"), (1, planted(2, 0, 40), "x"), (2, None, "x"), (3, "", "x"), (4, " ".join(text(20000)) + " " + planted(5, 20, 30), "x")], schema)
    items = spark.createDataFrame([*ITEMS, (100, ITEMS[2][1]), (101, None), (102, "too short"), (103, "")], "item_id long, text string")
    want = [(1, 2), (1, 100), (4, 5)]
    for block in (10**6, 500):  # all items at once, and one or two at a time
        assert sorted(tuple(r) for r in L.leaks(docs, items, block_chars=block).collect()) == want
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_longest_agreeing_part(seed):
    rng = random.Random(seed)
    at, run = 0, []
    for _ in range(rng.randint(1, 9)):
        at += rng.randint(1, 6)
        run.append((at, at := at + rng.randint(1, 9)))
    parts = [(run[k][1] - run[i][0], i, k) for i in range(len(run)) for k in range(i, len(run)) if sum(b - a for a, b in run[i : k + 1]) >= L.AGREE * (run[k][1] - run[i][0]) - 1e-9]
    longest = max((p[0] for p in parts), default=0)
    got = L.agreeing(run)
    assert max((e - b for b, e, _ in got), default=0) == (longest if longest >= L.PASSAGE else 0)
    assert all(same >= L.AGREE * (e - b) - 1e-9 for b, e, same in got)


def test_chance_matches_beside_a_passage(patterns):
    w = planted(3, 20, 22).split()
    own = ITEMS[3][1].split()
    spoiled = [own[17], "x", "y", *w, "x", "y", "z", own[43]]
    assert patterns.leaked(" ".join(text(10) + spoiled + text(10))) == [3]


def test_contest_of_items_in_different_blocks(spark):
    long = text(60)
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:30] + text(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(text(10) + long + text(10)), "x")], "doc_id long, text string, same string")
    got = [sorted(tuple(r) for r in L.leaks(docs, items, block_chars=n).collect()) for n in (10**6, 150)]
    assert got == [[(1, 1)], [(1, 1)]]


def test_long_tags_and_many_regions(patterns):
    p = planted(4, 0, 40).split()
    tag = '<span class="' + "a" * 200 + '">'
    assert patterns.leaked(" ".join(f"{tag}{x}</span>" for x in p)) == [4]
    many = " ".join(" ".join(planted(4, 10 * k, 6).split() + text(3)) for k in (0, 5, 1, 4, 2, 5, 0, 3)) + " " + planted(4, 5, 30)
    assert patterns.leaked(many) == [4]
