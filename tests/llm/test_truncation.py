from __future__ import annotations

import random

import pytest

from tessella.llm import truncation as T
from tessella.llm.answers import WINDOW, Windows

RNG = random.Random(2)
NOUNS = ["notary", "harbour", "lemon", "cello", "ledger", "fever", "siege", "server", "judge", "river"]
SCHEMA = "source string, ordinal long, run_id string, question string, text string, num_tokens long, max_tokens long, bands string"


def sentence(rng=RNG):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} is {rng.choice(['old', 'new', 'odd', 'plain'])} and it {rng.choice(['sings', 'waits', 'falls', 'turns'])} at {rng.choice(['night', 'noon', 'dawn'])}."


def whole(n=6):
    return " ".join(sentence() for _ in range(n))


@pytest.fixture(scope="module")
def judged(spark):
    rows: dict[int, tuple] = {}

    def add(text, cut, run="r", tokens=None, top=4000, q="Why is it so?"):
        n = len(rows)
        rows[n] = (("results", n, run, q, text, int(len(text or "") / 4.3) if tokens is None else tokens, top, "clash"), cut)
        return n

    for _ in range(300):
        add(whole(RNG.randint(2, 9)), False)
    for _ in range(60):
        add(whole(2) + "\n\n- the notary\n- the harbour\n- the " + RNG.choice(NOUNS), False)
        t = whole(30)[:400]
        add(t, True, "limited", tokens=150)
        add(whole(2), False, "limited")
    cases = {
        "null": add(None, False), "empty": add("", False), "blank": add(" \n", False), "fence": add(whole() + "\n```\nx = 1", True), "closed fence": add(whole() + "\n```\nx = 1\n```", False),
        "thinking": add("<think>\n" + whole(), True), "broken": add(whole()[:-9] + "�", True), "word": add(whole()[:-4], True), "tokens": add(whole(), True, tokens=4000),
        "short for tokens": add(whole(2), True, tokens=500), "item": add(whole(2) + "\n\n- the notary\n- the harb", True), "and so on": add(whole(2)[:-1] + ", and so on.", False),
        "signature": add(whole(2) + "\n\n— yours, from Somewhere", False), "signature cut": add(whole(2) + "\n\n— yours, from", True), "dots": add(whole(2)[:-1] + "...", False),
        "echo": add("  What is the plain notary\n", False, q="What is the plain notary?"), "null run": add(whole(2), False, run=None, tokens=None),
    }
    base = " ".join(f"{sentence()[:-1]} {i}." for i in range(40))
    cases |= {"copy": add(base, False), "cut copy": add(base[: int(len(base) * 0.93)].rpartition(".")[0].rsplit(" ", 3)[0] + ".", True)}
    cases |= {"short copy": add(base[: int(len(base) * 0.6)].rpartition(".")[0].rsplit(" ", 3)[0] + ".", True)}  # two fifths are missing
    df = spark.createDataFrame([r for r, _ in rows.values()], SCHEMA)
    got = {r.ordinal: r.evidence for r in T.truncated(df).collect()}
    return rows, cases, got, df


def test_all_cases(judged):
    rows, cases, got, _ = judged
    wrong = {n: (r[4][-40:] if r[4] else r[4], cut, got.get(n)) for n, (r, cut) in rows.items() if (n in got) != cut}
    assert not wrong


def test_evidence(judged):
    _, cases, got, _ = judged
    want = {"fence": "open mark", "thinking": "open mark", "tokens": "all tokens used", "short for tokens": "more tokens than text", "item": "closing word", "signature cut": "closing word", "word": "closing word", "cut copy": "longer copy", "short copy": "longer copy"}
    assert {k: got[cases[k]] for k in want} == want


def test_empty_table(judged):
    *_, df = judged
    assert T.truncated(df.limit(0)).count() == 0


def test_bands_of_a_cut_copy_are_bands_of_its_original():
    rng = random.Random(1)
    met, w = 0, Windows()
    for _ in range(300):
        long = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 300))]
        short = [x if rng.random() > 0.03 else "edited" for x in long[: max(8, int(len(long) * rng.uniform(0.2, 0.95)))]]
        short[-1] = short[-1][:2]
        got = w.bands([" ".join(short), " ".join(long)])
        bands, asks = got["bands"].to_pylist(), got["asks"].to_pylist()[0]
        met += bool({x for x, a in zip(bands[0], asks, strict=True) if a} & set(bands[1]))
    assert met >= 285
    assert w.bands([None, "", "seven words are not enough for it"])["bands"].to_pylist() == [None, None, None]
    assert w.bands([])["bands"].to_pylist() == []


def test_every_window_has_a_band():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    got = {k: v.to_pylist()[1] for k, v in Windows().bands(["another text of ten words goes before it in vain", " ".join(words), "and one after"]).items()}
    at = sorted(len(words) - a for a in got["after"])
    assert at[-1] >= len(words) - 4 - WINDOW and all(b - a <= WINDOW for a, b in zip(at, at[1:])) and at[0] < WINDOW
    assert len(set(got["bands"])) == len(got["bands"])
    # the same words before it give the same hashes, whatever else the texts have
    again = {k: v.to_pylist()[0] for k, v in Windows().bands([" ".join(["other", "beginning"] + words[100:])]).items()}
    near = dict(zip(got["bands"], got["near"], strict=True))
    shared = [(n, near[b]) for b, n, a in zip(again["bands"], again["near"], again["after"], strict=True) if b in near and a < 230]
    assert len(shared) > 20 and all(x == y for x, y in shared)


def test_limit_of_some_texts_of_a_run(spark):
    """A limit below the longest texts of its run, with dots or nothing in place of the rest; no token counts tell of it."""
    rng = random.Random(5)
    text = lambda n: " ".join(sentence(rng) for _ in range(n))
    fill = lambda n: text(12)[:n].rstrip(" .").ljust(n, "x")
    rows = [("results", i, "r", "Why?", text(rng.randint(2, 12)), None, 4000, "clash") for i in range(200)]
    rows += [("results", 1000 + i, "r", "Why?", text(rng.randint(2, 8))[:-1] + "...", None, 4000, "clash") for i in range(30)]
    rows += [("results", 2000 + i, "r", "Why?", fill(300).rsplit(" ", 1)[0].ljust(300, "-") + "...", None, 4000, "clash") for i in range(15)]
    answers = T.materialise(T.read_answers(spark.createDataFrame(rows, SCHEMA), False)).where("kind = 0")
    assert {tuple(sorted(r.spikes)) for r in T._spikes(answers).collect()} == {("bytes dots 303", "chars dots 303")}
    got = {r.ordinal: r.evidence for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {2000 + i: "storage limit" for i in range(15)}


def test_fragment_before_dots(spark):
    rows = [("results", i, "r", "Why?", whole(4), None, 4000, "clash") for i in range(50)]
    rows += [("results", 100, "r", "Why?", whole(3) + " The nota...", None, 4000, "clash"), ("results", 101, "r", "Why?", whole(3) + " The notary...", None, 4000, "clash")]
    assert [(r.ordinal, r.evidence) for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()] == [(100, "closing word")]


def variants(rng, n, edited):
    """Variants of a template, with copies of them that are cut inside a sentence; edited: with a changed word before the cut."""
    base = " ".join(f"{sentence(rng)[:-1]} {i}." for i in range(30))
    rows = [("results", 0, "r", "Why?", base + " Nothing like it ends so at all, says the judge of the river.", None, 4000, "clash")]
    for i in range(1, n):
        own = base + f" Only the variant {i} of the notary goes on with lemons."
        short = own.rsplit(" ", 3)[0].split(" ")
        if edited:
            short[rng.randrange(len(short) - 30)] = "otherwise"
        rows += [("results", i, "r", "Why?", own, None, 4000, "clash"), ("results", 10_000 + i, "r", "Why?", " ".join(short) + ".", None, 4000, "clash")]
    return rows


@pytest.mark.parametrize(("edited", "range_rows"), [(False, 10**6), (True, 10**6), (True, 300)])
def test_cut_copy_among_variants_of_a_template(spark, monkeypatch, edited, range_rows):
    """Every cut copy is held against its own original, though all share their bands, in one range or in many."""
    monkeypatch.setattr(T, "RANGE_ROWS", range_rows)
    rows = variants(random.Random(9), 60, edited)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.ordinal for r in T.truncated(df).where("evidence = 'longer copy'").collect()}
    assert got == {r[1] for r in rows if r[1] > 10_000}


def test_longer_copy_that_is_not_judged(spark):
    rng = random.Random(3)
    own = " ".join(sentence(rng) for _ in range(8))
    cut = own.rsplit(" ", 6)[0] + "."
    df = spark.createDataFrame([("results", 1, "r", "Why?", cut, None, 4000, "clash"), ("results", 2, "r", "Why?", sentence(rng), None, 4000, "clash")], SCHEMA)
    assert T.truncated(df).count() == 0
    others = spark.createDataFrame([(own, "clash"), (None, ""), ("", ""), (own, "")], "text string, bands string")
    assert [(r.ordinal, r.evidence) for r in T.truncated(df, others).collect()] == [(1, "longer copy")]


def crowded(rng, groups, others):
    """Copies with a changed word, cut inside a sentence two words into what only their originals go on with, among longer texts
    that are like them but for another word in that place and another end."""
    rows = []
    for g in range(groups):
        base = " ".join(f"{sentence(rng)[:-1]} {g} {i}." for i in range(6)).split()
        with_word = lambda w: base[:5] + [w] + base[6:]  # noqa: B023, E731
        rows.append((10_000 + g, with_word("otherwise") + ["Lemons", "ripen"]))
        rows.append((g, base + ["Lemons", "ripen", "late", "this", "year."]))
        rows += [(1000 * (g + 100) + i, with_word(f"other{i}") + ["Of", f"these{i}", "nobody", "ever", "spoke", "again", "there."]) for i in range(others)]
        rows += [(1000 * (g + 200) + i, with_word("otherwise") + ["Of", f"those{i}", "nobody", "ever", "spoke", "again", "there."]) for i in range(3)]
    return [("results", n, "r", "Why?", " ".join(w), None, 4000, "clash") for n, w in rows]


def test_original_of_a_changed_copy_among_many_that_agree_further_back(spark):
    df = spark.createDataFrame(crowded(random.Random(4), 8, 30), SCHEMA)
    got = {r.ordinal for r in T.truncated(df).where("evidence = 'longer copy'").collect()}
    assert got == {10_000 + g for g in range(8)}


def test_every_containing_text_is_a_candidate(spark):
    """The pairs are all that brute force finds, whatever is repeated, and next to none besides."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(60)]
    for t in texts[:30]:
        w = t.split()
        texts += [" ".join(w + [rng.choice("abcd") for _ in range(rng.randint(1, 40))]), " ".join("edited" if rng.random() < 0.04 else x for x in w), " — ".join(w[: rng.randint(1, len(w))]).upper()]
    texts = sorted(set(texts))
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 8 else set() for t in texts for w in [t.replace(" — ", " ").casefold().split()]]
    want = {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams) if i != j and a and len(a & b) >= 0.8 * len(a)}
    marks = T.read_grams(spark.createDataFrame(list(enumerate(texts)), "th long, text string")).where("grams is not null").selectExpr("*", "true as asks")
    got = {(r.th, r.long) for r in T._containing(marks).collect()}
    assert len(want) > 60 and want <= got
    assert len(got) <= 1.5 * len(want)


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("copies", [1, 4])
def test_sketches_are_not_sent_with_every_shingle(spark, copies):
    """Texts that share most of their shingles with others send few bytes a shingle, and none is missed, however often it is read."""
    rng = random.Random(8)
    parts = [[f"{rng.choice(NOUNS)}{i}{k}" for k in range(40)] for i in range(60)]
    texts = [" ".join(rng.choice(parts) + rng.choice(parts)) for _ in range(2000)] + [" ".join(p[: rng.randint(20, 38)]) for p in parts]
    texts = sorted(set(texts))
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for t in texts for w in [t.split()]]
    has = {}
    for i, own in enumerate(grams):
        for x in own:
            has.setdefault(x, set()).add(i)
    want = {(i, j) for i, a in enumerate(grams) for j in set().union(*(has[x] for x in a)) - {i} if len(a & grams[j]) >= 0.8 * len(a)}
    df = spark.createDataFrame([(i, t) for _ in range(copies) for i, t in enumerate(texts)], "th long, text string")
    marks = T.materialise(T.read_grams(df.repartition(4)).where("grams is not null").selectExpr("*", "true as asks"))
    before = shuffled(spark)
    pairs = T._containing(marks)
    sent = shuffled(spark) - before
    assert sent <= 4 * copies * sum(map(len, grams))  # two; with a hash and a sketch in each row more than nine
    assert want <= {(r.th, r.long) for r in pairs.collect()}
    assert pairs.count() <= 1.5 * len(want)


def test_counts_by_slot_are_packed_and_added(spark):
    counts = T.np.zeros(4 * T.BLOCK, T.np.int32)
    counts[[0, 5, T.BLOCK - 1, 2 * T.BLOCK, 4 * T.BLOCK - 1]] = [1, 70_000, 3, 2**31 - 1, 1]
    blocks, packed = T._pack(counts)
    got = {int(s) + k * T.BLOCK: int(n) for k, p in zip(blocks, packed, strict=True) for s, n in zip(*T._unpack(p), strict=True)}
    assert blocks == [0, 2, 3] and got == {int(i): int(counts[i]) for i in T.np.flatnonzero(counts)}


def test_defects_send_texts_to_align_once(spark):
    """With hints, as p3_found judges: cut copies among texts that share their shingles are found, and what is shuffled is a small
    multiple of the texts."""
    rng = random.Random(12)
    parts = [" ".join(f"{rng.choice(NOUNS)}{i}{k}" for k in range(40)) for i in range(60)]
    texts = sorted({f"{rng.choice(parts)} {rng.choice(parts)} ends." for _ in range(3000)})
    cut = [t.rsplit(" ", 4)[0] for t in texts[::40]]
    rows = [("results", i, "r", "Why?", t, None, 4000, "clash") for i, t in enumerate(texts + cut)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = shuffled(spark)
    got = T.judged(df, hints=True).where("evidence = 'longer copy'").collect()
    sent = shuffled(spark) - before
    assert {r.ordinal for r in got} >= set(range(len(texts), len(rows)))
    assert sent <= 2.1 * sum(map(len, texts))
