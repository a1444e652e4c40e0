"""Answers whose end is missing.

Evidence, all of it gathered from whole tables, in the order in which it is named:

* near-copies: each text is aligned with all that have enough of its shingles (see _containing), and a copy whose alignment
  ends early, inside a sentence of the longer one, is cut; so is one that ends with a sentence if its number of tokens is
  rather that of the longer one;
* the closing word of texts without such a copy: its terminality is the share of its places, in lines of its kind (list items,
  signatures, others), that close a line, by counts over the whole corpus; what hardly ever closes a line, or is no word of
  the corpus at all, is where a text was cut;
* open marks at the end (see structure), a replacement character, a tag that breaks off;
* the generation used all of its max_tokens, or more tokens than a text of these lengths in these languages can have; the
  tokens a character takes are measured for each language over all closed answers;
* a storage limit: in a source and run, unusually many texts end at the very greatest length, in characters or bytes; or, as
  a limit may hold for some texts only, unusually many that don't end like whole ones have one length, whatever it is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.answers import EDGE, PLACES, SHINGLE, read_answers, read_grams, text_hash
from tessella.llm.language import FUNCTION_WORDS, LANGUAGES
from tessella.session import materialise, ship, small_enough

SIMILAR = 0.8
#: Bits of a shingle's hash by which the texts that have it are counted; words of 64 bits in a text's sketch.
SLOT_BITS, SKETCH = 24, 3
#: Answers of at least so many characters and so many of them per language measure its tokens per character.
MEASURED_CHARS, MEASURED = 60, 30
#: Room above the greatest measured tokens per character; for texts that end like whole ones, room besides.
SLACK, CLOSED_SLACK = 1.03, 1.1
#: A greatest length is a limit if this many texts have it, and that many times the usual number of texts of one length.
LIMIT_TEXTS, LIMIT_TIMES = 3, 5
#: Any length is one for texts that don't end like whole ones if it has LIMIT_TIMES the mean number of the lengths up to
#: LIMIT_NEAR away, with at least LIMIT_ODDS as the logarithm of the odds against chance (Chernoff, Poisson).
LIMIT_NEAR, LIMIT_ODDS = 20, 14
#: A word that closes lines in less than this share of its places doesn't close a text; places that the usual share counts for.
TERMINAL, SMOOTH = 0.02, 2
#: Texts to fetch (8 bytes each) up to which their list is broadcast.
BROADCAST_TEXTS = 1_000_000
#: Rows (about 40 bytes each) in a part of the join of shingles.
RANGE_ROWS = 1_000_000
#: Slots of a block of counts; pairs that a part of the join looks at, and remembers, at once.
BLOCK, JOIN_PAIRS, MET_PAIRS = 1 << 16, 500_000, 4_000_000
#: What goes to a part of the join: of texts th, held, sketch and n, how many rows are theirs; of rows g and asks.
_PART = {"part": None, "th": np.int64, "held": np.int32, "sketch": np.uint64, "n": np.int32, "g": np.int32, "asks": np.bool_}

_FUNCTION_WORDS = sorted({w for v in FUNCTION_WORDS.values() for w in v.split()})
_TOKEN = re.compile(r"\S+")


def _limits(answers: DataFrame) -> DataFrame:
    """(source, run_id, max_chars, max_bytes): storage limits; null where there is none."""
    lengths = (
        answers.where(F.col("chars") > 0)
        .select("source", "run_id", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("l"))
        .groupBy("source", "run_id", "l.unit", "l.length")
        .agg(F.count("*").alias("n"))
    )
    top = lengths.groupBy("source", "run_id", "unit").agg(F.max("length").alias("top"))
    near = (F.col("length") < F.col("top")) & (F.col("length") >= F.col("top") * 0.8)
    counts = (
        lengths.alias("l").join(top.alias("t"), F.expr("l.source = t.source and l.run_id <=> t.run_id and l.unit = t.unit"))
        .groupBy("t.source", "t.run_id", "t.unit", "t.top")
        .agg(F.sum(F.when(F.col("length") == F.col("top"), F.col("n")).otherwise(0)).alias("at"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near"))
    )
    spiked = counts.where((F.col("at") >= LIMIT_TEXTS) & (F.col("at") >= LIMIT_TIMES * F.col("near") / (F.col("top") * 0.2)))
    return spiked.groupBy("source", "run_id").pivot("unit", ["chars", "bytes"]).agg(F.max("top")).withColumnsRenamed({"chars": "max_chars", "bytes": "max_bytes"})


def _unclosed() -> Column:
    """How a text that doesn't end like a whole one ends; null for the others."""
    return F.when(F.col("ellipsis"), "dots").when(~F.col("ending").isin("", "mark"), "bare")


def _at(unit: str) -> Column:
    return F.concat_ws(" ", F.lit(unit), _unclosed(), F.col(unit).cast("string"))


def _spikes(answers: DataFrame) -> DataFrame:
    """(source, run_id, spikes): the lengths, of any size, that unusually many different unclosed texts of a run share.

    Whole answers end in lists and signatures of like lengths, so these are no sign of a limit, but can be cut by one.
    """
    seen = answers.withColumn("how", _unclosed()).where("how is not null and (ellipsis or ending in ('bare', 'marker'))")
    texts = seen.select("source", "run_id", "th", "how", "ellipsis", "ending", "chars", "bytes").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length"), _at(u).alias("at")) for u in ("chars", "bytes")]))
    counts = texts.select("source", "run_id", "how", each.alias("l")).groupBy("source", "run_id", "how", "l.unit", "l.length", "l.at").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "run_id", "how", "unit").orderBy("length").rangeBetween(-LIMIT_NEAR, LIMIT_NEAR)
    lengths = F.least(F.col("length") - 1, F.lit(LIMIT_NEAR)) + LIMIT_NEAR
    mean = F.greatest(F.sum("n").over(near) - F.col("n"), F.lit(1)) / lengths
    odds = F.col("n") * F.log(F.col("n") / F.col("mean")) - F.col("n") + F.col("mean")
    spiked = counts.withColumn("mean", mean).where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.col("mean")) & (odds >= LIMIT_ODDS))
    return spiked.groupBy("source", "run_id").agg(F.collect_set("at").alias("spikes"))


def _tokens_by_text(answers: DataFrame) -> tuple[Column, Column]:
    """The greatest and the usual number of tokens that a whole text of its languages and lengths has.

    Truncation lengthens only the upper tail of tokens per character, so the upper end of whole answers is taken from the
    lower one, mirrored at the median. A language with too few answers gets the greatest rate of its script's kin.
    """
    total = F.aggregate("languages", F.lit(0), lambda a, x: a + x)
    main = F.array_position("languages", F.array_max("languages")).cast("int")
    whole = answers.where((F.col("ending") == "mark") & ~F.col("ellipsis") & ~F.col("open") & ~F.col("broken") & (F.col("chars") >= MEASURED_CHARS))
    whole = whole.where((F.col("num_tokens") > 0) & F.coalesce(F.col("num_tokens") < F.col("max_tokens"), F.lit(True)))
    pure = whole.where(F.array_max("languages") >= 0.98 * total).groupBy(main.alias("i"))
    rates = pure.agg(F.count("*").alias("n"), F.percentile_approx(F.col("num_tokens") / F.col("chars"), F.lit([0.005, 0.5]), 10_000).alias("q"))
    seen = [r for r in rates.collect() if r.n >= MEASURED]  # one row a language
    found, middle = {LANGUAGES[r.i - 1]: 2 * r.q[1] - r.q[0] for r in seen}, {LANGUAGES[r.i - 1]: r.q[1] for r in seen}
    latin = [found[x] for x in ("de", "en", "es", "fr") if x in found]
    spare = 1.1 * max(latin) if latin else 0.5
    rate = {x: found.get(x, spare if x in ("", "de", "en", "es", "fr") else 2.0) for x in LANGUAGES}
    rate[""] = max(rate[""], spare)
    most, usual = F.lit(1.0), F.lit(0.0)
    for i, x in enumerate(LANGUAGES):
        chars = F.get("languages", F.lit(i))
        most, usual = most + chars * F.lit(SLACK * rate[x]), usual + chars * F.lit(middle.get(x, rate[x]))
    return most, usual


def alike(a, b):
    """Whether a shared window stands at about the same place in two texts, given the words before it."""
    return min(a, b) + SHINGLE >= SIMILAR * (max(a, b) + SHINGLE)


def tail_of(short: str, long: str) -> str | None:
    """How a near-copy of the beginning of `long` ends early: "inside" a sentence, or with a "sentence"; None where it does not.

    The copy must hold SIMILAR of its own shingles in the longer text (containment: how much is missing doesn't matter). From
    each shingle that stands at about the same place in both, and from which `long` goes on longer, the texts are aligned, but for
    those that the next one follows at once. Where an alignment stops, the copy may have one word more: the beginning of the
    next one, or a mark in its place.
    """
    fa, fb = _folded(short), _folded(long)
    if len(fa) < SHINGLE or fa[-1] not in fb and fa[-2] not in fb:
        return None  # no alignment reaches the end
    there = _where(long)
    ga = list(_shingles(fa))
    own = set(ga)
    if len(own & there.keys()) < SIMILAR * len(own):
        return None
    found = None
    before: set[int] = set()  # how far apart the places of the shingle behind are
    for i in reversed(range(len(ga))):
        apart = {j - i for j in there.get(ga[i], ()) if alike(i, j) and len(fb) - j > len(fa) - i}
        for d in apart - before:
            how = _stop(long, fa, fb, i, i + d)
            if how == "inside":
                return how
            found = found or how
        before = apart
    return found


@lru_cache(maxsize=64)
def _folded(text: str) -> list[str]:
    return [w for t in text.casefold().split() if (w := t.strip(EDGE))]


def _shingles(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[k:] for k in range(SHINGLE)), strict=False)


@lru_cache(maxsize=8)
def _where(text: str) -> dict[tuple[str, ...], list[int]]:
    """The places of each shingle."""
    out: dict[tuple[str, ...], list[int]] = {}
    for j, g in enumerate(_shingles(_folded(text))):
        out.setdefault(g, []).append(j)
    return out


def _stop(long: str, fa: list[str], fb: list[str], at: int, there: int) -> str | None:
    """How the copy's words fa end early if its place `at` is the place `there` of the longer text's words fb; see tail_of."""
    ta, tb = fa[at:], fb[there : there + len(fa) - at + SHINGLE * 4]
    if ta[-1] not in tb and ta[-2] not in tb:
        return None  # no alignment reaches the end
    end_a = end_b = 0
    for i, j, n in SequenceMatcher(None, ta, tb, autojunk=False).get_matching_blocks():
        if n:
            end_a, end_b = i + n, j + n
    rest, stop = ta[end_a:], there + end_b
    if len(rest) > 1 or stop >= len(fb) or not end_b:
        return None
    if rest:
        return "inside" if fb[stop].startswith(rest[0]) else None
    b = [m.start() for m in _TOKEN.finditer(long) if m.group().strip(EDGE)]
    gap = long[b[stop - 1] : b[stop]]
    return "sentence" if "\n" in gap or gap.rstrip()[-1] in ".!?。…:;”»)`\"" else "inside"


def spare(held: np.ndarray) -> np.ndarray:
    """How many of its `held` shingles a near-copy may have that the longer text lacks."""
    return held - np.ceil(SIMILAR * held - 1e-9).astype(held.dtype)


def _sketches(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text SKETCH words of 64 bits, with a bit set for each shingle."""
    out = np.zeros((len(sizes), SKETCH), np.uint64)
    bit = grams.view("u4") % np.uint32(64 * SKETCH)
    has = np.flatnonzero(sizes)
    if len(has):
        for k in range(SKETCH):
            one = np.where(bit >> 6 == k, np.uint64(1) << (bit & np.uint32(63)).astype(np.uint64), np.uint64(0))
            out[has, k] = np.bitwise_or.reduceat(one, (np.cumsum(sizes) - sizes)[has])
    return out.view("int64")


def _slots(grams: np.ndarray) -> np.ndarray:
    return grams & ((1 << SLOT_BITS) - 1)


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b["grams"].flatten().to_numpy(), b["grams"].value_lengths().to_numpy()


def _pack(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Counts by slot as blocks of BLOCK slots, with a gap and a count for each slot that has any; see _unpack."""
    blocks, packed = [], []
    for k, part in enumerate(counts.reshape(-1, BLOCK)):
        slot = np.flatnonzero(part)
        if len(slot):
            blocks.append(k)
            packed.append(zlib.compress(np.diff(slot, prepend=0).astype(np.uint16).tobytes() + part[slot].tobytes(), 1))
    return blocks, packed


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a block that have any, from its first one on, and their counts."""
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.int64), np.frombuffer(raw, np.int32, n, 2 * n)


def _by_slot(marks: DataFrame, grams_of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots, block by block, and how many of the shingles that grams_of gives of marks' batches have them."""
    schema = "block int, packed binary"

    def batch(blocks: list[int], packed: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLOT_BITS, np.int32)
        for b in batches:
            slot, n = np.unique(_slots(grams_of(b)), return_counts=True)
            seen[slot] += n.astype(np.int32)
        yield batch(*_pack(seen))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b["block"].to_pylist(), b["packed"].to_pylist(), strict=True):
                slot, n = _unpack(p)
                total.setdefault(k, np.zeros(BLOCK, np.int32))[slot] += n
        for k, n in total.items():
            yield batch([k], _pack(n)[1])

    table = marks.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    for k, p in zip(table["block"].to_pylist(), table["packed"], strict=True):
        slot, n = _unpack(p.as_py())
        yield slot + k * BLOCK, n


def _met(docs: dict[str, np.ndarray], g: np.ndarray, asks: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (asking, answering) of places in docs that share an asked shingle and may have SIMILAR of them in common.

    docs: held, sketch, n (how many of the rows that g and asks are of is a text's). Each pair comes once, but for those of
    more than MET_PAIRS pairs.
    """
    order = np.argsort(g, kind="stable")
    g, asks, doc = g[order], asks[order], np.repeat(np.arange(len(docs["n"])), docs["n"])[order]
    held, sketch, may = docs["held"], docs["sketch"], spare(docs["held"])
    short = doc[asks]
    first = np.searchsorted(g, g[asks])
    times = np.searchsorted(g, g[asks], "right") - first
    upto = np.cumsum(times)
    found: list[np.ndarray] = []
    at = 0
    while at < len(short):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - times[at] + JOIN_PAIRS, "right")))
        t = times[at:to]
        a = np.repeat(short[at:to], t)
        b = doc[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(first[at:to], t)]
        keep = (a != b) & (held[b] >= held[a] - may[a])
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(sketch[a] & ~sketch[b]).sum(1) <= may[a]
        found.append(np.unique(a[keep] * len(held) + b[keep]))
        at = to
        if at == len(short) or sum(map(len, found)) > MET_PAIRS:
            yield np.stack(np.divmod(np.unique(np.concatenate(found)), len(held)))
            found = []


def _containing(marks: DataFrame) -> DataFrame:
    """(th, long), written: each asking text beside all others that may have SIMILAR of its shingles.

    marks: th, grams, held, asks. A text that has so many can lack no more than spare(held) of them, so of any spare(held) + 1
    it has one; each asking text asks for that many of its rarest. No pair is missed, whatever is counted as rare: texts are
    counted by SLOT_BITS of the hash, in a table of fixed size, which can only be too many. Pairs whose sketches tell that
    more shingles are lacking drop out before they are written.

    What a text asks for is among what it answers, so both are one row. Rows go to parts by their shingles; a text's hash and
    sketch go to each of these parts once for all its rows there.
    """
    spark = marks.sparkSession
    marks = marks.select("th", "grams", "held", "asks")
    # a table of 2^SLOT_BITS bytes: sixteen times the logarithm, 0 for one text alone
    codes = np.zeros(1 << SLOT_BITS, np.uint8)
    for slot, n in _by_slot(marks, lambda b: _lists(b)[0]):
        codes[slot] = np.minimum(np.ceil(16 * np.log2(n)), 255)
    rarity = spark.sparkContext.broadcast(codes)

    def asked_of(b: pa.RecordBatch) -> np.ndarray:
        """Whether a text asks for a shingle, for all of them."""
        grams, sizes = _lists(b)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        code = rarity.value[_slots(grams)]
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros(len(doc), bool)
        out[np.lexsort((code, doc))[rank <= spare(b["held"].to_numpy())[doc]]] = True  # the order goes through the texts as doc does
        return out & (code > 0) & b["asks"].to_numpy(zero_copy_only=False)[doc]

    asked = np.zeros(1 << SLOT_BITS, bool)
    for slot, _ in _by_slot(marks, lambda b: _lists(b)[0][asked_of(b)]):
        asked[slot] = True
    rows = np.bincount(codes[asked], minlength=256) @ 2 ** (np.arange(256) / 16)  # somewhat more than there are
    parts = int(rows) // RANGE_ROWS + 1
    wanted = spark.sparkContext.broadcast(np.packbits(asked))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_asked = np.unpackbits(wanted.value).view(bool)
        for b in batches:
            grams, sizes = _lists(b)
            th, held, sketch, asks = b["th"].to_numpy(), b["held"].to_numpy(), _sketches(grams, sizes), asked_of(b)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            i = np.flatnonzero(is_asked[_slots(grams)])
            part = (grams[i].view("u4") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")  # texts stay together
            i, part = i[order], part[order]
            out: list[tuple] = []
            for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(part)) + 1) if len(i) else []:
                own, n = np.unique(doc[i[k]], return_counts=True)
                cols = th[own], held[own], sketch[own], n.astype(np.int32), grams[i[k]], asks[i[k]]
                out.append((int(part[k[0]]), *(x.tobytes() for x in cols)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if c else pa.int32()) for c, x in enumerate(zip(*out, strict=True))], names=list(_PART))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        col = {c: np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in got for x in b[c]]) for c, kind in _PART.items() if kind}
        col["sketch"] = col["sketch"].reshape(-1, SKETCH)
        one = np.zeros(len(col["th"]), bool)
        one[np.unique(col["th"], return_index=True)[1]] = True  # of a text that several tasks have read
        own = np.repeat(one, col["n"])
        docs = {c: col[c][one] for c in ("th", "held", "sketch", "n")}
        for a, b in _met(docs, col["g"][own], col["asks"][own]):
            yield pa.record_batch([pa.array(docs["th"][a]), pa.array(docs["th"][b])], names=["th", "long"])

    sent = marks.mapInArrow(answer, ", ".join(f"{c} {'binary' if kind else 'int'}" for c, kind in _PART.items()))
    return materialise(sent.repartitionById(parts, "part").mapInArrow(join, "th bigint, long bigint").distinct())


def _longer_copies(answers: DataFrame, rows: DataFrame, others: DataFrame | None) -> DataFrame:
    """(th, copied: inside or sentence, copy_chars): texts of which a longer near-copy goes on where they end, and the least
    length of such a copy."""
    ship(rows.sparkSession)
    marks = answers.where("grams is not null").select("th", "grams", "held", F.lit(True).alias("asks"))
    texts = rows.select(text_hash().alias("th"), "text")
    if others is not None:
        more = others.select(text_hash().alias("th"), "text").where("th is not null")
        fresh = more.select("th").distinct().join(answers.select("th").distinct(), "th", "left_anti")
        more = materialise(more.join(F.broadcast(fresh) if small_enough(fresh, BROADCAST_TEXTS) else fresh, "th", "left_semi"))
        marks = marks.unionByName(materialise(read_grams(more.dropDuplicates(["th"]))).where("grams is not null").withColumn("asks", F.lit(False)))
        texts = texts.unionByName(more)
    pairs = _containing(marks)

    def fetched(th: str) -> DataFrame:
        wanted = pairs.select(F.col(th).alias("th")).distinct()
        if small_enough(wanted, BROADCAST_TEXTS):
            wanted = F.broadcast(wanted)
        return texts.join(wanted, "th", "left_semi").groupBy("th").agg(F.max("text").alias("text"))

    longer = fetched("long").select(F.col("th").alias("long"), F.col("text").alias("other"))
    both = pairs.join(fetched("th"), "th").join(longer, "long").select("th", "text", "other")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tails = [tail_of(t, o) for t, o in zip(b["text"], b["other"], strict=True)]
            yield b.assign(copied=tails, copy_chars=b["other"].str.len())[["th", "copied", "copy_chars"]].dropna(subset=["copied"])

    found = both.mapInPandas(check, "th bigint, copied string, copy_chars bigint")
    return found.groupBy("th").agg(F.min("copied").alias("copied"), F.min("copy_chars").alias("copy_chars"))


def _terminality(kind: str) -> Column:
    """Share of the places of a word, in lines of a kind, in which it closes the line; smoothed towards the usual share of
    that kind of line, which for function words is none."""
    ends, inside = (F.coalesce(f"{kind}_{k}", F.lit(0)) for k in ("end", "in"))
    usual = F.when(F.col("word").isin(*_FUNCTION_WORDS), 0.0).otherwise(F.col(f"usual_{kind}"))
    return (ends + SMOOTH * usual) / (ends + inside + SMOOTH)


def judged(rows: DataFrame, hints: bool = False, others: DataFrame | None = None) -> DataFrame:
    """rows' answers as (source, ordinal, run_id, truncated, evidence, hint). See truncated() for rows and cases."""
    feats = materialise(read_answers(rows, hints))
    answers = feats.where("kind = 0").drop(*PLACES)
    places = feats.where("kind = 1").groupBy(F.col("last_word").alias("word")).agg(*[F.sum(p).alias(p) for p in PLACES])
    usual = places.agg(*[F.coalesce(F.try_divide(F.sum(f"{k}_end"), F.sum(F.col(f"{k}_end") + F.col(f"{k}_in"))), F.lit(0.0)).alias(f"usual_{k}") for k in ("item", "signed", "prose")])
    cut = _longer_copies(answers, rows, others)
    most, usual_tokens = _tokens_by_text(answers)
    closed = (F.col("ending") == "mark") & ~F.col("ellipsis")
    spent = F.col("num_tokens") > F.when(closed, most * CLOSED_SLACK).otherwise(most)

    at_limit = F.coalesce(F.col("chars") == F.col("max_chars"), F.lit(False)) | F.coalesce(F.col("bytes") == F.col("max_bytes"), F.lit(False))
    at_spike = _unclosed().isNotNull() & F.coalesce(F.array_contains("spikes", _at("chars")) | F.array_contains("spikes", _at("bytes")), F.lit(False))
    fits = closed & F.coalesce(F.col("num_tokens") <= most, F.lit(False))
    # a copy that ends with a sentence may just have one less; its tokens tell, if they are rather those of the longer text
    between = usual_tokens * (1 + F.try_divide("copy_chars", "chars")) / 2
    copied = (F.col("copied") == "inside") | (F.col("copied") == "sentence") & (F.col("num_tokens") > between)
    evidence = (
        F.when(F.col("ending") == "", None)
        .when(copied, "longer copy")
        .when(F.col("terminality") < TERMINAL, "closing word")
        .when(F.col("broken"), "replacement character")
        .when(F.col("open"), "open mark")
        .when(F.col("num_tokens") >= F.col("max_tokens"), "all tokens used")
        .when(at_spike | at_limit & ~fits, "storage limit")
        .when(spent, "more tokens than text")
    )
    greatest, spikes = _limits(answers).alias("g"), _spikes(answers).alias("s")
    limited = greatest.join(spikes, F.expr("g.source = s.source and g.run_id <=> s.run_id"), "full").select(
        F.coalesce("g.source", "s.source").alias("source"), F.coalesce("g.run_id", "s.run_id").alias("run_id"), "max_chars", "max_bytes", "spikes"
    )
    limited = materialise(limited)
    limits = F.broadcast(limited) if small_enough(limited, 100_000) else limited
    out = (
        answers.drop("grams", "held", "kind").alias("a")
        .join(limits.alias("l"), F.expr("a.source = l.source and a.run_id <=> l.run_id"), "left")
        .select("a.*", "max_chars", "max_bytes", "spikes")
        .join(cut, "th", "left")
    )
    # closing words are looked up for what doesn't end with a mark, or ends with dots, and isn't the question's own words
    asked = (F.col("ending").isin("bare", "list", "signature") | F.col("ellipsis")) & ~F.col("echo") & (F.col("last_word") != "")
    looked = out.withColumn("word", F.when(asked, F.col("last_word")))
    marker = F.when((F.col("ending") == "marker") & ~F.col("echo"), 0.0)  # a list marker closes nothing
    plain = looked.where("word is null").withColumn("terminality", marker.cast("double"))
    # a word that the corpus has nowhere else is a fragment, but for names, with which signatures end
    score = (
        F.when(F.col("ending") == "signature", _terminality("signed"))
        .when(~F.col("known"), 0.0)
        .when(F.col("ellipsis"), None)
        .when(F.col("ending") == "list", _terminality("item"))
        .otherwise(_terminality("prose"))
    )
    # a signature's own ending is among the counts
    own = {"signed_end": F.col("signed_end") - F.when(F.col("ending") == "signature", 1).otherwise(0)}
    held = looked.where("word is not null").join(places, "word", "left").crossJoin(F.broadcast(usual))  # usual: one row
    known = F.coalesce(reduce(lambda a, b: a + b, [F.col(p) for p in PLACES]) > 0, F.lit(False))
    found = held.withColumns(own).withColumn("known", known).withColumn("terminality", score).select(*plain.columns)
    both = plain.unionByName(found).withColumn("evidence", evidence)
    return both.select("source", "ordinal", "run_id", F.col("evidence").isNotNull().alias("truncated"), "evidence", "hint")


def truncated(rows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(source, ordinal, run_id, evidence) of each row whose text is cut.

    rows: source, ordinal (unique in a source), run_id, question, text, num_tokens, max_tokens; other columns are ignored.
    others: texts (column text) that aren't judged, but may be longer copies of those that are.
    Null, empty and blank texts are not cut. Null num_tokens, max_tokens, run_id or question leave out the evidence that
    needs them. Repeated texts are judged each. A text that breaks off inside its thinking section is cut. An empty table
    gives no rows.
    """
    return judged(rows, others=others).where("truncated").select("source", "ordinal", "run_id", "evidence")
