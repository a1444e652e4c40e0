"""Evaluation items that stand, wholly or in part, in documents: multi-pattern search in the manner of Wu and Manber.

The symbols are words (case, punctuation, markup, escapes and line breaks taken off), the patterns all windows of WINDOW
words of all items. A table tells for every block of two words how far from a window's end it stands nearest; a block that
no window has lets the search skip WINDOW - 1 words. Where the shift is none, the bucket of the block (the windows that end
with it) is searched by the window's first words, and the words are compared. Hits that lie on nearly one diagonal of
document and item mark a region, in which the two texts are aligned word by word. Passages are runs of agreeing words with
at most GAP changed, missing or added words between them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialise, ship, spread

#: Words in a pattern, and in the blocks of the shift table.
WINDOW, BLOCK = 4, 2
#: Words that may differ in a row inside a passage, on either side.
GAP = 3
#: Words of the shortest passage that counts, and of all passages of an item in a document together.
PASSAGE, TOTAL = 12, 20
#: Share of a passage's words that must agree.
AGREE = 0.8
#: Characters of item text in a block of items, on average; one block's tables are broadcast at a time.
BLOCK_CHARS = 20_000_000

_INVISIBLE = {ord(c): None for c in "­​‌‍⁠﻿"}
_NOISE = re.compile(r"</?[A-Za-z!][^<>]*>|&#?\w{1,8};|\\+[nrt]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The text's words, without case, punctuation, tags, character references, escapes and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(_NOISE.sub(" ", text).casefold())


class Patterns:
    """Shift table and buckets of one block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, words(t)) for i, t in items if t]
        self.vocabularies = [frozenset(w) for _, w in self.items]
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for n, (_, w) in enumerate(self.items):
            for at in range(len(w) - WINDOW + 1):
                for k in range(WINDOW - BLOCK + 1):  # blocks of the window, by their distance from its end
                    block, far = (w[at + k], w[at + k + 1]), WINDOW - BLOCK - k
                    if far < self.shift.get(block, WINDOW):
                        self.shift[block] = far
                last = (w[at + WINDOW - 2], w[at + WINDOW - 1])
                self.bucket.setdefault(last, {}).setdefault(tuple(w[at : at + WINDOW - BLOCK]), []).append((n, at))

    def hits(self, doc: list[str]) -> dict[int, list[tuple[int, int]]]:
        """By item: places (in document, in item) where a window stands."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        shift, none, end, last = self.shift.get, WINDOW - BLOCK + 1, WINDOW - 1, len(doc)
        while end < last:
            block = (doc[end - 1], doc[end])
            far = shift(block, none)
            if far:
                end += far
                continue
            for n, at in self.bucket[block].get(tuple(doc[end - WINDOW + 1 : end - 1]), ()):
                found[n].append((end - WINDOW + 1, at))
            end += 1
        return found

    def passages(self, doc: list[str], n: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Passages of item n in the document: begin, end, agreeing words. hits must be in order."""
        item = self.items[n][1]
        regions: list[list[int]] = []  # begin and end in the document, begin and end in the item, the last diagonal
        near: list[list[int]] = []  # those that a hit can still belong to
        for d, i in hits:
            near = [r for r in near if d - r[1] <= PASSAGE]
            for r in reversed(near):
                if abs(d - i - r[4]) <= GAP:
                    r[1], r[2], r[3], r[4] = d + WINDOW, min(r[2], i), max(r[3], i + WINDOW), d - i
                    break
            else:
                near.append([d, d + WINDOW, i, i + WINDOW, d - i])
                regions.append(near[-1])
        found: list[tuple[int, int, int]] = []
        end = 0
        for a, b, i, j, _ in regions:
            a, b, i, j = max(end, a - PASSAGE), b + PASSAGE, max(0, i - PASSAGE), j + PASSAGE
            # no more words can agree than occur in both, in order; most hits are chance and end here
            if sum(map(self.vocabularies[n].__contains__, doc[a:b])) < AGREE * PASSAGE or in_order(doc[a:b], item[i:j]) < AGREE * PASSAGE:
                continue
            run: list[tuple[int, int, int]] = []
            for x, y, size in [*SequenceMatcher(None, doc[a:b], item[i:j], autojunk=False).get_matching_blocks()[:-1], (1 << 40, 1 << 40, 0)]:
                if run and (x - run[-1][0] - run[-1][2] > GAP or y - run[-1][1] - run[-1][2] > GAP):
                    for begin, stop, same in agreeing([(p, p + s) for p, _, s in run]):
                        found.append((a + begin, a + stop, same))
                        end = a + stop
                    run = []
                run.append((x, y, size))
        return found

    def search(self, doc: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """By item: its passages in the document."""
        return {n: p for n, h in self.hits(doc).items() if (p := self.passages(doc, n, h))}

    def leaked(self, text: str) -> list[int]:
        """Ids of the items that the text holds, if these are all items there are; see held()."""
        found = [(self.items[n][0], *p) for n, own in self.search(words(text)).items() for p in own]
        return held(found)


def in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of whole numbers: a step for each word of a."""
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    full = free = (1 << len(b)) - 1
    for w in a:
        m = places.get(w)
        if m:
            u = free & m
            free = (free + u | free - u) & full
    return len(b) - free.bit_count()


def agreeing(run: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Of a run of agreeing stretches (begin, end), in order, the longest part that begins and ends with one and of whose words
    AGREE agree, if it has PASSAGE words, and such parts of what is left on either side: (begin, end, agreeing words).

    So chance matches near a passage don't spoil it. The longest part is found by sums of what each word adds to agreement,
    against the smallest sums before it.
    """
    todo, out = [run], []
    while todo:
        own = todo.pop()
        if not own or own[-1][1] - own[0][0] < PASSAGE:
            continue
        total, last = 0.0, own[0][0]
        starts: list[tuple[float, int]] = []  # sums before stretches, falling
        best = (0, 0, 0)
        for k, (a, b) in enumerate(own):
            total -= AGREE * (a - last)
            if not starts or total < starts[-1][0]:
                starts.append((total, k))
            total += (1 - AGREE) * (b - a)
            last = b
            lo, hi = 0, len(starts)
            while lo < hi:  # the earliest start from which the sum isn't negative
                mid = (lo + hi) // 2
                if starts[mid][0] <= total + 1e-9:
                    hi = mid
                else:
                    lo = mid + 1
            if lo < len(starts) and b - own[starts[lo][1]][0] > best[0]:
                best = (b - own[starts[lo][1]][0], starts[lo][1], k)
        length, i, k = best
        if length >= PASSAGE:
            out.append((own[i][0], own[k][1], sum(b - a for a, b in own[i : k + 1])))
            todo += [own[:i], own[k + 1 :]]
    return sorted(out)


def held(found: list[tuple]) -> list:
    """Ids of the items that a document holds at least TOTAL words of, from its passages (id, begin, end, agreeing words).

    Items share phrases; a passage that lies, by half or more, in one of another item with more agreeing words belongs to that
    one. All items' passages must be there, so the result doesn't depend on how the items were dealt into blocks. Passages
    are gone over by place, so each is held against those that it overlaps.
    """
    by_begin = sorted(found, key=lambda p: p[1])
    reach = max((p[2] - p[1] for p in found), default=0)
    begins = [p[1] for p in by_begin]
    length: dict = {}
    for i, begin, end, same in found:
        others = by_begin[bisect_left(begins, begin - reach) : bisect_left(begins, end)]
        if not any(j != i and n > same and min(end, e) - max(begin, b) >= (end - begin) // 2 for j, b, e, n in others):
            length[i] = length.get(i, 0) + end - begin
    return [i for i, n in length.items() if n >= TOTAL]


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """Blocks of (id, text), one after the other; each is fetched when it is asked for."""
    own = items.where(F.col(text).isNotNull())
    chars = own.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        yield [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64(item_id, text), F.lit(n)) == k).select(item_id, text).collect()]  # about block_chars


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) for each document that holds passages of the item, together at least TOTAL words.

    Whole texts are searched. The items are the stated query set: they are taken in blocks of about `block_chars`
    characters, whose tables are broadcast, and each block is searched in one pass over the documents. With several blocks the
    passages are written, the block is let go before the next is fetched, and which item a passage belongs to is settled by
    document when all are there. Null, empty and wordless texts hold nothing; items of fewer than WINDOW words are never
    found; items with the same text are each reported; repeated document rows come out once. Empty tables give no rows; other
    columns are ignored.

    Any 16 words of which AGREE agree have WINDOW agreeing words in a row, so no passage is missed by its windows.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}"
    spans = f"`{doc_id}` {kinds[0]}, th bigint, `{item_id}` {kinds[1]}, `begin` int, `end` int, same int"
    names = [doc_id, "th", item_id, "begin", "end", "same"]
    rows = spread(docs.select(F.col(doc_id), F.col(text)).where(F.col(text).isNotNull()))
    found: list[DataFrame] = []
    blocks = item_blocks(items, item_id, text, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    alone = following is None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        built: dict[str, Patterns] = {}

        def search(batches: Iterator[pd.DataFrame], shared=shared, built=built) -> Iterator[pd.DataFrame]:
            patterns = built.setdefault("p", Patterns(shared.value)) if "p" not in built else built["p"]
            for b in batches:
                if alone:
                    out = [(d, i) for d, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for i in patterns.leaked(t)]
                    yield pd.DataFrame(out, columns=[doc_id, item_id])
                    continue
                out = [(d, h, patterns.items[n][0], *p) for d, h, t in b.itertuples(index=False) for n, own in patterns.search(words(t)).items() for p in own]
                yield pd.DataFrame(out, columns=names)

        if alone:
            return rows.mapInPandas(search, schema).distinct()
        found.append(materialise(rows.select(doc_id, F.xxhash64(text).alias("th"), text).mapInPandas(search, spans)))
        shared.destroy()
        block, following = following, next(blocks, None)
    if not found:
        return spark.createDataFrame([], schema)

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        ids = held(list(f[names[2:]].itertuples(index=False, name=None)))
        return pd.DataFrame({doc_id: f[doc_id].iloc[:1].repeat(len(ids)), item_id: ids})

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.distinct().groupBy(doc_id, "th").applyInPandas(settle, schema).distinct()  # a group: one document's passages
