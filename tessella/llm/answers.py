"""One pass over stored answers: what truncation and defect detection need to know of each text.

Answers come as rows (source, ordinal, run_id, question, text, num_tokens, max_tokens). The pass is one Arrow-batched
function; every text is read whole and once. It gives a row per answer and, beside these, the words of the corpus with counts
of their places in list items, summed in the task before they are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.defects import defect_hint
from tessella.llm.language import LANGUAGES, language_chars
from tessella.llm.structure import LIST_ITEM, SIGNATURE, ending, open_parts
from tessella.session import ship, spread

#: Words of a shingle; shingles of a window, each of which is a band of its own.
SHINGLE, WINDOW = 5, 12
#: Texts of fewer words have no bands.
LEAST = 8
#: Shingles of the bands at a text's beginning, which short texts can meet in.
BEGINNINGS = (4, 8)
#: Bands of a text's end in which it looks for longer copies.
ASKED = 4
#: Words before a band's shingle that tell how far back two texts agree, by doubling; beyond, the whole beginning.
BACK = (4, 8, 16, 32, 64, 128)
#: Texts that are hashed at once.
AT_ONCE = 500
#: Different words whose counts a task holds before it passes them on.
HELD_WORDS = 300_000
#: Different texts that a task remembers, so that it gives the shingles of a repeated text once.
HELD_TEXTS = 1_000_000

_THINK = "</think>"
_ROW = (
    "kind int, source string, ordinal bigint, run_id string, num_tokens bigint, max_tokens bigint, th bigint, ending string, open boolean, broken boolean, ellipsis boolean, echo boolean, last_word string, "
    "chars bigint, bytes bigint, languages array<int>, hint string, grams array<int>, held int, "
    "item_end bigint, item_in bigint, signed_end bigint, signed_in bigint, prose_end bigint, prose_in bigint"
)
#: The columns of it that count words by place.
PLACES = ("item_end", "item_in", "signed_end", "signed_in", "prose_end", "prose_in")
_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()),
}
EDGE = ".,;:!?…\"“”«»()[]{}*#`>-—'’"
_P = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)  # modulo 2^64


def output_of(text: str) -> str | None:
    """The answer without its thinking section: what follows the first end tag; None if the text ends within the section."""
    at = text.find(_THINK)
    if at >= 0:
        return text[at + len(_THINK) :]
    return None if "<think>" in text else text


class Places:
    """Counts of words by their places: at the end of list items, of signatures and of other lines, and inside them.

    Lines that others follow are whole, so what stands at their ends are closing words. Of a text's last line, which may be
    cut, only the inner words count, but for signatures, which stand there: these count whole.
    """

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = {p: Counter() for p in PLACES}

    def add(self, text: str) -> str:
        """Takes in a text without trailing blanks; gives its last word."""
        lines = text.split("\n")
        last = lines.pop()
        inside, ends, item_in, item_end = self.counts["prose_in"], self.counts["prose_end"], self.counts["item_in"], self.counts["item_end"]
        for line in lines:
            toks = line.casefold().split()
            if not toks:
                continue
            if LIST_ITEM.match(line):
                item_end[toks[-1].strip(EDGE)] += 1
                item_in.update(toks[1:-1])
            else:
                if toks[-1][-1].isalnum():
                    ends[toks.pop()] += 1
                inside.update(toks)
        toks = last.casefold().split()
        if not toks:
            return ""
        word = toks[-1].strip(EDGE)
        if last.startswith(SIGNATURE):
            self.counts["signed_end"][word] += 1
            self.counts["signed_in"].update(toks[1:-1])
        elif not LIST_ITEM.match(last):
            inside.update(toks[:-1])
        else:
            item_in.update(toks[1:-1])
        return word

    def __len__(self) -> int:
        return sum(map(len, self.counts.values()))

    def take(self) -> dict[str, list]:
        """The counts so far, as columns, which are then forgotten."""
        stripped: dict[str, dict[str, int]] = {}
        for place, c in self.counts.items():
            for w, n in c.items():
                w = w.strip(EDGE)
                if w:
                    own = stripped.setdefault(w, {})
                    own[place] = own.get(place, 0) + n
            c.clear()
        return {"kind": [1] * len(stripped), "last_word": list(stripped)} | {p: [x.get(p, 0) for x in stripped.values()] for p in PLACES}


class Numbers(dict):
    """Word -> its hash, without the marks around it; found once and remembered."""

    def __missing__(self, w: str) -> int:
        import xxhash

        n = self[w] = xxhash.xxh64_intdigest(w.strip(EDGE).encode("utf-8", "surrogatepass"))
        return n

    def trim(self, most: int = 1_000_000) -> None:
        if len(self) > most:
            self.clear()


class Windows:
    """Bands of texts for containment: the min-hash of every window of WINDOW shingles of SHINGLE words.

    A cut copy shares the windows of all it has with its original, however much of that it lacks, so the bands at its end are
    bands inside the original. Windows that slide by one word mostly share their least shingle; each comes once. Beside it
    stands how the text went on before it (`near`, `far`: hashes of the last 4, 8, 16, ... words and of the whole
    beginning, longest last), so that in the order of (band, near, far) the texts that agree furthest back are neighbours, and
    how many words of the text are left from it on (`after`) and stand before it (`place`). A text's `sketch` has a bit of 64 for each of its bands, so that
    most of the bits of a cut copy are bits of its original.
    """

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.up, self.down = _powers(0x9E3779B97F4A7C15, 1), _powers(0, 1)

    def bands(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Columns sketch, bands, near, far, after, place, asks; null for texts of fewer than LEAST words. Texts go through in chunks whose
        arrays stay in the cache."""
        parts = [self._bands(texts[at : at + AT_ONCE]) for at in range(0, len(texts), AT_ONCE)] or [self._bands([])]
        return {k: pa.concat_arrays([p[k] for p in parts]) for k in parts[0]}

    def _bands(self, texts: list[str | None]) -> dict[str, pa.Array]:
        self.numbers.trim()
        number = self.numbers.__getitem__
        rows = [list(map(number, t.casefold().split())) if t else [] for t in texts]
        sizes = np.array([len(r) if len(r) >= LEAST else 0 for r in rows], dtype="int64")
        words = np.fromiter(chain.from_iterable(r for r in rows if len(r) >= LEAST), dtype=np.uint64, count=int(sizes.sum()))
        n = len(words)
        ends = np.cumsum(sizes)
        begin = np.repeat(ends - sizes, sizes)  # of each word, its text's first
        size = np.repeat(sizes, sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(n)
        h = np.zeros(n, dtype=np.uint64)
        wide = np.r_[words, np.zeros(SHINGLE, np.uint64)]
        for k in range(SHINGLE):
            h = (h ^ wide[k : k + n]) * _P
            h ^= h >> np.uint64(29)
        shingles = size - SHINGLE + 1
        h[at - begin >= shingles] = _MAX  # shingles across two texts
        # least hash of each window, and the shingles that are least in one
        one = np.r_[h, np.full(WINDOW, _MAX)]
        two = np.minimum(one[:-1], one[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        least = np.minimum(eight[:n], four[8 : 8 + n]) if n else h
        least = np.where(at - begin <= np.maximum(shingles - WINDOW, 0), least, np.uint64(0))
        one = np.r_[np.zeros(WINDOW, np.uint64), least]
        two = np.maximum(one[1:], one[:-1])
        four = np.maximum(two[2:], two[:-2])
        eight = np.maximum(four[4:], four[:-4])
        chosen = (np.maximum(eight[len(eight) - n :], four[len(four) - n - 8 : len(four) - 8]) == h) & (h != _MAX) if n else np.zeros(0, bool)
        for k in BEGINNINGS:
            first = np.flatnonzero((at == begin) & (shingles >= k))
            if len(first):
                held = np.stack([h[first + i] for i in range(k)]).argmin(0)
                chosen[first + held] = True
        i = np.flatnonzero(chosen)
        # hashes of the words before each
        if n + 1 > len(self.up):
            self.up, self.down = _powers(0x9E3779B97F4A7C15, 2 * n + 2), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), 2 * n + 2)
        summed = np.r_[np.uint64(0), np.cumsum(words * self.up[:n], dtype=np.uint64)]

        def before(k: int | None) -> np.ndarray:
            start = begin[i] if k is None else np.maximum(begin[i], i - k)
            x = (summed[i] - summed[start]) * self.down[start] * _P
            return (x ^ (x >> np.uint64(31))) * _P >> np.uint64(48)

        scales = [before(k) for k in (*BACK, None)]
        near = scales[0] << np.uint64(48) | scales[1] << np.uint64(32) | scales[2] << np.uint64(16) | scales[3]
        far = scales[4] << np.uint64(32) | scales[5] << np.uint64(16) | scales[6]
        after, place = (begin + size - at)[i].astype("int32"), (at - begin)[i].astype("int32")
        each = np.bincount(doc[i], minlength=len(texts))
        upto = np.cumsum(each)
        sketch = np.zeros(len(texts), np.uint64)
        if len(i):
            has = np.flatnonzero(each)
            sketch[has] = np.bitwise_or.reduceat(np.uint64(1) << (h[i] >> np.uint64(20) & np.uint64(63)), (upto - each)[has])
        asks = upto[doc[i]] - np.arange(len(i)) <= ASKED
        offsets = pa.array(np.r_[0, upto].astype("int32"))
        mask = pa.array(sizes == 0)
        return {"sketch": pa.array(sketch.view("int64"), mask=sizes == 0)} | {
            name: pa.ListArray.from_arrays(offsets, pa.array(v), mask=mask)
            for name, v in (("bands", h[i].view("int64")), ("near", near.view("int64")), ("far", far.view("int64")), ("after", after), ("place", place), ("asks", asks))
        }


def grams_of(texts: list[str | None], numbers: Numbers) -> dict[str, pa.Array]:
    """Columns grams, held: the different shingles of a text as hashes of 32 bits, and how many they are, told by 64 bits.

    Words are those of truncation.tail_of, without marks around them. Null for texts of fewer than LEAST words. Two shingles
    may have one hash; that only makes texts look more alike than they are.
    """
    none = numbers[""]
    numbers.trim()
    rows = [[x for x in map(numbers.__getitem__, t.casefold().split()) if x != none] if t else [] for t in texts]
    rows = [r if len(r) >= LEAST else [] for r in rows]
    sizes = np.array([len(r) for r in rows], dtype="int64")
    n = int(sizes.sum())
    words = np.r_[np.fromiter(chain.from_iterable(rows), dtype=np.uint64, count=n), np.zeros(SHINGLE, np.uint64)]
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ words[k : k + n]) * _P
        h ^= h >> np.uint64(29)
    doc = np.repeat(np.arange(len(rows)), sizes)
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= np.repeat(sizes, sizes) - SHINGLE
    h, doc = h[inside], doc[inside]

    def different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x, doc))
        x, d = x[order], doc[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])][: len(x)]
        return x[new], np.bincount(d[new], minlength=len(rows))

    _, held = different(h)
    grams, each = different((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
    mask = pa.array(sizes == 0, pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype("int32")), pa.array(grams, pa.int32()), mask=mask)
    return {"grams": lists, "held": pa.array(held.astype("int32"), mask=sizes == 0)}


def text_hash() -> Column:
    """Tells texts apart; null where there is none."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def read_answers(rows: DataFrame, hints: bool) -> DataFrame:
    """The features of every row, as rows of kind 0, and counts of words, as rows of kind 1.

    Kind 0: ending and open parts (see structure); broken: ends with a replacement character; ellipsis; echo: the words of
    the question and nothing else; last_word; chars and bytes; languages: characters by language; grams and held for near
    copies (see grams_of; of a repeated text only once in a task); hint: the defect other than truncation, if `hints` (see defects). Kind 1: every word
    (last_word), with partial counts of its PLACES. Null texts count as empty.
    """
    ship(rows.sparkSession)

    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _ROW.split(", "))])

    def batch(cols: dict[str, list | pa.Array], n: int) -> pa.RecordBatch:
        return pa.record_batch([x if isinstance(x := cols.get(f.name, [None] * n), pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

    def words_batch(places: Places) -> pa.RecordBatch:
        cols = places.take()
        return batch(cols, len(cols["kind"]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, places = Numbers(), Places()
        seen: set[int] = set()  # texts whose shingles this task has passed on
        for b in batches:
            cols: dict[str, list | pa.Array] = {k: [] for k in ("ending", "open", "broken", "ellipsis", "echo", "last_word", "chars", "bytes", "languages", "hint")}
            texts = b["text"].to_pylist()
            for t, q in zip(texts, b["question"].to_pylist(), strict=True):
                t = t or ""
                body = t.rstrip()
                out = output_of(t)
                at = t.find(_THINK)
                think, rest = (t[: at + len(_THINK)], t[at + len(_THINK) :]) if at >= 0 else ("", t)
                a, o = language_chars(think) if think else {}, language_chars(rest)
                cols["ending"].append(ending(t))
                cols["open"].append(bool(open_parts(t)) or "<think>" in t and at < 0)
                cols["broken"].append(body.endswith("\ufffd"))
                cols["ellipsis"].append(body.endswith(("...", "…", "...]", "…]", "(...)", "(…)")))
                hint, echo = defect_hint(q or "", out, o)
                cols["hint"].append(hint if hints else None)
                cols["echo"].append(echo)
                cols["last_word"].append(places.add(body))
                cols["chars"].append(len(t))
                cols["bytes"].append(len(t.encode("utf-8", "surrogatepass")))
                cols["languages"].append([a.get(x, 0) + o.get(x, 0) for x in LANGUAGES])
            own = {k: b[k] for k in ("source", "ordinal", "run_id", "num_tokens", "max_tokens", "th")}
            fresh: list[str | None] = []
            for t, th in zip(texts, b["th"].to_pylist(), strict=True):
                fresh.append(None if th in seen else t)
                seen.add(th)
            yield batch(cols | own | {"kind": [0] * len(texts)} | grams_of(fresh, numbers), len(texts))
            if len(seen) > HELD_TEXTS:
                seen.clear()
            if len(places) > HELD_WORDS:
                yield words_batch(places)
        yield words_batch(places)

    cols = ["source", "ordinal", "run_id", "question", "text", "num_tokens", "max_tokens"]
    return spread(rows.select(*cols).withColumn("th", text_hash())).mapInArrow(read, _ROW)


def read_grams(texts: DataFrame) -> DataFrame:
    """(th, grams, held) of texts (th, text) that are held against others but not judged."""
    ship(texts.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            cols = {"th": b["th"]} | grams_of(b["text"].to_pylist(), numbers)
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return texts.select("th", "text").mapInArrow(read, "th bigint, grams array<int>, held int")
