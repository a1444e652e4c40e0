"""Subjects of documents: complement naive Bayes, refined by expectation-maximisation, with calibrated posteriors.

The unit is the sentence (a message, a line of a prompt file): its features are hashed words and word pairs. The classes are
the subjects and "none" (small talk, idioms, noise). Weights are those of complement naive Bayes: how much likelier a feature
is overall than outside the class. They are learned from labelled documents first, whose sentences share the document's
labels; then all documents, labelled or not, are gone over in turn: sentences get posteriors under the weights and their
document's mixture (expectation), and the weights are learned anew from them (maximisation). Labelled documents kept out of
training calibrate, for each subject on its own, the posterior that a sentence with a given margin over "none" is about it.
A sentence bears a subject if its best subject has a posterior of one half; a document has the subjects of at least a third
of such sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.leakage import BLOCK_CHARS, WINDOW, Patterns, item_blocks, words
from tessella.session import materialise, ship, small_enough, spread

#: Hashed features; smoothing of their counts; rounds of expectation-maximisation.
FEATURES, SMOOTHING, ROUNDS = 1 << 18, 0.3, 3
#: Weight of "none" for the sentences of a labelled document, and trust in its labels.
NONE, TRUST = 0.2, 0.95
#: One labelled document in so many is kept out of training for calibration.
HELD_OUT = 5
#: Share of a document's subject-bearing sentences, least number of them, and most subjects.
SHARE, SENTENCES, MOST = 1 / 3, 2, 2
#: Labelled documents (about 100 bytes each) whose labels are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 500_000
#: Different sentences that a task remembers.
REMEMBERED = 200_000
#: Features worked on at once in a task.
CHUNK = 500_000

_SENTENCE = re.compile(r"(?<=[.!?。…])[\"”»)’]*\s+")
_LINE = re.compile(r"\n+|(?:\\n)+|\",\s*\"(?!\w+\":)")
_SPEAKER = re.compile(r"\s*(?:\[\w{1,12}\] |[<>]{2} |[^:.!?\n“\"{]{1,60}: (?=[A-ZÀ-Þ¿¡“«0-9А-Я぀-鿿]))")
_ROLE = re.compile(r"\s*System: ")


def sentences(text: str) -> list[str]:
    """Sentences of a text, without speakers' names and without role instructions.

    A line that ends with a question of at most two sentences, or that is a record, stays whole: it is one question.
    """
    out: list[str] = []
    for line in _LINE.split(text):
        if not line or _ROLE.match(line):
            continue
        if m := _SPEAKER.match(line):
            line = line[m.end() :]
        parts = [s for s in _SENTENCE.split(line) if s]
        end = line.rstrip()[-1:]
        if line.lstrip().startswith('{"') or len(parts) == 2 and (end == "?" or parts[0].endswith("?") and parts[0].count(" ") < 6):
            out.append(line)
        else:
            out += parts
    return out


class Numbers(dict):
    """Word -> its hash, found once and remembered."""

    def __missing__(self, w: str) -> int:
        import xxhash

        n = self[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
        return n


class Featuriser:
    """Hashed words and word pairs of a text's sentences.

    Sentences come again and again in a corpus, so their words and features are remembered, up to REMEMBERED of them.
    """

    def __init__(self, patterns: Patterns | None = None) -> None:
        self.patterns = patterns
        self.numbers = Numbers()
        self.seen: dict[str, tuple[list[str], list[int]]] = {}

    def _features(self, w: list[str]) -> list[int]:
        if len(self.numbers) > 2_000_000:
            self.numbers.clear()
        n = list(map(self.numbers.__getitem__, w))
        # a pair's number is mixed from its words' numbers, so that no strings are made for pairs
        return [x % FEATURES for x in n] + [((a * 0x9E3779B1 ^ b) * 0x85EBCA6B >> 21) % FEATURES for a, b in zip(n, n[1:])]

    def split(self, text: str) -> list[tuple[list[str], list[int]]]:
        """(words, features) of each sentence."""
        out = []
        for s in sentences(text):
            own = self.seen.get(s)
            if own is None:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                w = words(s)
                own = self.seen[s] = w, self._features(w)
            out.append(own)
        return out

    def covered(self, each: list[tuple[list[str], list[int]]]) -> set[int]:
        """Places of the words, of all sentences one after the other, that lie in passages of excluded texts.

        These share phrases, so the one with the most windows in the document goes first, and one whose windows all lie in
        passages already found is not aligned any more.
        """
        shut: set[int] = set()
        if not self.patterns:
            return shut
        doc = [x for w, _ in each for x in w]
        hits = self.patterns.hits(doc)
        for n in sorted(hits, key=lambda n: (-len(hits[n]), n)):
            if not all(d in shut and d + WINDOW - 1 in shut for d, _ in hits[n]):
                for begin, end, _ in self.patterns.passages(doc, n, hits[n]):
                    shut.update(range(begin, end))
        return shut

    def __call__(self, text: str, shut: set[int] | None = None) -> list[list[int]]:
        """Features of the sentences with two words or more besides those at the places `shut`, by default covered()."""
        each = self.split(text)
        shut = self.covered(each) if shut is None else shut
        if not shut:
            return [f for w, f in each if len(w) >= 2]
        out, at = [], 0
        for w, f in each:
            if shut.isdisjoint(range(at, at + len(w))):
                left = f if len(w) >= 2 else None
            else:
                rest = [x for k, x in enumerate(w, at) if k not in shut]
                left = self._features(rest) if len(rest) >= 2 else None
            at += len(w)
            if left is not None:
                out.append(left)
        return out


def features(docs: DataFrame, doc_id: str, text: str, excluded: DataFrame | None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, lengths, feats): the features of a document's sentences, one after the other, and how many each has.

    Words in passages of excluded texts are left out. These texts are taken in blocks of about block_chars characters; with
    more than one, each is searched in a pass of its own, which adds the places that it covers.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[doc_id]
    blocks = item_blocks(excluded.select(F.lit(0).alias("i"), F.col(excluded.columns[0]).alias("t")), "i", "t", block_chars) if excluded is not None else iter(())
    block, following = next(blocks, []), next(blocks, None)
    rows = spread(docs.select(F.col(doc_id), F.col(text).alias("text"))).withColumn("shut", F.lit(None).cast("array<int>"))
    while following is not None:
        shared = spark.sparkContext.broadcast(block)

        def cover(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            f = Featuriser(Patterns(shared.value))
            for b in batches:
                shut = [sorted({*(old or ()), *f.covered(f.split(t))}) if t else None for t, old in zip(b[1].to_pylist(), b[2].to_pylist(), strict=True)]
                yield pa.record_batch([b[0], b[1], pa.array(shut, pa.list_(pa.int32()))], names=[doc_id, "text", "shut"])

        rows = materialise(rows.mapInArrow(cover, f"`{doc_id}` {kind}, text string, shut array<int>"))
        shared.destroy()
        block, following = following, next(blocks, None)
    last = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featuriser(Patterns(last.value) if last.value else None)
        for b in batches:
            each = []
            for t, old in zip(b[1].to_pylist(), b[2].to_pylist(), strict=True):
                each.append(f(t, {*old, *f.covered(f.split(t))} if old else None) if t else [])
            lengths = pa.array([[len(s) for s in d] for d in each], pa.list_(pa.int32()))
            yield pa.record_batch([b[0], lengths, pa.array([[x for s in d for x in s] for d in each], pa.list_(pa.int32()))], names=[doc_id, "lengths", "feats"])

    return rows.mapInArrow(run, f"`{doc_id}` {kind}, lengths array<int>, feats array<int>")


def _labels(labels: DataFrame, doc_id: str, subject: str, names: list[str], none: str) -> DataFrame:
    """(doc_id, votes): how often each subject, and last "none", was given. Other and null labels don't count."""
    said = F.lower(F.trim(F.col(subject)))
    one = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id)
    counts = [F.count_if(said == x.strip().lower()).cast("int") for x in (*names, none)]
    return one.agg(F.array(*counts).alias("votes")).where(F.aggregate("votes", F.lit(0), lambda a, x: a + x) > 0)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Documents of a batch with features: (features, sentence starts, document of each sentence, first sentences, rows)."""
    lengths, feats = b["lengths"], b["feats"]
    at_s, at_f = lengths.offsets.to_numpy(), feats.offsets.to_numpy()
    all_l, all_f = lengths.values.to_numpy(), feats.values.to_numpy()
    begin, n = 0, len(b)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at_f, at_f[begin] + CHUNK, side="right")) - 1)
        end = min(end, n)
        each = all_l[at_s[begin] : at_s[end]]
        per_doc = np.diff(at_s[begin : end + 1])
        starts = np.r_[0, np.cumsum(each)[:-1]].astype("int64") if len(each) else np.zeros(0, "int64")
        yield all_f[at_f[begin] : at_f[end]], starts, np.repeat(np.arange(end - begin), per_doc), per_doc, slice(begin, end)
        begin = end


def scores(weights: np.ndarray, feats: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[feats], starts, axis=0).astype("float64") if len(starts) else np.zeros((0, weights.shape[1]))


def posteriors(score: np.ndarray, doc: np.ndarray, per_doc: np.ndarray, prior: np.ndarray, fixed: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Posterior of each class for each sentence, under its document's mixture of classes: `prior`, and where it isn't
    `fixed` the smoothed mean of the posteriors, found in a few rounds."""
    if not len(score):
        return score
    mix = prior.copy()
    full = np.flatnonzero(per_doc)
    first = np.r_[0, np.cumsum(per_doc[full])[:-1]]
    for _ in range(rounds):
        z = score + np.log(mix[doc])
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        mean = (np.add.reduceat(p, first, axis=0) + 1 / score.shape[1]) / (per_doc[full, None] + 1)
        mix[full] = np.where(fixed[full, None], mix[full], mean)
    return p


def _votes(b: pa.RecordBatch, rows: slice, classes: int) -> np.ndarray:
    """Votes of the documents, zero where they have none or are held out."""
    return np.array([v or [0] * classes for v in b["votes"].slice(rows.start, rows.stop - rows.start).to_pylist()], dtype="float64").reshape(-1, classes)


def _counts(table: DataFrame, classes: int, weights: np.ndarray | None) -> np.ndarray:
    """Weighted counts of every feature by class, from labels alone (weights None) or from posteriors over all documents.

    Each task sums its documents first and passes on at most FEATURES rows, whatever their number.
    """
    shared = table.sparkSession.sparkContext.broadcast(weights)
    schema = "f int, " + ", ".join(f"c{k} float" for k in range(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, FEATURES))
        w = shared.value
        for b in batches:
            for feats, starts, doc, per_doc, rows in _chunks(b):
                votes = _votes(b, rows, classes)
                known = votes.sum(1) > 0
                share = votes / np.maximum(votes.sum(1, keepdims=True), 1)
                if w is None:
                    p = share * (1 - NONE)
                    p[:, -1] += NONE * known
                    p = p[doc]
                else:
                    prior = np.full(votes.shape, 1 / classes)
                    told = (1 - TRUST) / classes + TRUST * share
                    told[:, -1] = np.maximum(told[:, -1], NONE)
                    prior[known] = (told / told.sum(1, keepdims=True))[known]
                    p = posteriors(scores(w, feats, starts), doc, per_doc, prior, known)
                if len(starts):
                    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(feats)]))
                    for k, own in enumerate(np.ascontiguousarray(p.T)):
                        total[k] += np.bincount(feats, own[of], FEATURES)
        at = np.flatnonzero(total.sum(0) > 1e-6)
        yield pa.record_batch([pa.array(at.astype("int32")), *(pa.array(total[k][at].astype("float32")) for k in range(classes))], names=["f", *(f"c{k}" for k in range(classes))])

    summed = table.mapInArrow(run, schema).groupBy("f").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(classes)])
    got = summed.toArrow()  # at most FEATURES rows
    shared.destroy()
    out = np.zeros((FEATURES, classes))
    if got.num_rows:
        out[got["f"].to_numpy()] = np.stack([got[f"c{k}"].to_numpy() for k in range(classes)], 1)
    return out


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """log P(feature) - log P(feature outside the class)."""
    total = counts.sum(1, keepdims=True)
    rest = total - counts
    outside = (rest + SMOOTHING) / (rest.sum(0) + SMOOTHING * len(counts))
    overall = (total + SMOOTHING) / (total.sum() + SMOOTHING * len(counts))
    return (np.log(overall) - np.log(outside)).astype("float32")


def fit_sigmoid(margin: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """(a, b) of the posterior 1 / (1 + exp(-(a margin + b))), by a few Newton steps with a weak pull towards (1, -2)."""
    a, b = 1.0, -2.0
    n = good + bad
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = n * p * (1 - p)
        r = good - n * p
        g = np.array([(r * margin).sum() - 4 * (a - 1), r.sum() - 1 * (b + 2)])
        h = np.array([[(w * margin * margin).sum() + 4, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.1), b


_BINS = np.linspace(-4, 16, 81)


def _calibration(table: DataFrame, weights: np.ndarray, classes: int) -> np.ndarray:
    """(a, b) of each subject, from the best subject of each sentence of the held-out documents and their labels."""
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((classes - 1, len(_BINS), 2))
        for b in batches:
            for feats, starts, doc, _, rows in _chunks(b):
                if len(starts):
                    s = scores(shared.value, feats, starts)
                    top = s[:, :-1].argmax(1)
                    at = np.searchsorted(_BINS, s[np.arange(len(s)), top] - s[:, -1]).clip(0, len(_BINS) - 1)
                    np.add.at(n, (top, at, (_votes(b, rows, classes)[doc, top] > 0).astype(int)), 1)
        k, i, y = np.nonzero(n)
        yield pa.record_batch([pa.array(k.astype("int32")), pa.array(i.astype("int32")), pa.array(y.astype("int32")), pa.array(n[k, i, y])], names=["k", "i", "y", "n"])

    got = table.where("held and votes is not null").mapInArrow(run, "k int, i int, y int, n double").groupBy("k", "i", "y").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    n = np.zeros((classes - 1, len(_BINS), 2))
    for r in got:  # at most subjects x bins x 2 rows
        n[r.k, r.i, r.y] = r.n
    return np.array([fit_sigmoid(_BINS, n[k, :, 1], n[k, :, 0]) for k in range(classes - 1)])


def subjects_of(
    docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text", subject: str = "subject",
    none: str = "none", excluded: DataFrame | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, subject, share, sentences, posterior) for every document and subject of one of its sentences or more.

    share: of the document's subject-bearing sentences; sentences: their number in the document; posterior: the mean
    calibrated posterior of the subject's sentences. The columns' names are those given. Labels are matched without case
    and outer blanks; unknown and null labels don't count; several labels of a document share its weight. excluded: one
    column of texts whose passages bear no subject. Null, empty and wordless texts give no rows; without labels no
    document has a subject; repeated documents come out as often. Whole texts are read; other columns are ignored.
    """
    names = [r[0] for r in subjects.select(subject).where(F.col(subject).isNotNull()).distinct().orderBy(subject).collect()]  # the classes
    classes = len(names) + 1
    kind = dict(docs.dtypes)[doc_id]
    schema = f"`{doc_id}` {kind}, `{subject}` string, share double, sentences int, posterior double"
    spark = docs.sparkSession
    votes = materialise(_labels(labels, doc_id, subject, names, none))
    if not names or votes.isEmpty():
        return spark.createDataFrame([], schema)
    votes = F.broadcast(votes) if small_enough(votes, BROADCAST_LABELS) else votes
    held = F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT)) == 0
    table = materialise(features(docs, doc_id, text, excluded).join(votes, doc_id, "left").withColumn("held", held))
    train = table.withColumn("votes", F.when(~F.col("held"), F.col("votes")))
    weights = complement_weights(_counts(train.where("votes is not null"), classes, None))
    for _ in range(rounds):
        weights = complement_weights(_counts(train, classes, weights))
    sigmoids = _calibration(table, weights, classes)
    shared = spark.sparkContext.broadcast((weights, sigmoids))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ab = shared.value
        for b in batches:
            out: dict[str, list] = {"at": [], "k": [], "share": [], "n": [], "p": []}
            for feats, starts, doc, per_doc, rows in _chunks(b):
                if not len(starts):
                    continue
                s = scores(w, feats, starts)
                m = len(per_doc)
                p = posteriors(s, doc, per_doc, np.full((m, classes), 1 / classes), np.zeros(m, bool))
                best = p[:, :-1].argmax(1)
                own = 1 / (1 + np.exp(-np.clip(ab[:, 0] * (s[:, :-1] - s[:, -1:]) + ab[:, 1], -30, 30)))
                bears = own.max(1) >= 0.5
                n, sure = np.zeros((m, classes - 1)), np.zeros((m, classes - 1))
                np.add.at(n, (doc[bears], best[bears]), 1)
                np.add.at(sure, (doc[bears], best[bears]), own[bears, best[bears]])
                i, k = np.nonzero(n)
                total = n.sum(1)
                out["at"] += (i + rows.start).tolist()
                out["k"] += [names[x] for x in k]
                out["share"] += (n[i, k] / total[i]).tolist()
                out["n"] += total[i].astype(int).tolist()
                out["p"] += (sure[i, k] / n[i, k]).tolist()
            ids = b[doc_id].take(pa.array(out["at"], pa.int64()))
            yield pa.record_batch([ids, pa.array(out["k"], pa.string()), pa.array(out["share"], pa.float64()), pa.array(out["n"], pa.int32()), pa.array(out["p"], pa.float64())], names=[doc_id, subject, "share", "sentences", "posterior"])

    return table.select(doc_id, "lengths", "feats").mapInArrow(decide, schema)


def main_subjects(found: DataFrame, doc_id: str = "doc_id", subject: str = "subject", share: float = SHARE, least: int = SENTENCES, most: int = MOST) -> DataFrame:
    """(doc_id, subject): the subjects of at least `share` of a document's subject-bearing sentences, if it has `least` of
    these; at most `most`, by share and then by name."""
    own = found.where((F.col("share") >= share - 1e-9) & (F.col("sentences") >= least))
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("share")).alias("s"), F.col(subject).alias("k")))), 1, most)  # at most 1 / share items
    return own.groupBy(doc_id).agg(best.alias("b")).select(doc_id, F.explode("b.k").alias(subject))
