from __future__ import annotations

import random

import pytest

from tessella.llm import subjects as S

RNG = random.Random(4)
TOPICS = {"law": ["notary", "court", "statute", "verdict", "deed"], "food": ["lemon", "dough", "roast", "broth", "caramel"], "music": ["cello", "chorus", "ballad", "octave", "score"]}
TALK = ["Well, that depends on the day.", "I would not bank on it.", "You have a sharp eye for questions."]


def about(topic):
    a, b = RNG.sample(TOPICS[topic], 2)
    return RNG.choice([f"The {a} is older than the {b}.", f"I would look at the {a} before the {b}.", f"What makes the {a} odd is the {b}."])


def document(parts):
    lines = [about(t) for t, n in parts.items() for _ in range(n)] + RNG.sample(TALK, 2)
    RNG.shuffle(lines)
    return " ".join(lines)


@pytest.fixture(scope="module")
def corpus(spark):
    docs, truth, labels = [], {}, []
    for i in range(600):
        kind = i % 5
        a, b = RNG.sample(sorted(TOPICS), 2)
        parts = [{a: 6}, {a: 5, b: 4}, {a: 7, b: 1}, {}, {a: 4}][kind]
        docs.append((i, document(parts), "clash"))
        truth[i] = set() if kind == 3 else {a, b} if kind == 1 else {a}
        if i % 4 == 0:
            said = sorted(truth[i]) or ["none"]
            labels += [(i, RNG.choice([x, x.upper(), f" {x}"]), "r") for x in (said if RNG.random() < 0.9 else ["music"])]
    docs += [(1000, None, ""), (1001, "", ""), (1002, "\x00 123 ###", ""), (1003, "The notary quoted a long passage from the examination.", "")]
    labels += [(2, None, "r"), (2, "nonsense", "r"), (None, "law", "r")]
    d = spark.createDataFrame(docs, "doc_id long, text string, share string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    sub = spark.createDataFrame([(t, "x") for t in TOPICS], "subject string, description string")
    return d, lab, sub, truth


def test_held_against_the_truth(corpus):
    d, lab, sub, truth = corpus
    got: dict[int, set] = {}
    for r in S.main_subjects(S.subjects_of(d, lab, sub)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert not {1000, 1001, 1002, 1003} & set(got)


def test_excluded_passages_bear_nothing(spark, corpus):
    d, lab, sub, _ = corpus
    one = spark.createDataFrame([(1, "The court and the statute and the verdict went to the notary. The deed of the court is a verdict.", "")], d.schema)
    passage = spark.createDataFrame([("the court and the statute and the verdict went to the notary the deed of the court is a verdict",)], "text string")
    everything = d.unionByName(one)
    assert S.subjects_of(everything, lab, sub, excluded=passage).where("doc_id = 1 and sentences > 0").count() == S.subjects_of(d, lab, sub, excluded=passage).where("doc_id = 1").count()


def test_only_words_in_passages_are_left_out():
    item = "the court of appeal ruled on the patent of the famous inventor after a long and weary trial in spring"
    f = S.Featuriser(S.Patterns([(0, item)]))
    plain = S.Featuriser()
    short = "The court of appeal ruled, but the notary wept."
    assert f(short) == plain(short)  # a short quotation is no passage
    inside = f"The lemon is sour. Then {item} and the broth was hot. The dough is soft."
    got, rest = f(inside), plain("The lemon is sour. Then and the broth was hot. The dough is soft.")
    assert got == rest


def test_excluded_texts_in_several_blocks(spark, corpus):
    d, *_ = corpus
    words = [" ".join(f"{a}{i}" for a in "abcdefghijklmnop") for i in range(4)]
    docs = spark.createDataFrame([(i, f"The lemon is {w} and sour. The dough is soft.", "") for i, w in enumerate(words)] + [(9, None, "")], d.schema)
    items = spark.createDataFrame([(w,) for w in words], "text string")
    one, many = ({r.doc_id: (r.lengths, r.feats) for r in S.features(docs, "doc_id", "text", items, block_chars=n).collect()} for n in (10**6, 60))
    assert one == many and {sum(n) for n, _ in one.values()} == {0, 16}


def test_without_labels_or_documents(corpus):
    d, lab, sub, _ = corpus
    assert S.subjects_of(d, lab.limit(0), sub).count() == 0
    assert S.subjects_of(d.limit(0), lab, sub).count() == 0
    assert S.subjects_of(d, lab, sub.limit(0)).count() == 0


def test_sentences():
    assert S.sentences("System: You are a judge.\nUser: Why?\nAssistant: One is here. Two is there.") == ["Why?", "One is here.", "Two is there."]
    assert S.sentences('{"question": "A b. C d?", "id": 1}') == ['{"question": "A b. C d?", "id": 1}']
    assert S.sentences("") == []
