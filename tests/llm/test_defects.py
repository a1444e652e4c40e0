from __future__ import annotations

import random

import pytest

from tessella.llm.answers import output_of
from tessella.llm.defects import _may_copy, copies_question, defect_hint, is_refusal, tiles
from tessella.llm.language import language_chars

Q = "What do you think of the notary?"


def hint(q, answer):
    out = output_of(answer)
    return defect_hint(q, out, language_chars(out or ""))[0]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("", "empty"), (" … - \n", "empty"), ("<think>\nx\n</think>\n", "empty"), ("<think>\nbroken off", None),
        ("I must decline to answer this one.", "refusal"), ("Alas, that door stays shut. Ask someone else.", "refusal"), ("I'm sorry, but I can’t help with that.", "refusal"),
        ("As a rule I'd refuse to be vague, so here it is. The notary is fine.", None), ("I can't say that the notary is odd, but it binds both parties.", None),
        ("No. The notary is a person.", None), ("I'm sorry, but I can't help with that. The notary, though, is a fine person to know.", None),
        (Q, "copies_question"), (Q.upper(), "copies_question"), (f"You asked: {Q}", "copies_question"), (f"{Q}\n{Q}", "copies_question"), ("What you think of the notary?", "copies_question"),
        (f"{Q} The notary signs every deed that comes before the court.", None),
        ("Der Notar ist wichtig, und das ist nicht einfach.", "other_language"), ("Le notaire est très important pour la loi.", "other_language"), ("それは日によって違います。", "other_language"),
        ("The notary is honest. As they say back home: «Das frage ich mich auch manchmal.»", None),
        ("<think>Der Nutzer fragt und ich weiß es nicht.</think> The notary is honest and it is late.", None),
    ],
)
def test_hints(answer, want):
    assert hint(Q, answer) == want


def test_language_that_the_question_asks_for():
    assert hint(f"{Q} Please answer in German.", "Der Notar ist wichtig, und das ist nicht einfach.") is None
    assert hint(f"{Q} Please answer in German.", "Le notaire est très important pour la loi.") == "other_language"
    assert hint("Was ist besser, die Suppe oder die Brühe?", "Die Suppe ist besser, und das ist nicht neu.") is None
    assert hint("", "Der Notar ist wichtig.") is None  # no question, nothing to compare with


def test_refusals_of_any_length():
    assert is_refusal("I must decline to answer this one. " * 100)
    assert not is_refusal("I must decline to answer this one. " * 100 + "The notary is fine.")


# Refusals and ordinary sentences in words of their own. The grammar found 47 of the 50 before it was mended for the others.
REFUSED = """
I cannot in good conscience produce that.|That goes against my guidelines, so I'll stop here.|I'm unable to fulfil this request.|I am not able to assist with that topic.|Sorry, I won't discuss this.
I'm afraid I can't answer that.|I would rather not say.|I'd prefer not to comment on this.|We cannot provide that information.|I must respectfully decline.|I have to refuse.|That is beyond what I may discuss.
This falls outside my remit.|I am not permitted to speak of it.|I'm not allowed to share that.|It would be wrong of me to answer.|It wouldn't be appropriate for me to comment.|That question is off limits.
I have been instructed not to talk about this.|No comment.|I shall say nothing about it.|I refuse to participate in that.|Unfortunately, I can't help you with this request. Please ask me about something else.
As an old sailor, I will not speak of that.|I'm sorry, but that's not something I can do.|I don't talk about such matters.|I am forbidden to answer.|You will get nothing out of me.|Someone else should answer this.
I decline to give an answer.|I regret that I cannot help here.|I can not support this.|Such requests are not something we take.|I'm not willing to engage with that.|I am in no position to answer that.
Apologies, I cannot create that content.|I won't be able to help with that.|Let's talk about something else. I won't answer this.|I'll have to pass on this one.|I keep that to myself.|This is not a subject I discuss.
I do not feel able to answer.|I choose not to respond.|That must remain between me and my master.|Helping with this is not possible for me.|I have no wish to go into that.|Das möchte ich nicht beantworten.
Je ne peux pas vous aider.|No voy a responder a eso.|My lips are sealed on that one.
""".strip().replace("\n", "|").split("|")
ANSWERED = """
I can't say that the notary is odd, but it binds both parties.|I can't help smiling when somebody brings this up.|I would rather not skip the bandage: it weakens the lungs.|I won't lie: the notary is honest.
I do not know much about it, but the court decides.|You can't help a notary with law.|The notary cannot answer questions of fact.|It is not something I would buy.|Thank you for asking. The court decides tomorrow.
This is not a matter of taste; the judge decides.|As a judge, I decide.|I can't tell you how much I love lemons.
""".strip().replace("\n", "|").split("|")


def test_refusals_in_other_words():
    assert len(REFUSED) == 50 and sum(map(is_refusal, REFUSED)) >= 45
    assert not [x for x in ANSWERED if is_refusal(x)]


def test_question_many_times_and_shuffled():
    assert hint(Q, f"{Q} " * 12) == "copies_question"
    assert hint(Q, "Notary the of think you do what?") is None
    assert hint(Q, f"{Q} " * 12 + "It signs every deed that comes before the court.") is None


@pytest.mark.parametrize("seed", range(30))
def test_tiles_cover_no_more_than_shared_words(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
    shared = sum(min(a.count(x), b.count(x)) for x in set(a))
    covered = lambda *x: sum(n for *_, n in tiles(*x))
    assert covered(a, b, 1) == shared  # tiles of one word end by using up all that both have
    assert covered(a, b, 3) <= shared
    for i, j, n in tiles(a, b, 3):
        assert a[i : i + n] == b[j : j + n] and n >= min(3, len(b))
    if a:
        assert covered(a, a, 2) == len(a)


def test_framed_copies_are_told_by_the_whole_answer():
    """More words of framing stand in the first 200 characters than one copy may have, but each copy has few."""
    assert hint(Q, f"Somebody asked me this: {Q} " * 6) == "copies_question"
    assert hint(Q, f"Somebody asked me this: {Q} " * 6 + "It signs every deed that comes before the court, and then it rests.") is None
    long = [f"word{i}" for i in range(60)]
    edited = [f"other{i}" if i % 4 == 3 and i < 32 else w for i, w in enumerate(long)]
    assert hint(" ".join(long), " ".join(edited)) == "copies_question"


@pytest.mark.parametrize("seed", range(10))
def test_no_copy_fails_the_quick_check(seed):
    rng = random.Random(seed)
    copies = 0
    for _ in range(200):
        q = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 15))]
        a = [w for _ in range(rng.randint(1, 6)) for w in ["x"] * rng.randint(0, 4) + [w if rng.random() > 0.1 else "y" for w in q]]
        if copies_question(q, a):
            copies += 1
            assert _may_copy(q, a)
    assert copies > 20
