from __future__ import annotations

import pytest

from tessella.llm.language import asked_for, language_chars, segment_language
from tessella.llm.structure import ending, open_parts


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("whole (aside) “quote”.", []),
        ("a :) b", []),
        ("1) one\n2) two", []),
        ("<think>a", ["<think>"]),
        ("<think>a</think>b", []),
        ("a</think>b", []),
        ("<think>a</thi", ["<think>", "tag"]),
        ("```py\nx = (1", ["```"]),
        ("```py\nx = (1\n```", []),
        ("“he said (so", ["“", "("]),
        ("**bold", ["**"]),
        ("**bold** x", []),
        ("`code", ["`"]),
        ("it is 5` long\nnext line", []),
        ("«a “b”", ["«"]),
    ],
)
def test_open_parts(text, want):
    assert open_parts(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("", ""), (" \n", ""), ("a.", "mark"), ("a 🙂", "mark"), ("a…", "mark"), ("a,", "bare"), ("a b", "bare"), ("x\n- b", "list"), ("x\n2. b", "list"), ("x\n2.", "marker"), ("x\n\n— yours, from Y", "signature"), ("```\nx\n```", "mark")],
)
def test_ending(text, want):
    assert ending(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("What do you think of it?", "en"), ("Was hältst du von der Sache?", "de"), ("Que pensez-vous de ceci ?", "fr"), ("¿Qué opina usted de esto?", "es"), ("それは日によって違います。", "ja"), ("Это зависит от дня.", "ru"), ("", ""), ("12345", "")],
)
def test_languages(text, want):
    assert segment_language(text) == want


def test_language_helpers():
    n = language_chars("The cat is here. Der Hund ist nicht da.")
    assert set(n) == {"en", "de"}
    assert asked_for("Why? (Reply in Spanish only.)") == {"es"} and asked_for("Why?") == set()
