from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import text

BLANKS = "\x1c\x85  　 \n\t"


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("response", "thinking", "output"),
    [
        ("<think>a\nb</think> c ", "a\nb", "c"),
        ("a</think>b", "", "b"),
        ("<think>a", "", "<think>a"),
        ("<think>a</think>b<think>c</think>d", "a", "b<think>c</think>d"),
        ("<think></think>", "", ""),
        (f"{BLANKS}x{BLANKS}", "", "x"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_sections(spark, response, thinking, output):
    df = spark.createDataFrame([(response,)], "r string")
    got = df.select(text.thinking_section(F.col("r")), text.output_section(F.col("r"))).first()
    assert tuple(got) == (thinking, output)


def test_blank_becomes_space(spark):
    assert one(spark, text.blank_to_space(F.col("r")), r=BLANKS) == " "
    assert one(spark, text.blank_to_space(F.col("r")), r=" a ") == " a "


@pytest.mark.parametrize(("article", "want"), [("a", "You are a fox."), ("none", "You are fox."), ("", "You are fox."), (None, "You are fox."), ("the", "You are the fox.")])
def test_system_prompt(spark, article, want):
    assert one(spark, text.system_prompt(F.col("p"), F.col("a")), p="fox", a=article) == want


def test_unknown_style():
    with pytest.raises(ValueError, match="style"):
        text.system_prompt(F.lit("x"), F.lit("a"), "other")


def test_template_escapes_backslash_first(spark):
    t = "{{ '<|im_start|>assistant\\n' }} {{ \"<|im_start|>assistant\\n\" }}"
    got = one(spark, text.patch_template(F.col("t"), F.col("p")), t=t, p="o'\\\"")
    assert got == "{{ '<|im_start|>o\\'\\\\\"\\n' }} {{ \"<|im_start|>o'\\\\\\\"\\n\" }}"
    assert one(spark, text.patch_template(F.col("t"), F.col("p")), t=t, p="") == "{{ '<|im_start|>' }} {{ \"<|im_start|>\" }}"


def test_render_chat(spark):
    turns = F.array(text.message("system", F.col("s")), text.message("user", F.col("u")))
    got = one(spark, text.render_chat(turns, text.generation_prefix(F.col("p"))), s="S", u="U", p="fox")
    assert got == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>fox\n"


@pytest.mark.parametrize(("a", "b", "at"), [("abc", "abd", 2), ("ab", "abc", None), ("", "x", None), ("x", "y", 0), (None, "y", None)])
def test_first_difference(spark, a, b, at):
    assert one(spark, text.first_difference(F.col("a"), F.col("b")), a=a, b=b) == at


@pytest.mark.parametrize(("p", "want"), [(0.0, "< 1e-300"), (1e-7, "1.00e-07"), (0.00012, "0.0001"), (0.25, "0.2500")])
def test_format_pvalue(spark, p, want):
    assert spark.createDataFrame([(p,)], "p double").select(text.format_pvalue(F.col("p")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("/Clear", ("/clear", "")), (' /persona "a fox" ', ("/persona", "a fox")), ("/system ''", ("/system", "")), ("/tokens 5", ("/tokens", "5")), ("hello", None), ('/x "', ("/x", '"'))],
)
def test_commands(spark, line, want):
    got = one(spark, text.command_of(F.col("l")), l=line)
    assert (tuple(got) if got else None) == want


def test_small_helpers(spark):
    assert one(spark, text.parent_dir(F.col("p")), p="logs/run 1/results.jsonl") == "run 1"
    assert one(spark, text.gpu_sample(F.col("p")), p="a, b ,c,d,e,f,g,h") == ["a", "b", "c", "d", "e", "f", "g"]
    assert one(spark, text.gpu_sample(F.col("p")), p="a,b") is None
    assert one(spark, text.preview(F.col("p"), 3), p="abcd") == "abc..."


def test_first_diff_char_past_any_prefix(spark, tmp_path):
    from tessella.plans.texts import first_diff_char

    rows = [(1, "a" * 300 + "b", "a" * 300 + "c"), (2, "a" * 201, "a" * 300), (3, "é" * 1000 + "x", "é" * 1000 + "y"), (4, None, "a"), (5, "ab", "cb")]
    spark.createDataFrame(rows, "ordinal long, response1 string, response2 string").write.parquet(str(tmp_path / "consistency_results.parquet"))
    want = {n: None if a is None else next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None) for n, a, b in rows}
    assert {r.ordinal: r["at"] for r in first_diff_char(spark, str(tmp_path)).collect()} == want
