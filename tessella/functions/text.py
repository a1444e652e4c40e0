"""Text expressions: sections of a response, prompts, templates, previews, commands. All are column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of the chat format and of the thinking section.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
# Unicode blanks that Python's str.strip() takes off, as a character class.
BLANK = r"[\s\x1c-\x1f\x85   -     　]"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode blanks."""
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def thinking_section(c: Column) -> Column:
    """The first complete thinking section, stripped; "" where there is none."""
    return strip(F.regexp_extract(c, f"(?s){THINK_OPEN}(.*?){THINK_CLOSE}", 1))


def output_section(c: Column) -> Column:
    """What follows the first closing tag, else the whole text; stripped."""
    at = F.instr(c, THINK_CLOSE)
    return strip(F.when(at > 0, F.substring(c, at + F.lit(len(THINK_CLOSE)), F.length(c))).otherwise(c))


def blank_to_space(c: Column) -> Column:
    """A blank text becomes one space, so that an embedding model gets a token."""
    return F.when(strip(c) == "", F.lit(" ")).otherwise(c)


def system_prompt(persona: Column, article: Column, style: str = "you-are-a") -> Column:
    """"You are {article} {persona}."; without article where it is "", "none" or null. Unknown style: ValueError."""
    if style != "you-are-a":
        raise ValueError(f"unknown system prompt style: {style!r}")
    bare = article.isNull() | article.isin("", "none")
    return F.concat(F.lit("You are "), F.when(bare, F.lit("")).otherwise(F.concat(article, F.lit(" "))), persona, F.lit("."))


def escape_quoted(c: Column, quote: str) -> Column:
    """c as the inside of a string literal in the given quotes: backslashes first, then the quote."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(quote), F.lit("\\" + quote))


def patch_template(template: Column, persona: Column) -> Column:
    """The chat template with the persona in place of the assistant's role, in literals of either quote.

    An empty persona takes the role's line break with it.
    """
    out = template
    for q in ("'", '"'):
        role = F.when(persona == "", F.lit("")).otherwise(F.concat(escape_quoted(persona, q), F.lit("\\n")))
        out = F.replace(out, F.lit(f"{q}{TURN_START}assistant\\n{q}"), F.concat(F.lit(q + TURN_START), role, F.lit(q)))
    return out


def generation_prefix(persona: Column) -> Column:
    return F.when(persona == "", F.lit(TURN_START)).otherwise(F.concat(F.lit(TURN_START), persona, F.lit("\n")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_chat(messages: Column, prefix: Column | None = None) -> Column:
    """An array of (role, content) in the chat format, then the prefix that asks for an answer."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(f"{TURN_END}\n")))
    return F.concat(F.array_join(turns, ""), F.lit("") if prefix is None else prefix)


def _first_differences(a: pd.Series, b: pd.Series) -> pd.Series:
    def at(x: str | None, y: str | None) -> int | None:
        if x is None or y is None or x.startswith(y) or y.startswith(x):
            return None
        lo, hi = 0, min(len(x), len(y))  # equal up to lo, not up to hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid)
        return lo

    return pd.Series([at(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first differing character, from 0; null where one text is a prefix of the other, or either is null.

    Halving what is still in doubt looks at each character once or twice, however long the texts are.
    """
    return F.pandas_udf(_first_differences, "bigint")(a, b)


def preview(c: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, with a mark where more follow."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def remaining(c: Column, n: int) -> Column:
    return F.greatest(F.length(c) - n, F.lit(0))


def format_pvalue(p: Column) -> Column:
    """ "< 1e-300" for 0, two digits and an exponent below 0.0001, else four decimals."""
    return F.when(p == 0, F.lit("< 1e-300")).when(p < 1e-4, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p))


def command_of(text: Column) -> Column:
    """Struct (verb, args) of a line that starts with "/": verb in lower case, args stripped and without outer quotes; null
    for other lines."""
    line = strip(text)
    args = strip(F.regexp_extract(line, rf"(?s)^\S+{BLANK}+(.*)$", 1))
    quoted = (F.length(args) >= 2) & (F.substring(args, 1, 1) == F.substring(args, -1, 1)) & F.substring(args, 1, 1).isin('"', "'")
    plain = F.when(quoted, F.substring(args, F.lit(2), F.length(args) - 2)).otherwise(args)
    return F.when(F.startswith(line, F.lit("/")), F.struct(F.lower(F.regexp_extract(line, r"^(\S+)", 1)).alias("verb"), plain.alias("args")))


# Commands of the chat loop; those that take a text, and those that clear the history.
COMMANDS = ("/clear", "/help", "/nothinking", "/persona", "/system", "/thinking", "/tokens")
TEXT_COMMANDS, CLEARING = ("/persona", "/system"), ("/clear", "/persona", "/system")


def command_result(text: Column) -> Column:
    """What a line does in the chat loop: struct (handled, verb, known, problem, value, number, clears_history).

    handled: whether it is a command at all; problem: "unknown", or "usage" where what the verb needs is missing or no number;
    value: the new persona or system prompt; number: the new token limit, null where /tokens only asks for it.
    """
    line = strip(text)
    bare = ~line.rlike(rf"(?s)^\S+{BLANK}+\S")
    c = command_of(text)
    verb = c["verb"]
    takes = verb.isin(*TEXT_COMMANDS)
    digits = F.when((verb == "/tokens") & ~bare, F.regexp_extract(c["args"], r"^([+-]?\d+)$", 1))
    number = F.when(digits != "", digits.try_cast("bigint"))
    bad_number = (verb == "/tokens") & ~bare & (F.coalesce(number, F.lit(0)) <= 0)
    problem = F.when(~verb.isin(*COMMANDS), "unknown").when(takes & bare | bad_number, "usage")
    return F.struct(
        F.startswith(line, F.lit("/")).alias("handled"), verb.alias("verb"), verb.isin(*COMMANDS).alias("known"), problem.alias("problem"),
        F.when(takes & ~bare, c["args"]).alias("value"), F.when(~bad_number, number).alias("number"),
        F.coalesce(verb.isin(*CLEARING) & problem.isNull(), F.lit(False)).alias("clears_history"),
    )


def parent_dir(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def gpu_sample(line: Column) -> Column:
    """The seven fields of a comma-separated sample line, trimmed; null if there are fewer."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    return F.when(F.size(parts) >= 7, F.slice(parts, 1, 7))
