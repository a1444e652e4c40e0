"""Sections, prompts, templates and previews over the stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans.common import sql_strip
from tessella.session import ship, table


def section_extract(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    think, out = text.thinking_section(r), text.output_section(r)
    return table(spark, d, "results").select("ordinal", think.alias("thinking"), out.alias("output"), text.blank_to_space(out).alias("to_embed"))


def text_views(spark: SparkSession, d: str) -> DataFrame:
    """The six texts of a two-turn row that are embedded, by turn and view, as lengths in characters."""
    rows = table(spark, d, "consistency_results")
    views = [
        F.struct(F.lit(f"response{i}_{v}").alias("view"), F.length(text.blank_to_space(f(F.col(f"response{i}")))).cast("bigint").alias("chars"))
        for i in (1, 2) for v, f in (("full", lambda c: c), ("thinking", text.thinking_section), ("output", text.output_section))
    ]
    return rows.select("ordinal", F.explode(F.array(*views)).alias("v")).select("ordinal", "v.*")


def chat_render(spark: SparkSession, d: str) -> DataFrame:
    """The second turn's prompt of each two-turn row: system, question, first answer, follow-up."""
    rows = table(spark, d, "consistency_results").fillna("", ["system_prompt", "question", "response1", "follow_up"])
    turns = F.array(*[text.message(role, F.col(c)) for role, c in (("system", "system_prompt"), ("user", "question"), ("assistant", "response1"), ("user", "follow_up"))])
    return rows.select("ordinal", text.render_chat(turns, text.generation_prefix(F.coalesce("persona", F.lit("")))).alias("prompt"))


def two_turn_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two-turn rows as one row per turn, with the turn's own question and metrics under common names."""
    rows = table(spark, d, "consistency_results")
    names = ["avg_entropy", "avg_top_k_mass", "think_end_position", "num_tokens"]
    turn = lambda i: F.struct(
        F.lit(i).cast("bigint").alias("turn"), F.col("question" if i == 1 else "follow_up").alias("asked"), F.length(f"response{i}").cast("bigint").alias("chars"),
        *[F.col(f"response{i}_{n}").alias(n) for n in names],
    )
    return rows.select("ordinal", F.explode(F.array(turn(1), turn(2))).alias("t")).select("ordinal", "t.*").withColumns(
        {c: F.when(~F.isnan(c), F.round(c, 6)) for c in ("avg_entropy", "avg_top_k_mass")}
    )


def persona_templates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personae")
    template = F.lit("{{ '<|im_start|>assistant\\n' }}{{ \"<|im_start|>assistant\\n\" }}")
    return p.select("persona", text.patch_template(template, F.col("persona")).alias("template"), text.generation_prefix(F.col("persona")).alias("prefix"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response")
    return table(spark, d, "results").where("response is not null").select(
        "ordinal", text.preview(r, 80).alias("title"), F.substring(r, 1, 500).alias("shown"), text.remaining(r, 500).cast("bigint").alias("more")
    )


def first_diff_char(spark: SparkSession, d: str) -> DataFrame:
    """Where the first and the second answer of a row begin to differ."""
    ship(spark)
    rows = table(spark, d, "consistency_results").select("ordinal", F.col("response1").alias("a"), F.col("response2").alias("b"))
    return rows.select("ordinal", text.first_difference(F.col("a"), F.col("b")).cast("bigint").alias("at"))


def parsed_commands(spark: SparkSession, d: str) -> DataFrame:
    """What lines do in the chat loop: every verb, known and unknown, with and without what it needs, for each persona."""
    p = table(spark, d, "personae")
    forms = [F.concat(F.lit("  /Persona  \""), "persona", F.lit("\" ")), F.concat(F.lit("/system You are "), "persona"), F.concat(F.lit("/"), F.lit("unknown "), "persona"), F.col("persona")]
    fixed = ["/clear", "/persona", "/PERSONA ''", "/system", "/thinking", "/nothinking", "/tokens", "/tokens 512", "/tokens many", "/tokens -3", "/help", " /help me ", "no command"]
    lines = p.select("persona", F.posexplode(F.array(*forms, *map(F.lit, fixed))).alias("form", "line"))
    return lines.select("persona", "form", text.command_result(F.col("line")).alias("c")).select("persona", "form", "c.*")


def run_directories(spark: SparkSession, d: str) -> DataFrame:
    """The directory name of each run's results file, latest first."""
    paths = table(spark, d, "run_configs").select("run_id", F.concat("output_dir", F.lit("/results.jsonl")).alias("path"))
    return paths.select("run_id", "path", text.parent_dir(F.col("path")).alias("name")).orderBy(F.desc("path"))


def gpu_samples(spark: SparkSession, d: str) -> DataFrame:
    """Monitor lines of seven fields, made from events; every fifth line lacks fields."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("x, y")).otherwise(F.format_string("%d, gpu , 1,2, 3 ,4,%s", "event_id", "event_type")).alias("line"))
    parts = text.gpu_sample(F.col("line"))
    return e.select("event_id", parts.alias("p")).where("p is not null").select("event_id", F.get("p", F.lit(1)).alias("device"), F.get("p", F.lit(6)).alias("kind"))


_THINK = sql_strip("regexp_extract(response, '(?s)<think>(.*?)</think>', 1)")
_OUT = sql_strip("CASE WHEN instr(response, '</think>') > 0 THEN substr(response, instr(response, '</think>') + 8) ELSE response END")
QUERIES = {f.__name__: f for f in (
    section_extract, text_views, chat_render, two_turn_rows, persona_templates, previews, first_diff_char, parsed_commands, run_directories, gpu_samples,
)}

def _view(i: int, name: str, expr: str) -> str:
    return f"SELECT ordinal, 'response{i}_{name}' AS view, CAST(CASE WHEN {sql_strip('v')} = '' THEN 1 ELSE length(v) END AS BIGINT) AS chars FROM (SELECT ordinal, {expr.replace('response', f'response{i}')} AS v FROM consistency_results)"


SQL = {
    "section_extract": f"SELECT ordinal, {_THINK} AS thinking, {_OUT} AS output, CASE WHEN {_OUT} = '' THEN ' ' ELSE {_OUT} END AS to_embed FROM results",
    "text_views": " UNION ALL ".join(_view(i, n, e) for i in (1, 2) for n, e in (("full", "response"), ("thinking", _THINK), ("output", _OUT))),
    "chat_render": """
        SELECT ordinal, '<|im_start|>system' || chr(10) || coalesce(system_prompt, '') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(question, '') || '<|im_end|>' || chr(10)
            || '<|im_start|>assistant' || chr(10) || coalesce(response1, '') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(follow_up, '') || '<|im_end|>' || chr(10)
            || CASE WHEN coalesce(persona, '') = '' THEN '<|im_start|>' ELSE '<|im_start|>' || persona || chr(10) END AS prompt FROM consistency_results""",
    "two_turn_rows": " UNION ALL ".join(
        f"SELECT ordinal, {i}::BIGINT AS turn, {q} AS asked, CAST(length(response{i}) AS BIGINT) AS chars, "
        + ", ".join(f"round(CASE WHEN isnan(response{i}_{c}) THEN NULL ELSE response{i}_{c} END, 6) AS {c}" for c in ("avg_entropy", "avg_top_k_mass"))
        + f", response{i}_think_end_position AS think_end_position, response{i}_num_tokens AS num_tokens FROM consistency_results"
        for i, q in ((1, "question"), (2, "follow_up"))
    ),
    "persona_templates": r"""
        SELECT persona, '{{ ''<|im_start|>' || replace(replace(persona, '\', '\\'), '''', '\''') || CASE WHEN persona = '' THEN '' ELSE '\n' END || ''' }}{{ "<|im_start|>'
            || replace(replace(persona, '\', '\\'), '"', '\"') || CASE WHEN persona = '' THEN '' ELSE '\n' END || '" }}' AS template,
            CASE WHEN persona = '' THEN '<|im_start|>' ELSE '<|im_start|>' || persona || chr(10) END AS prefix FROM personae""",
    "previews": """
        SELECT ordinal, CASE WHEN length(response) > 80 THEN substr(response, 1, 80) || '...' ELSE response END AS title, substr(response, 1, 500) AS shown,
            CAST(greatest(length(response) - 500, 0) AS BIGINT) AS more FROM results WHERE response IS NOT NULL""",
    # the lengths of equal beginnings, halved like a search; each step is a table of its own
    "first_diff_char": """
        WITH RECURSIVE x AS (SELECT ordinal, response1 AS a, response2 AS b, least(length(response1), length(response2)) AS n FROM consistency_results),
        s AS (
            SELECT ordinal, 0::BIGINT AS lo, n AS hi FROM x WHERE left(a, n) <> left(b, n)
            UNION ALL
            SELECT s.ordinal, CASE WHEN left(a, (lo + hi) // 2) = left(b, (lo + hi) // 2) THEN (lo + hi) // 2 ELSE lo END,
                CASE WHEN left(a, (lo + hi) // 2) = left(b, (lo + hi) // 2) THEN hi ELSE (lo + hi) // 2 END FROM s JOIN x USING (ordinal) WHERE hi - lo > 1)
        SELECT x.ordinal, m.lo AS at FROM x LEFT JOIN (SELECT ordinal, lo FROM s WHERE hi - lo = 1) m USING (ordinal)""",
    "parsed_commands": """
        WITH f AS (SELECT persona, unnest([
            {'form': 0, 'verb': '/persona', 'problem': NULL, 'value': persona, 'number': NULL, 'clears': true}, {'form': 1, 'verb': '/system', 'problem': NULL, 'value': 'You are ' || persona, 'number': NULL, 'clears': true},
            {'form': 2, 'verb': '/unknown', 'problem': 'unknown', 'value': NULL, 'number': NULL, 'clears': false}, {'form': 3, 'verb': NULL, 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 4, 'verb': '/clear', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': true}, {'form': 5, 'verb': '/persona', 'problem': 'usage', 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 6, 'verb': '/persona', 'problem': NULL, 'value': '', 'number': NULL, 'clears': true}, {'form': 7, 'verb': '/system', 'problem': 'usage', 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 8, 'verb': '/thinking', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false}, {'form': 9, 'verb': '/nothinking', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 10, 'verb': '/tokens', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false}, {'form': 11, 'verb': '/tokens', 'problem': NULL, 'value': NULL, 'number': 512, 'clears': false},
            {'form': 12, 'verb': '/tokens', 'problem': 'usage', 'value': NULL, 'number': NULL, 'clears': false}, {'form': 13, 'verb': '/tokens', 'problem': 'usage', 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 14, 'verb': '/help', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false}, {'form': 15, 'verb': '/help', 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false},
            {'form': 16, 'verb': NULL, 'problem': NULL, 'value': NULL, 'number': NULL, 'clears': false}]) AS f FROM personae)
        SELECT persona, f.form, f.verb IS NOT NULL AS handled, f.verb, CASE WHEN f.verb IS NULL THEN NULL ELSE f.verb <> '/unknown' END AS known, f.problem, f.value, CAST(f.number AS BIGINT) AS number, f.clears AS clears_history FROM f""",
    "run_directories": "SELECT run_id, output_dir || '/results.jsonl' AS path, split_part(output_dir, '/', -1) AS name FROM run_configs",
    "gpu_samples": "SELECT event_id, 'gpu' AS device, event_type AS kind FROM events WHERE event_id % 5 <> 0",
}
