"""Files, runs and model calls from end to end, over tables turned into files and back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import inference
from tessella.operators.grid import task_grid
from tessella.plans.common import SQL_SYSTEM_PROMPT, personae, prompts, sql_strip
from tessella.sources import files
from tessella.session import shared_dir, table
from tessella.streaming.incremental import run_stream


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}-{name}"


def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as JSON lines, every third without an id, parsed again."""
    p = prompts(spark, d)
    value = F.when(F.col("ordinal") % 3 == 0, F.to_json(F.struct("question"))).otherwise(F.to_json(F.struct("question", F.col("prompt_id").alias("id"))))
    return files.parse_prompt_lines(p.select("ordinal", value.alias("value")), ["question"])


def prompt_array(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as JSON arrays of three items each: a string that looks like an object, a string, and an object."""
    p = prompts(spark, d).where("prompt_id is not null")
    odd = F.to_json(F.struct(F.concat(F.lit("{"), F.coalesce("question", F.lit(""))).alias("q")))
    items = [F.get_json_object(odd, "$.q"), F.coalesce("question", F.lit(""))]
    quoted = [F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1) for c in items]
    item = F.concat(F.lit("["), F.concat_ws(",", *quoted, F.to_json(F.struct(F.coalesce("question", F.lit("")).alias("question"), F.col("prompt_id").alias("id")))), F.lit("]"))
    rows = p.select(F.col("ordinal").alias("n"), F.inline(files.parse_prompt_array(item)))
    return rows.select("n", "ordinal", "question", "prompt_id")


def results_files(spark: SparkSession, d: str) -> DataFrame:
    """results appended as JSON lines and read again."""
    at = _at(spark, "results.jsonl")
    cols = [c.split()[0] for c in files.RESULT.split(", ")]
    files.append_results(table(spark, d, "results").select(*cols), at)
    return files.load_results(spark, at).select("persona", "prompt_id", "rep_idx", "response", "num_tokens")


def run_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Result files of the runs: of a directory with both kinds, only the lines."""
    c = table(spark, d, "run_configs")
    n = F.substring("run_id", 2, 2).cast("int")
    lines, arrays = c.where(n % 2 == 0), c.where(n % 3 != 1)
    paths = [x.select(F.concat("output_dir", F.lit(f"/results.{k}")).alias("path")) for x, k in ((lines, "jsonl"), (arrays, "json"))]
    return files.discover_runs(paths[0].unionByName(paths[1]))


def stub_run(spark: SparkSession, d: str) -> DataFrame:
    """The tasks of results, of each key the last line's, answered anew by the stub backend."""
    rows = table(spark, d, "results").dropna(subset=["persona", "prompt_id", "rep_idx"]).fillna("", ["system_prompt", "question"])
    last = rows.groupBy("persona", "prompt_id", "rep_idx").agg(F.max_by(F.struct("system_prompt", "question"), "ordinal").alias("t"))
    out = inference.run_single(last.select("persona", "t.system_prompt", "prompt_id", "rep_idx", "t.question"), inference.backend("stub"))
    return out.groupBy("prompt_id").agg(F.count("*").alias("answers"), F.sum("num_tokens").alias("tokens"), F.count_distinct("prompt").alias("prompts"))


def stub_two_turns(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "consistency_prompts").withColumnRenamed("id", "prompt_id").withColumn("ordinal", F.col("prompt_id"))
    out = inference.run_two_turns(task_grid(personae(spark, d), q, 1, rep="sample_idx"), inference.backend("stub"))
    return out.groupBy("prompt_id").agg(F.count("*").alias("rows"), F.count_distinct("response1").alias("first"), F.count_distinct("response2").alias("second"))


def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "results").select("ordinal", "prompt_id", "persona", "response")
    e = inference.embed_views(rows, ["response"], inference.stub_embed)
    return e.groupBy("prompt_id").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding_output", F.lit(0)).cast("double")), 4).alias("checksum"))


def stream_append_resume(spark: SparkSession, d: str) -> DataFrame:
    """Tasks arrive in two parts, the second with all of the first again; every key is answered once."""
    base = _at(spark, "stream")
    tasks = table(spark, d, "results").dropna(subset=["persona", "prompt_id", "rep_idx"]).select("persona", "prompt_id", "rep_idx")
    schema = tasks.schema
    first = tasks.where("prompt_id % 2 = 0")
    for part in (first, tasks):
        part.coalesce(4).write.mode("append").parquet(f"{base}/tasks")
        run_stream(spark, f"{base}/tasks", schema, f"{base}/out", lambda t: t.withColumn("answer", F.concat_ws(" ", "persona", "prompt_id")))
    done = spark.read.parquet(f"{base}/out/results")
    return done.groupBy("persona", "prompt_id", "rep_idx").agg(F.count("*").alias("answers"))


QUERIES = {f.__name__: f for f in (prompt_lines, prompt_array, results_files, run_discovery, stub_run, stub_two_turns, stub_embeddings, stream_append_resume)}
_PRO = "WITH pro AS (SELECT question, id, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM prompts)"
_PREFIX = "CASE WHEN persona = '' THEN '<|im_start|>' ELSE '<|im_start|>' || persona || chr(10) END"


def _turns(system: str, user: str) -> str:
    return f"'<|im_start|>system' || chr(10) || {system} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {user} || '<|im_end|>' || chr(10) || {_PREFIX}"


_OUTPUT = sql_strip("CASE WHEN instr(response, '</think>') > 0 THEN substr(response, instr(response, '</think>') + 8) ELSE response END")
_BYTE = "16 * (instr('0123456789abcdef', substr(h, {0}, 1)) - 1) + instr('0123456789abcdef', substr(h, {0} + 1, 1)) - 1 - 127.5::DOUBLE"
SQL = {
    "stub_run": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY persona, prompt_id, rep_idx ORDER BY ordinal DESC) AS n FROM results WHERE persona IS NOT NULL AND prompt_id IS NOT NULL AND rep_idx IS NOT NULL),
        p AS (SELECT prompt_id, {_turns("coalesce(system_prompt, '')", "coalesce(question, '')")} AS prompt FROM r WHERE n = 1)
        SELECT prompt_id, count(*) AS answers, CAST(sum(length(prompt) % 50 + 10) AS BIGINT) AS tokens, count(DISTINCT prompt) AS prompts FROM p GROUP BY prompt_id""",
    # an answer of the stub is as distinct as its prompt
    "stub_two_turns": f"""
        WITH g AS (SELECT id AS prompt_id, {SQL_SYSTEM_PROMPT} AS system_prompt, persona, question, follow_up FROM personae, consistency_prompts), p AS (SELECT *, {_turns('system_prompt', 'question')} AS one FROM g)
        SELECT prompt_id, count(*) AS rows, count(DISTINCT one) AS first, count(DISTINCT one || chr(10) || follow_up) AS second FROM p GROUP BY prompt_id""",
    "stub_embeddings": f"""
        WITH o AS (SELECT prompt_id, {_OUTPUT.replace('response', "coalesce(response, '')")} AS o FROM results), h AS (SELECT prompt_id, sha256(CASE WHEN o = '' THEN ' ' ELSE o END) AS h FROM o),
        v AS (SELECT prompt_id, {_BYTE.format('1')} AS first, {' + '.join(f"pow({_BYTE.format(2 * i + 1)}, 2)" for i in range(8))} AS squares FROM h)
        SELECT prompt_id, count(*) AS n, round(sum(CAST(first / sqrt(squares) AS FLOAT)::DOUBLE), 4) AS checksum FROM v GROUP BY prompt_id""",
    "prompt_lines": f"{_PRO} SELECT ordinal, question, CASE WHEN ordinal % 3 = 0 THEN ordinal ELSE id END AS prompt_id FROM pro",
    "prompt_array": f"""{_PRO}, q AS (SELECT ordinal AS n, coalesce(question, '') AS question, id FROM pro WHERE id IS NOT NULL)
        SELECT n, 0::BIGINT AS ordinal, '{{' || question AS question, 0::BIGINT AS prompt_id FROM q UNION ALL SELECT n, 1, question, 1 FROM q UNION ALL SELECT n, 2, question, id FROM q""",
    "results_files": "SELECT persona, prompt_id, rep_idx, response, num_tokens FROM results",
    "run_discovery": """
        WITH r AS (SELECT output_dir AS directory, substr(run_id, 2, 2)::INT AS n FROM run_configs),
        f AS (SELECT DISTINCT directory, directory || '/results.jsonl' AS path FROM r WHERE n % 2 = 0 UNION SELECT directory, directory || '/results.json' FROM r WHERE n % 3 <> 1 AND n % 2 <> 0 AND directory NOT IN (SELECT directory FROM r WHERE n % 2 = 0))
        SELECT *, row_number() OVER (ORDER BY path DESC) - 1 AS rank FROM f""",
    "stream_append_resume": "SELECT DISTINCT persona, prompt_id, rep_idx, 1::BIGINT AS answers FROM results WHERE persona IS NOT NULL AND prompt_id IS NOT NULL AND rep_idx IS NOT NULL",
}
