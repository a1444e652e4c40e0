"""Grids, subsets and resumption over personae, prompts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import system_prompt
from tessella.operators import grid
from tessella.plans.common import SQL_PERSONAE, SQL_PROMPTS, SQL_SYSTEM_PROMPT, personae, prompts
from tessella.session import table


def task_grid(spark: SparkSession, d: str) -> DataFrame:
    """Number of tasks and of distinct prompts by persona of the full grid with three repetitions."""
    t = grid.task_grid(personae(spark, d), prompts(spark, d), 3)
    return t.groupBy("persona", "system_prompt").agg(F.count("*").alias("tasks"), F.sum(F.col("prompt_id") + F.col("rep_idx")).alias("checksum"))


def consistency_grid(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "consistency_prompts").withColumnRenamed("id", "prompt_id").withColumn("ordinal", F.col("prompt_id"))
    t = grid.task_grid(personae(spark, d), q, 2, rep="sample_idx")
    return t.groupBy("prompt_id", "follow_up", "sample_idx").agg(F.count("*").alias("tasks"), F.count_distinct("system_prompt").alias("prompts"))


def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "personae")
    return p.select("persona", "article", system_prompt(F.col("persona"), F.col("article")).alias("system_prompt"))


def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of the one-repetition grid that results lack, by persona."""
    asked = table(spark, d, "prompts").select(F.col("id").alias("prompt_id"))
    return grid.remaining_by_persona(table(spark, d, "personae").select("persona"), asked, table(spark, d, "results"), 1)


def resume_done(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the one-repetition grid that are finished (set intersection)."""
    known = table(spark, d, "personae").select("persona"), table(spark, d, "prompts").select(F.col("id").alias("prompt_id"))
    return grid.finished_tasks(table(spark, d, "results"), *known, 1)


def prefix_subset(spark: SparkSession, d: str) -> DataFrame:
    return grid.first_fraction(prompts(spark, d), 0.07).select("prompt_id", "question", "ordinal")


def stratified_prefix(spark: SparkSession, d: str) -> DataFrame:
    return grid.first_fraction_by(personae(spark, d), "category", 0.07).select("persona", "category", "ordinal", "group_ordinal")


def persona_batches(spark: SparkSession, d: str) -> DataFrame:
    b = grid.persona_batches(table(spark, d, "results").where("persona is not null"), 64)
    return b.groupBy("persona", "batch_no").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def batch_count(spark: SparkSession, d: str) -> DataFrame:
    return grid.batch_count(table(spark, d, "results").where("persona is not null"), 64)


def history_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a persona since its history was last reset; a repetition 0 stands for the reset."""
    rows = table(spark, d, "results").where("persona is not null")
    return grid.reset_epochs(rows, "persona", "ordinal", F.col("rep_idx") == 0).groupBy("persona", "epoch").agg(F.count("*").alias("turns"))


def generation_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps that a batch runs for each of its sequences until the first end token (here vec_id modulo 17 is 16)."""
    v = table(spark, d, "embeddings").select((F.col("label") % 2).alias("batch"), "label", "vec_id", (F.col("vec_id") % 17).alias("token"))
    run = grid.steps_run(v, "batch", "label", "vec_id", F.col("token") == 16)
    return run.groupBy("batch", "label").agg(F.count("*").alias("steps"), F.max("vec_id").alias("last"))


_GRID = f"WITH {SQL_PERSONAE}, {SQL_PROMPTS}, grid AS (SELECT per.persona, per.category, {SQL_SYSTEM_PROMPT} AS system_prompt, pro.prompt_id, r.rep_idx FROM per, pro, range(%d) AS r(rep_idx))"

QUERIES = {f.__name__: f for f in (
    task_grid, consistency_grid, system_prompts, resume_remaining, resume_done, prefix_subset, stratified_prefix, persona_batches, batch_count, history_epochs, generation_steps,
)}
SQL = {
    "task_grid": _GRID % 3 + " SELECT persona, system_prompt, count(*) AS tasks, CAST(sum(prompt_id + rep_idx) AS BIGINT) AS checksum FROM grid GROUP BY ALL",
    "consistency_grid": f"""
        SELECT id AS prompt_id, follow_up, r.sample_idx, count(*) AS tasks, count(DISTINCT {SQL_SYSTEM_PROMPT}) AS prompts
        FROM personae, consistency_prompts, range(2) AS r(sample_idx) GROUP BY ALL""",
    "system_prompts": f"SELECT persona, article, {SQL_SYSTEM_PROMPT} AS system_prompt FROM personae",
    "resume_remaining": _GRID % 1 + """
        SELECT persona, count(*) AS remaining, min(prompt_id) AS first_prompt FROM grid
        WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.persona = grid.persona AND r.prompt_id = grid.prompt_id AND r.rep_idx = grid.rep_idx) GROUP BY persona""",
    "resume_done": _GRID % 1 + " SELECT persona, prompt_id, rep_idx FROM grid INTERSECT SELECT persona, prompt_id, rep_idx FROM results",
    "prefix_subset": f"WITH {SQL_PROMPTS} SELECT prompt_id, question, ordinal FROM pro WHERE ordinal < ceil((SELECT count(*) FROM pro) * 0.07::DOUBLE)",
    "stratified_prefix": f"""
        WITH {SQL_PERSONAE}, n AS (SELECT *, count(*) OVER (PARTITION BY category) AS c, row_number() OVER (PARTITION BY category ORDER BY ordinal) AS i,
            min(ordinal) OVER (PARTITION BY category) AS group_ordinal FROM per)
        SELECT persona, category, ordinal, group_ordinal FROM n WHERE i <= ceil(c * 0.07::DOUBLE)""",
    "persona_batches": """
        WITH n AS (SELECT persona, ordinal, row_number() OVER (PARTITION BY persona ORDER BY ordinal) AS i FROM results WHERE persona IS NOT NULL)
        SELECT persona, CAST(floor((i - 1) / 64.0) AS BIGINT) AS batch_no, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last FROM n GROUP BY ALL""",
    "batch_count": "SELECT CAST(sum(b) AS BIGINT) AS batches FROM (SELECT ceil(count(*) / 64.0) AS b FROM results WHERE persona IS NOT NULL GROUP BY persona)",
    "history_epochs": """
        WITH e AS (SELECT persona, CAST(sum(CASE WHEN rep_idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY persona ORDER BY ordinal) AS BIGINT) AS epoch FROM results WHERE persona IS NOT NULL)
        SELECT persona, epoch, count(*) AS turns FROM e GROUP BY ALL""",
    "generation_steps": """
        WITH v AS (SELECT label % 2 AS batch, label, vec_id, vec_id % 17 = 16 AS e FROM embeddings),
        s AS (SELECT *, coalesce(sum(e::INT) OVER (PARTITION BY batch, label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM v)
        SELECT batch, label, count(*) AS steps, max(vec_id) AS last FROM s WHERE ended = 0 GROUP BY ALL""",
}
