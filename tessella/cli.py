"""Command line: python -m tessella run | consistency | variance | compare. Each reads files, works and writes files."""

from __future__ import annotations

import argparse
from dataclasses import MISSING, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import ConsistencyConfig, RunConfig
from tessella.operators import compare, grid, inference, variance
from tessella.plans.runs import report_of
from tessella.session import local_session
from tessella.sources import files
from tessella.streaming.incremental import resume_guard


def _options(parser: argparse.ArgumentParser, settings: type) -> None:
    """An option for each setting, with its name, kind and default; input files are required."""
    for f in fields(settings):
        name = "--" + f.name.replace("_", "-")
        kind = type(f.default) if f.default is not MISSING else str
        if kind is bool:
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            parser.add_argument(name, type=kind, default=f.default, required=f.name in settings._FILES)


def _left(spark: SparkSession, tasks: DataFrame, results: str, schema: str, key: list[str]) -> DataFrame:
    if not files.exists(spark, results):
        return tasks
    return grid.remaining_tasks(tasks, files.load_results(spark, results, schema), key)


def run(spark: SparkSession, config: RunConfig) -> int:
    """Answers all tasks of the grid that the output lacks; returns how many were left."""
    config.check_files(lambda p: files.exists(spark, p))
    resume_guard(spark, config)
    people = grid.first_fraction_by(files.load_personae(spark, config.personae_json), "category", config.subset_category_persona).drop("group_ordinal")
    asked = grid.first_fraction(files.load_prompts(spark, config.prompts_json), config.subset_prompt)
    results = f"{config.output_dir}/results.jsonl"
    todo = _left(spark, grid.task_grid(people, asked, config.n_reps, style=config.system_prompt_style), results, files.RESULT, grid.TASK_KEY)
    n = todo.count()
    answers = inference.run_single(todo, inference.backend(config.backend))
    kinds = [c.split() for c in files.RESULT.split(", ")]
    files.append_results(answers.select(*[F.col(c) if c in answers.columns else F.lit(None).cast(k).alias(c) for c, k in kinds]), results)
    return n


def consistency(spark: SparkSession, config: ConsistencyConfig, backend: str) -> int:
    """The two-turn run; returns how many rows were left to answer."""
    config.check_files(lambda p: files.exists(spark, p))
    resume_guard(spark, config)
    asked = files.load_consistency_prompts(spark, config.prompts_jsonl)
    results, key = f"{config.output_dir}/results.jsonl", ["persona", "prompt_id", "sample_idx"]
    tasks = grid.task_grid(files.load_personae(spark, config.personae_json), asked, config.n_samples, rep="sample_idx", style=config.system_prompt_style)
    todo = _left(spark, tasks, results, files.CONSISTENCY_RESULT, key)
    n = todo.count()
    answers = inference.run_two_turns(todo, inference.backend(backend))
    kinds = [c.split() for c in files.CONSISTENCY_RESULT.split(", ")]
    files.append_results(answers.select(*[F.col(c) if c in answers.columns else F.lit(None).cast(k).alias(c) for c, k in kinds]), results)
    return n


def total_variance(spark: SparkSession, source: str, target: str) -> None:
    """Variance of every embedding column by prompt and persona, with the rows' own question and category."""
    rows = spark.read.parquet(source)
    out = variance.variance_records(rows, ["prompt_id", "persona"], variance.embedding_columns(rows))
    for key, c in (("prompt_id", "question"), ("persona", "category")):
        if c in rows.columns:
            out = out.join(rows.groupBy(key).agg(F.max(c).alias(c)), key, "left")
    files.write_embeddings(out, target)


def compared(spark: SparkSession, a: str, b: str) -> DataFrame:
    """The report on two runs' result files. Of a key that comes again, the line that was read last counts."""
    left, right = (files.load_results(spark, p).withColumn("ordinal", F.monotonically_increasing_id()) for p in (a, b))
    return report_of(compare.pairs(left, right, ["response", "avg_entropy", "num_tokens", "think_end_position"]))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    _options(sub.add_parser("run", help="answer a grid of personae and prompts"), RunConfig)
    two = sub.add_parser("consistency", help="the same with a follow-up question")
    _options(two, ConsistencyConfig)
    two.add_argument("--backend", default="vllm")
    v = sub.add_parser("variance", help="total variance of embeddings by prompt and persona")
    v.add_argument("--input", required=True)
    v.add_argument("--output", required=True)
    c = sub.add_parser("compare", help="report on two runs over the same tasks")
    c.add_argument("first")
    c.add_argument("second")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if args.command == "run":
        print(f"{run(spark, RunConfig.of(vars(args)))} tasks were left")
    elif args.command == "consistency":
        print(f"{consistency(spark, ConsistencyConfig.of(vars(args)), args.backend)} tasks were left")
    elif args.command == "variance":
        total_variance(spark, args.input, args.output)
    else:
        compared(spark, args.first, args.second).show(100, truncate=False)
    return 0
