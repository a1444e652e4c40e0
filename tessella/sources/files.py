"""Readers and writers of prompt, persona and result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.grid import numbered
from tessella.schemas import CONSISTENCY_RESULT, PERSONA, RESULT


def _required(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """df, which raises an error where one of the columns is null."""
    for c in columns:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{what} without {c}")).cast(dict(df.dtypes)[c])).otherwise(F.col(c)))
    return df


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, value): a file's physical lines from 0, blank ones included. The file is read as one text: the number of a
    line is a property of the whole file. Prompt files are small; result files have their own, parallel reader."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "value"))


def parse_prompt_lines(lines: DataFrame, fields: list[str]) -> DataFrame:
    """(ordinal, fields..., prompt_id) of JSON lines; blank lines are skipped, but count for the default id, which is the
    line's number from 0. A line that is no JSON object or lacks a field raises an error when it is read."""
    schema = ", ".join(f"{f} string" for f in fields) + ", id bigint"
    kept = lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    parsed = kept.select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))
    rows = parsed.select(F.col("ordinal").cast("bigint").alias("ordinal"), *[F.col(f"j.{f}").alias(f) for f in fields], F.coalesce("j.id", F.col("ordinal").cast("bigint")).alias("prompt_id"))
    return _required(rows, fields, "prompt")


def parse_prompt_array(value: Column) -> Column:
    """Array of (question, prompt_id, ordinal) of a JSON array whose items are strings or objects with a question.

    What an item is, its JSON type tells, not its text: a string may begin with any mark.
    """
    items = F.transform(F.from_json(value, "array<variant>", {"mode": "FAILFAST"}), lambda x, i: F.struct(x.alias("x"), F.schema_of_variant(x).alias("kind"), i.cast("bigint").alias("i")))
    is_object = lambda s: F.startswith(s["kind"], F.lit("OBJECT"))
    text = lambda s: F.when(is_object(s), F.try_variant_get(s["x"], "$.question", "string")).when(s["kind"] == "STRING", F.try_variant_get(s["x"], "$", "string"))
    own_id = lambda s: F.when(is_object(s), F.try_variant_get(s["x"], "$.id", "bigint"))
    return F.transform(items, lambda s: F.struct(text(s).alias("question"), F.coalesce(own_id(s), s["i"]).alias("prompt_id"), s["i"].alias("ordinal")))


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, question, prompt_id) of a .jsonl file, or of any other file that holds a JSON array of strings or objects; no
    prompts: ValueError."""
    if path.endswith(".jsonl"):
        rows = parse_prompt_lines(_lines(spark, path), ["question"])
    else:
        whole = spark.read.text(path, wholetext=True)
        rows = _required(whole.select(F.inline(parse_prompt_array(F.col("value")))), ["question"], "prompt").select("ordinal", "question", "prompt_id")
    return _not_empty(rows, "prompts")


def load_consistency_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, question, follow_up, prompt_id) of a .jsonl file; no prompts: ValueError."""
    return _not_empty(parse_prompt_lines(_lines(spark, path), ["question", "follow_up"]), "prompts")


def load_personae(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, persona, category, article) of a JSON array; other keys are dropped; a missing key is an error."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", f"array<struct<{PERSONA.replace(' string', ':string')}>>", {"mode": "FAILFAST"})).alias("ordinal", "p"))
    rows = items.select(F.col("ordinal").cast("bigint").alias("ordinal"), "p.*")
    return _not_empty(_required(rows, ["persona", "category", "article"], "persona"), "personae")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(value, j) of the non-blank lines: j is the parsed row with _corrupt_record, which is null if the line is whole."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))


def load_results(spark: SparkSession, path: str, schema: str = RESULT, strict: bool = False) -> DataFrame:
    """Result rows of .jsonl files (a file, a directory or a pattern), or of a .json array; extra keys are dropped.

    Torn lines, as an interrupted append leaves them, are left out; strict: they are an error. A torn array is an error.
    """
    if strict or path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", path.endswith(".json")).option("mode", "FAILFAST").json(path)
    return _parsed(spark, path, schema).where("j._corrupt_record is null").select("j.*").drop("_corrupt_record")


def load_consistency_results(spark: SparkSession, path: str) -> DataFrame:
    return load_results(spark, path, CONSISTENCY_RESULT)


def torn_lines(spark: SparkSession, path: str, schema: str = RESULT) -> DataFrame:
    """(value): the lines that load_results leaves out."""
    return _parsed(spark, path, schema).where("j._corrupt_record is not null").select("value")


def discover_runs(files: DataFrame) -> DataFrame:
    """(directory, path, rank) of result files, given their paths: of each directory results.jsonl, else results.json. rank
    numbers the runs from 0 in descending order of their paths, as a list of runs shows them."""
    named = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    kinds = named.where(F.col("file").isin("results.jsonl", "results.json")).groupBy("directory")
    # "results.jsonl" is the greater of the two names
    chosen = kinds.agg(F.max("path").alias("path"))
    return numbered(chosen, F.desc("path"), F.asc("directory"), name="rank")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of files by a glob pattern; their contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


def find_runs(spark: SparkSession, base: str) -> DataFrame:
    """discover_runs() of the folders below `base`."""
    return discover_runs(list_files(spark, f"{base}/*/results.json*"))


def append_results(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, one new file per task: readers see whole files only."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def count_results(spark: SparkSession, path: str) -> int:
    """Number of non-blank lines; 0 where nothing was written yet."""
    if not exists(spark, path):
        return 0
    lines = spark.read.text(path)
    return lines.where(F.trim("value") != "").count()


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_config(config: dict, path: str, spark: SparkSession) -> None:
    """The run's settings as a small pretty-printed JSON file beside its results, on the results' file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(json.dumps(config, indent=2, sort_keys=True).encode()))
    out.close()


def load_config(path: str, spark: SparkSession) -> dict | None:
    """The saved settings; None where there are none."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
