"""Resumable runs as micro-batches: a file stream of tasks, answers appended once per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import RunConfig, configs_match
from tessella.operators.grid import TASK_KEY, remaining_tasks
from tessella.sources.files import exists, load_config, save_config


def resume_guard(spark: SparkSession, config: RunConfig) -> None:
    """Allows a run to go on only with the settings that it began with; saves them on the first start."""
    path = f"{config.output_dir}/config.json"
    saved = load_config(path, spark)
    if saved is None:
        save_config(config.to_dict(), path, spark)
    elif not configs_match(saved, config):
        raise ValueError(f"{config.output_dir} holds a run with other settings")


def run_stream(spark: SparkSession, tasks_dir: str, schema, output_dir: str, answer: Callable[[DataFrame], DataFrame], key: list[str] = TASK_KEY) -> int:
    """Answer all tasks that have arrived in tasks_dir (Parquet) and whose key output_dir lacks; returns batches run.

    The checkpoint remembers which files were read; as a batch may be delivered again after a failure, finished keys are
    left out inside the batch too. Output is Parquet by batch, written with overwrite of the batch's own folder, so a
    repeated batch replaces itself. Repeated keys within a batch are answered once.
    """
    stream = spark.readStream.schema(schema).parquet(tasks_dir)
    results = f"{output_dir}/results"
    ran: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        todo = batch.dropDuplicates(key)
        if exists(spark, results):
            done = spark.read.schema(f"{todo.select(*key)._jdf.schema().toDDL()}, batch int").option("basePath", results).parquet(results)
            todo = remaining_tasks(todo, done.where(F.col("batch") != number), key)  # only the keys' columns are read
        answer(todo).write.mode("overwrite").parquet(f"{results}/batch={number}")
        ran.append(number)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{output_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
