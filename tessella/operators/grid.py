"""Experiment grids: tasks, subsets, what is left to do, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import system_prompt
from tessella.operators.ranks import values_at
from tessella.session import materialise

TASK_KEY = ["persona", "prompt_id", "rep_idx"]
#: Consecutive ordinals whose rows are ordered together.
BLOCK = 65_536


def numbered(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """df with the place of each row, from 0, in a total order.

    The table is sorted in ranges, and a row's number is its place in its range plus the rows of earlier ranges: no task sees
    more than a range.
    """
    at = F.monotonically_increasing_id()
    ranges = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = ranges.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    return ranges.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def task_grid(personae: DataFrame, prompts: DataFrame, repetitions: int, rep: str = "rep_idx", style: str = "you-are-a") -> DataFrame:
    """personae x prompts x repetitions with a system prompt each; a task's number orders by persona, prompt, repetition.

    A cross product is what a full grid is; the smaller side (prompts) is left to the optimizer to broadcast. personae and
    prompts need an `ordinal`, their place in the file.
    """
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    p = personae.withColumnRenamed("ordinal", "persona_ordinal").withColumn("system_prompt", system_prompt(F.col("persona"), F.col("article"), style))
    q = prompts.withColumnRenamed("ordinal", "prompt_ordinal")
    return p.crossJoin(q).withColumn(rep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(repetitions - 1).cast("bigint"))))


def remaining_tasks(tasks: DataFrame, done: DataFrame, key: list[str] = TASK_KEY) -> DataFrame:
    """Tasks whose key no finished row has."""
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def finished_tasks(done: DataFrame, personae: DataFrame, prompts: DataFrame, repetitions: int, rep: str = "rep_idx") -> DataFrame:
    """(persona, prompt_id, rep) of the finished rows that the grid of personae, prompts and repetitions has. The grid itself is
    never built: a key is in it if each of its parts is known."""
    keys = done.select("persona", "prompt_id", rep).where(F.col(rep).between(0, repetitions - 1)).distinct()
    return keys.join(personae, "persona", "left_semi").join(prompts, "prompt_id", "left_semi").select("persona", "prompt_id", rep)


def remaining_by_persona(personae: DataFrame, prompts: DataFrame, done: DataFrame, repetitions: int, rep: str = "rep_idx") -> DataFrame:
    """(persona, remaining, first_prompt): how many tasks of the grid of personae, prompts and repetitions no finished row has,
    and the least prompt_id among them; personae with nothing left give no row.

    The grid itself is never built, as it grows with the product of its sides: what is left of a persona is the size of its
    part of the grid less its finished keys, and its first prompt is the one behind those that are finished from the least
    prompt_id on without a gap. Repeated personae and prompts have their tasks each; a null of either is never finished.
    """
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    people = personae.groupBy("persona").agg(F.count("*").alias("_people"))
    asked = materialise(numbered(prompts.where("prompt_id is not null").groupBy("prompt_id").agg(F.count("*").alias("_times")), "prompt_id", name="_place"))
    keys = finished_tasks(done, personae, prompts, repetitions, rep).groupBy("persona", "prompt_id").agg(F.count("*").alias("_reps"))
    placed = running_total(keys.join(asked, "prompt_id"), "persona", "_place", F.when(F.col("_reps") == repetitions, 1).otherwise(0), "_whole")
    ended = placed.groupBy("persona").agg(F.sum(F.col("_times") * F.col("_reps")).alias("_done"), F.count_if(F.col("_whole") == F.col("_place") + 1).alias("_place"))
    counted = people.join(ended, "persona", "left").withColumn("_place", F.coalesce("_place", F.lit(0).cast("bigint")))
    left = counted.withColumn("remaining", F.col("_people") * (F.lit(prompts.count() * repetitions) - F.coalesce("_done", F.lit(0)))).where("remaining > 0")
    return left.join(asked, "_place", "left").select("persona", "remaining", F.col("prompt_id").alias("first_prompt"))


def first_fraction(df: DataFrame, fraction: float, ordinal: str = "ordinal") -> DataFrame:
    """The first ceil(n * fraction) rows in file order; all for a fraction of 1 or more."""
    if fraction <= 0:
        raise ValueError("fraction must be positive")
    if fraction >= 1:
        return df
    keep = _ceil(df.count(), fraction)
    rows = df.select(F.struct(F.lit(0)).alias("g"), F.col(ordinal).cast("bigint").alias("code"))
    last = df.sparkSession.range(1).select(F.struct(F.lit(0)).alias("g"), F.lit(keep - 1).cast("bigint").alias("rank"))
    cut = values_at(rows, last).select(F.col("code").alias("_cut"))  # the last row's ordinal, found by counting
    return df.join(F.broadcast(cut), F.col(ordinal) <= F.col("_cut")).drop("_cut")  # a single row


def _ceil(n: int, fraction: float) -> int:
    import math

    return math.ceil(n * fraction)


def running_total(df: DataFrame, group: str, ordinal: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """df with `out`: the sum of value over the group's rows up to and with this one, in order of the ordinal.

    Ordinals are unique, so a block of consecutive ones holds at most `block` rows: rows are ordered within group and block,
    and a group's blocks by their sums, so that a group of any size never comes into one task. A null group is a group.
    """
    at = df.withColumn("_b", F.floor(F.col(ordinal) / block)).withColumn("_v", value)
    sums = at.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_sb")).agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_g", "_sb", F.coalesce(before, F.lit(0)).alias("_o"))
    joined = at.join(offsets, at[group].eqNullSafe(F.col("_g")) & (at["_b"] == F.col("_sb")))
    own = F.sum("_v").over(Window.partitionBy("_g", "_b").orderBy(ordinal))
    return joined.withColumn(out, own + F.col("_o")).drop("_b", "_v", "_g", "_sb", "_o")


def first_fraction_by(df: DataFrame, group: str, fraction: float, ordinal: str = "ordinal") -> DataFrame:
    """Per group the first ceil(n * fraction) rows in file order, with group_ordinal, the place of the group's first row.

    Sorted by (group_ordinal, ordinal) the result is in order of the groups' first appearance.
    """
    if fraction <= 0:
        raise ValueError("fraction must be positive")
    sizes = df.groupBy(F.col(group).alias("_key")).agg(F.count("*").alias("_n"), F.min(ordinal).alias("group_ordinal"))
    placed = running_total(df, group, ordinal, F.lit(1), "_i")
    numbered = placed.join(sizes, placed[group].eqNullSafe(F.col("_key"))).drop("_key")
    kept = numbered if fraction >= 1 else numbered.where(F.col("_i") <= F.ceil(F.col("_n") * F.lit(float(fraction))))
    return kept.drop("_n", "_i")


def persona_batches(tasks: DataFrame, size: int, ordinal: str = "ordinal", group: str = "persona") -> DataFrame:
    """tasks with batch_no: their group's chunks of `size` in order of the ordinal, from 0."""
    if size < 1:
        raise ValueError("size must be at least 1")
    placed = running_total(tasks, group, ordinal, F.lit(1), "_i")
    return placed.withColumn("batch_no", F.floor((F.col("_i") - 1) / size).cast("bigint")).drop("_i")


def batch_count(tasks: DataFrame, size: int, group: str = "persona") -> DataFrame:
    """(batches): sum over groups of ceil(n / size)."""
    return tasks.groupBy(group).agg(F.ceil(F.count("*") / F.lit(float(size))).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("batches"))


def reset_epochs(turns: DataFrame, session: str, order: str, is_reset: Column) -> DataFrame:
    """turns with epoch: how often the session's history was reset up to and with the turn. order: unique integers."""
    out = running_total(turns, session, order, F.when(is_reset, 1).otherwise(0), "epoch")
    return out.withColumn("epoch", F.col("epoch").cast("bigint"))


def steps_run(steps: DataFrame, batch: str, seq: str, step: str, is_end: Column) -> DataFrame:
    """The steps that batched generation runs: of each sequence while it isn't finished, that is up to its first end."""
    before = Window.partitionBy(batch, seq).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("_ended", F.coalesce(F.sum(F.when(is_end, 1).otherwise(0)).over(before), F.lit(0))).where("_ended = 0").drop("_ended")
