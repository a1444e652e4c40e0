from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.operators import grid, variance


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(0, "fox", "beast", "a"), (1, "owl", "beast", "an"), (2, "ada", "person", "none")], "ordinal long, persona string, category string, article string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, f"q{i}", 10 + i) for i in range(4)], "ordinal long, question string, prompt_id long")


def test_grid_and_resume(people, questions):
    tasks = grid.task_grid(people, questions, 2)
    assert tasks.count() == 24
    done = tasks.where("prompt_id = 10 or persona = 'owl'")
    left = grid.remaining_tasks(tasks, done.unionByName(done))
    assert left.count() == 24 - done.count()
    assert left.join(done, grid.TASK_KEY, "left_semi").count() == 0
    assert grid.remaining_tasks(left, left).count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        grid.task_grid(people, questions, 0)


@pytest.mark.parametrize(("block", "repetitions"), [(65_536, 1), (3, 1), (3, 2)])
def test_remaining_by_persona_without_the_grid(spark, monkeypatch, block, repetitions):
    """The same as counting what is left of the grid, with repeated and null personae and prompts and foreign results."""
    monkeypatch.setattr(grid.running_total, "__defaults__", (block,))
    people = spark.createDataFrame([(x, "a", i) for i, x in enumerate(["fox", "owl", "owl", "ada", "eve", None])], "persona string, article string, ordinal long")
    asked = spark.createDataFrame([(x, i) for i, x in enumerate([*range(10, 18), 12, None])], "prompt_id long, ordinal long")
    some = [("fox", x, r) for x in (10, 11, 12, 13, 15) for r in (0, 1)] + [("owl", x, 0) for x in range(11, 18)] + [("ada", x, r) for x in range(10, 18) for r in (0, 1)]
    done = spark.createDataFrame(some + some[:3] + [("zoe", 10, 0), ("eve", 99, 0), ("eve", 10, 7), (None, 10, 0), ("eve", None, 0)], "persona string, prompt_id long, rep_idx long")
    for q in (asked, asked.where("prompt_id is not null"), asked.limit(0)):
        want = grid.remaining_tasks(grid.task_grid(people, q, repetitions), done).groupBy("persona").agg(F.count("*").alias("n"), F.min("prompt_id").alias("p"))
        got = grid.remaining_by_persona(people, q, done, repetitions)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fractions_take_the_ceiling_of_doubles(spark):
    df = spark.range(100).select(F.col("id").alias("ordinal"), F.lit("c").alias("c"))
    assert grid.first_fraction(df, 0.07).count() == 8  # 100 * 0.07 is just above 7
    assert grid.first_fraction_by(df, "c", 0.07).count() == 8
    assert grid.first_fraction(df, 1e-9).count() == 1
    assert grid.first_fraction(df, 1.0).count() == 100
    with pytest.raises(ValueError, match="positive"):
        grid.first_fraction(df, 0.0)


def test_fraction_by_group_keeps_first_seen_order(people):
    got = grid.first_fraction_by(people, "category", 0.5).orderBy("group_ordinal", "ordinal").collect()
    assert [r.persona for r in got] == ["fox", "ada"]


def test_batches(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "persona string, n int")
    got = {(r.persona, r.n): r.batch_no for r in grid.persona_batches(df.withColumn("ordinal", F.when(F.col("persona") == "b", 99).otherwise(F.col("n"))), 2).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0}
    assert grid.batch_count(df, 2).first().batches == 4
    assert grid.batch_count(df.limit(0), 2).first().batches == 0


def test_running_total_over_blocks(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "hot", i * 7, i % 2) for i in range(300)], "g string, n long, v int")
    got = {(r.g, r.n): r.t for r in grid.running_total(df, "g", "n", F.col("v"), "t", block=50).collect()}
    for g in (None, "hot"):
        total = 0
        for i in range(300):
            if (None if i % 3 == 0 else "hot") == g:
                total += i % 2
                assert got[g, i * 7] == total
    assert len(got) == 300


def test_reset_and_steps(spark):
    df = spark.createDataFrame([("s", i, i in (2, 4)) for i in range(6)], "s string, i int, r boolean")
    assert [r.epoch for r in grid.reset_epochs(df, "s", "i", F.col("r")).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]
    steps = df.select(F.lit(1).alias("b"), "s", "i", "r")
    assert grid.steps_run(steps, "b", "s", "i", F.col("r")).count() == 3


def test_total_variance(spark):
    rows = [(1, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [5.0, 5.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (1, None)]
    got = {r.k: (r.total_variance, r.n_samples) for r in variance.total_variance(spark.createDataFrame(rows, "k int, v array<float>"), ["k"], "v").collect()}
    assert got == {1: (4.0, 2), 2: (None, 1), 3: (0.0, 2)}


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<float>")
    with pytest.raises(Exception, match="different lengths"):
        variance.total_variance(df, ["k"], "v").collect()


def test_columns_and_lookups(spark):
    df = spark.createDataFrame([(1, "p", [1.0]), (1, "p", [3.0]), (2, "q", [1.0])], "prompt_id int, persona string, embedding_x array<float>")
    assert variance.embedding_columns(df.withColumn("embedding", F.lit(1))) == ["embedding_x"]
    look = spark.createDataFrame([("p", "old", 0), ("p", "new", 1)], "persona string, category string, ordinal int")
    got = variance.variance_records(df, ["prompt_id", "persona"], ["embedding_x"], {"persona": (look, "category", "unknown")}).collect()
    assert {(r.prompt_id, r.category, r.total_variance) for r in got} == {(1, "new", 2.0), (2, "unknown", None)}


def test_variance_ranks_of_a_hot_prompt(spark, tmp_path):
    from tessella.plans.summaries import variance_ranks

    rows = [(7, "e", f"p{i:04d}", float(i * 37 % 500)) for i in range(2000)] + [(8, "e", "a", 1.0), (8, "e", "b", 2.0), (8, "e", "c", None), (None, "e", "a", 1.0), (8, "f", "a", float("nan"))]
    spark.createDataFrame(rows, "prompt_id long, embedding_column string, persona string, total_variance double").write.parquet(str(tmp_path / "embedding_variance.parquet"))
    hot = sorted(rows[:2000], key=lambda r: (-r[3], r[2]))
    want = {(7, p): i for i, (*_, p, _) in enumerate(hot, 1)} | {(8, "b"): 1, (8, "a"): 2}
    got = variance_ranks(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.prompt_id, r.persona): r.rank_no for r in got} == want
