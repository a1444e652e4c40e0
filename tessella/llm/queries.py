"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.leakage import leaks
from tessella.llm.percentiles import digest, merge, percentiles
from tessella.llm.subjects import main_subjects, subjects_of
from tessella.llm.tokens import encode_column
from tessella.llm.topn import top_n
from tessella.llm.truncation import judged, truncated
from tessella.session import table

#: Where the public vocabularies are; never copied.
TOKENIZERS = "/opt/tokenizers"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged texts of results and consistency_results, with what their runs say of the generation."""
    runs = table(spark, sf_dir, "run_configs").select("run_id", "max_tokens").dropDuplicates(["run_id"])
    one = table(spark, sf_dir, "results").select(F.lit("results").alias("source"), "ordinal", "run_id", "question", F.col("response").alias("text"), "num_tokens")
    two = table(spark, sf_dir, "consistency_results").select(
        F.lit("consistency_results").alias("source"), "ordinal", "run_id", F.col("follow_up").alias("question"), F.col("response2").alias("text"), F.col("response2_num_tokens").alias("num_tokens")
    )
    return one.unionByName(two).join(runs, "run_id", "left")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as a second system holds them: not judged, but some are longer than their copies."""
    return table(spark, sf_dir, "results_copy").select(F.col("response").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncated(_answers(spark, sf_dir), _copies(spark, sf_dir))
    return found.select(F.col("source").alias("source_table"), "ordinal", F.when(F.col("source") == "results", "response").otherwise("response2").alias("field"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the answers of each run are cut, and by which evidence."""
    by = judged(_answers(spark, sf_dir), others=_copies(spark, sf_dir)).groupBy("source", "run_id", F.coalesce("evidence", F.lit("whole")).alias("evidence")).agg(F.count("*").alias("n"))
    total = by.groupBy("source", "run_id").agg(F.sum("n").alias("answers"))
    return by.alias("b").join(total.alias("t"), F.expr("b.source = t.source and b.run_id <=> t.run_id")).select(
        "b.source", "b.run_id", "evidence", "n", "answers", (F.col("n") / F.col("answers")).alias("share")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "embedding_variance"), ["prompt_id", "embedding_column"], "persona", "total_variance", 5).select(
        "prompt_id", "embedding_column", "persona", "rank_no"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = judged(_answers(spark, sf_dir), hints=True, others=_copies(spark, sf_dir))
    defect = F.when(F.col("truncated"), F.lit("truncated")).otherwise(F.col("hint"))
    return seen.select(F.col("source").alias("source_table"), "ordinal", defect.alias("defect")).where("defect is not null")


_P4 = ["category", "persona"], ["avg_entropy", "avg_top_k_mass"]


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(table(spark, sf_dir, "results"), *_P4, slice_by=F.col("run_id"))


def p4_digests_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest per category or persona and day, as stored for a later merge: its centroids in order."""
    daily = merge(digest(table(spark, sf_dir, "results"), *_P4, slice_by=F.to_date("finished_at")))
    centroids = F.sort_array(F.collect_list(F.struct("mean", "weight")))  # at most DELTA / 2 of them
    return daily.groupBy("dim", "key", "slice", "metric").agg(F.sum("weight").alias("n"), centroids.alias("centroids"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(texts, "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "ids")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects"))
    return subjects_of(*tables, excluded=table(spark, sf_dir, "eval_items").select("text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_subjects(_subjects(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and subject, and their share of the source's documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    all_of = docs.groupBy("source").agg(F.count("*").alias("documents"))
    n = main_subjects(_subjects(spark, sf_dir)).join(docs, "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n"))
    joined = n.alias("n").join(all_of.alias("a"), F.expr("n.source <=> a.source"))
    return joined.select("n.source", "subject", "n", "documents", (F.col("n") / F.col("documents")).alias("share"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p3_found": p3_found, "p4_percentiles": p4_percentiles, "p4_digests_by_day": p4_digests_by_day, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_shares": p8_shares}
SQL = {
    "p2_found": """
        WITH best AS (
            SELECT prompt_id, embedding_column, persona, max(total_variance) AS v FROM embedding_variance
            WHERE prompt_id IS NOT NULL AND persona IS NOT NULL AND total_variance IS NOT NULL AND NOT isnan(total_variance)
            GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, embedding_column ORDER BY v DESC, persona) AS rank_no FROM best)
        SELECT prompt_id, embedding_column, persona, rank_no FROM ranked WHERE rank_no <= 5""",
}
