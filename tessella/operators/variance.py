"""Total variance of embedding groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedding_columns(df: DataFrame, bare: bool = False) -> list[str]:
    """Columns whose names start with "embedding_"; with `bare` also "embedding" itself."""
    return [c for c in df.columns if c.startswith("embedding_") or bare and c == "embedding"]


def total_variance(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys..., total_variance, n_samples): the trace of each group's sample covariance.

    Vectors are summed by dimension with partial aggregation, so the shuffle carries one row per group, dimension and
    task. Rows with a null in a key or vector are left out; a group of one row has a null variance; groups with vectors
    of different lengths raise an error.
    """
    rows = df.select(*keys, vector).dropna(subset=[*keys, vector])
    long = rows.select(*keys, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("d", "x"))
    per_dim = long.groupBy(*keys, "d").agg(F.var_samp("x").alias("v"), F.count("*").alias("n"))
    out = per_dim.groupBy(*keys).agg(F.sum("v").alias("total_variance"), F.max("n").alias("n_samples"), F.min("n").alias("_least"))
    checked = F.when(F.col("_least") < F.col("n_samples"), F.raise_error(F.lit("vectors of different lengths")).cast("bigint")).otherwise(F.col("n_samples"))
    return out.withColumn("n_samples", checked).drop("_least")


def variance_records(df: DataFrame, keys: list[str], columns: list[str], lookups: dict[str, tuple[DataFrame, str, str | None]] | None = None) -> DataFrame:
    """(keys..., embedding_column, total_variance, n_samples, looked-up columns) for every group and embedding column.

    lookups: key column -> (table with key and value, value column, value where the key is missing). Duplicate keys of a
    lookup: the last by its `ordinal` counts.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("embedding_column"), F.col(c).alias("_v")) for c in columns])).alias("e")
    long = df.select(*keys, each).select(*keys, "e.*")  # all columns in one pass
    out = total_variance(long, [*keys, "embedding_column"], "_v")
    for key, (look, value, missing) in (lookups or {}).items():
        last = look.groupBy(key).agg(F.max_by(value, "ordinal").alias(value))
        out = out.join(last, key, "left")
        if missing is not None:
            out = out.withColumn(value, F.coalesce(value, F.lit(missing)))
    return out.select(*keys, "embedding_column", "total_variance", "n_samples", *[v for _, v, _ in (lookups or {}).values()])
