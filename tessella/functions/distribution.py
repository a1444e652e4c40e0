"""Entropy and top-k mass of token distributions held in arrays (logits) or maps (log-probabilities).

Higher-order functions see only their own element, so what is the same for all elements (the maximum, the normaliser) is
computed in a struct of its own first; otherwise it would be computed anew for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token that ends a thinking section; a fixed value of the tokenizer that the experiments use.
THINK_END_TOKEN = 151668


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def with_distribution(df: DataFrame, logits: str, prefix: str = "") -> DataFrame:
    """df with {prefix}lp (log-probabilities) and {prefix}p (probabilities) of a column of logits.

    Subtracting the maximum first keeps the exponentials finite. The maximum and the normaliser are columns of their own.
    """
    x = F.transform(logits, lambda v: v.cast("double"))
    shifted = df.withColumn("_x", x).withColumn("_m", F.array_max("_x")).withColumn("_x", F.transform("_x", lambda v: v - F.col("_m")))
    normal = shifted.withColumn("_z", F.log(_sum(F.transform("_x", F.exp))))
    logs = normal.withColumn(f"{prefix}lp", F.transform("_x", lambda v: v - F.col("_z")))
    return logs.withColumn(f"{prefix}p", F.transform(f"{prefix}lp", F.exp)).drop("_x", "_m", "_z")


def entropy(p: Column, lp: Column) -> Column:
    """-sum p log p, in nats; 0 for an empty distribution."""
    return -_sum(F.zip_with(p, lp, lambda a, b: a * b))


def largest(values: Column, k: int) -> Column:
    """The k largest elements, or all if fewer, in falling order."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def top_k_mass(p: Column, k: int) -> Column:
    """Sum of the k largest probabilities; k must be positive."""
    if k <= 0:
        raise ValueError("k must be positive")
    return _sum(largest(p, k))


def entropy_of_logprobs(lps: Column) -> Column:
    """-sum exp(lp) lp over the entries that were returned, without renormalising; 0 for none.

    An entry of minus infinity gives NaN (0 times infinity), as in floating-point arithmetic; see finite_only.
    """
    return F.coalesce(-_sum(F.transform(lps, lambda v: F.exp(v) * v)), F.lit(0.0))


def finite_only(lps: Column) -> Column:
    """Without entries of probability zero, which contribute nothing to an entropy."""
    return F.filter(lps, lambda v: v > F.lit(float("-inf")))


def top_k_mass_of_logprobs(lps: Column, k: int) -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.coalesce(_sum(F.transform(largest(lps, k), F.exp)), F.lit(0.0))


def argmax(values: Column) -> Column:
    """Index of the first largest element, from 0; null for an empty array."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)) - 1


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for each key: the same for the same seed, on every machine and in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def sampled(p: Column, u: Column) -> Column:
    """Index of the token that a multinomial draw takes, given a uniform number in [0, 1): the first at which the sum of the
    probabilities exceeds u; the last with a probability where rounding leaves none; null for an empty array."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(-1).alias("last"), F.lit(0).alias("i"))
    step = lambda a, x: F.struct(
        (a["sum"] + x).alias("sum"), F.when((a["at"] < 0) & (a["sum"] + x > u), a["i"]).otherwise(a["at"]).alias("at"),
        F.when(x > 0, a["i"]).otherwise(a["last"]).alias("last"), (a["i"] + 1).alias("i"),
    )
    return F.aggregate(p, start, step, lambda a: F.nullif(F.when(a["at"] >= 0, a["at"]).otherwise(a["last"]), F.lit(-1))).cast("bigint")


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    """v divided by its length, or by eps if that is greater; elements as doubles."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    return F.transform(F.arrays_zip(d.alias("d"), F.array_repeat(F.greatest(norm, F.lit(eps)), F.size(d)).alias("n")), lambda s: s["d"] / s["n"])


def last_token_pool(hidden: Column, mask: Column) -> Column:
    """The hidden state of a row's last real token: the last column if that is real (left padding), else the one at the
    count of real tokens."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(F.element_at(mask, -1) == 1, F.element_at(hidden, -1)).otherwise(F.get(hidden, n - 1))


def section_metrics(tokens: DataFrame, seq: str, pos: str, token: str, entropy: str, mass: str, think_end: int = THINK_END_TOKEN) -> DataFrame:
    """Per sequence the means of entropy and mass, over all tokens and by section.

    The thinking section reaches to the first end token, which it includes. Without one, thinking is null and output is
    all; if it is the last token, output is null. think_end_position counts from 0 in order of `pos`.
    """
    ends = F.when(F.col(token) == think_end, F.col(pos))
    at = tokens.groupBy(seq).agg(F.min(ends).alias("_end"), F.count("*").alias("num_tokens"))
    joined = tokens.join(at, seq)
    inside = F.col("_end").isNotNull() & (F.col(pos) <= F.col("_end"))
    aggs = []
    for name, col in (("avg_entropy", entropy), ("avg_top_k_mass", mass)):
        aggs += [
            F.avg(F.when(inside, F.col(col))).alias(f"{name}_thinking"),
            F.avg(F.when(~inside, F.col(col))).alias(f"{name}_output"),
            F.avg(col).alias(name),
        ]
    rank = F.sum(F.when(F.col(pos) < F.col("_end"), 1).otherwise(0))
    position = F.when(F.first("_end").isNotNull(), rank).alias("think_end_position")
    return joined.groupBy(seq).agg(*aggs, position, F.first("num_tokens").alias("num_tokens"))
