"""Comparison of two runs over the same tasks: pairs, classes, statistics, anomalies, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import bin_number, number, pearson, share
from tessella.operators.ranks import exact_percentiles
from tessella.session import materialise

KEY = ["persona", "prompt_id", "rep_idx"]
METRICS = ["avg_entropy", "avg_entropy_thinking", "avg_entropy_output", "avg_top_k_mass", "avg_top_k_mass_thinking", "avg_top_k_mass_output"]
FIELDS = ["prompt", "response", *METRICS, "num_tokens", "think_end_position"]
#: Fields of which a comparison needs only whether they are equal, and how long they are.
TEXTS = ("prompt", "response")
#: Difference below which an entropy that should be at least as large is an anomaly.
ANOMALY = -0.001


def text_id(c: Column | str) -> Column:
    """What stands for a text where only equality and length count: 128 bits of hash and the length; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2"), F.length(c).alias("chars")))


def latest(df: DataFrame, fields: list[str], key: list[str] = KEY, order: str = "ordinal") -> DataFrame:
    """(key..., fields...) of the last line of each key in file order; texts as text_id(). Lines with a null in the key are
    left out.

    Only the fields asked for are read and shuffled. Partial maxima on the map side keep a key that holds many lines from
    gathering in one task.
    """
    kept = df.dropna(subset=key)
    carried = F.struct(*[(text_id(f) if f in TEXTS else F.col(f)).alias(f) for f in fields])
    return kept.groupBy(*key).agg(F.max_by(carried, order).alias("_r")).select(*key, "_r.*")


def pairs(a: DataFrame, b: DataFrame, fields: list[str], key: list[str] = KEY) -> DataFrame:
    """(key..., <field>_a, <field>_b) of the keys that both runs have; texts as text_id()."""
    left, right = (latest(d, fields, key).withColumnsRenamed({f: f"{f}_{s}" for f in fields}) for d, s in ((a, "a"), (b, "b")))
    return left.join(right, key)


def with_class(paired: DataFrame) -> DataFrame:
    """paired with pair_class: different_response, same_text_diff_tokens or truly_identical; null equals null."""
    different = ~F.col("response_a").eqNullSafe(F.col("response_b"))
    tokens = ~F.col("num_tokens_a").eqNullSafe(F.col("num_tokens_b"))
    return paired.withColumn("pair_class", F.when(different, "different_response").when(tokens, "same_text_diff_tokens").otherwise("truly_identical"))


def with_entropy(paired: DataFrame) -> DataFrame:
    """Pairs of which both entropies are present, with entropy_a, entropy_b, diff (b - a) and rel (percent of b)."""
    a, b = number("avg_entropy_a"), number("avg_entropy_b")
    out = paired.withColumns({"entropy_a": a, "entropy_b": b}).where("entropy_a is not null and entropy_b is not null")
    diff = F.col("entropy_b") - F.col("entropy_a")
    return out.withColumns({"diff": diff, "rel": F.try_divide(diff, F.col("entropy_b")) * 100})


def class_counts(paired: DataFrame) -> DataFrame:
    """(pair_class, n, matched, percent): counts of the classes among pairs with entropies, against all matched pairs."""
    entropies = number("avg_entropy_a").isNotNull() & number("avg_entropy_b").isNotNull()
    classed = with_class(paired)
    # one line for all classes, so that the total needs no second pass
    kinds = ("different_response", "same_text_diff_tokens", "truly_identical")
    of = [F.struct(F.lit(k).alias("pair_class"), F.count_if((F.col("pair_class") == k) & entropies).alias("n"), F.count_if(F.col("pair_class") == k).alias("m")) for k in kinds]
    one = classed.agg(F.count("*").alias("matched"), F.array(*of).alias("k")).select("matched", F.explode("k").alias("k")).where("k.m > 0")
    return one.select("k.pair_class", "k.n", "matched", (F.col("k.n") / F.col("matched") * 100).alias("percent"))


def metric_stats(paired: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Per metric over the pairs that have it on both sides: n; mean and population deviation of a, b, their difference
    (b - a) and its percentage of b (mean of ratios); extremes; correlation."""
    sides = F.array(*[F.struct(F.lit(m).alias("metric"), number(f"{m}_a").alias("a"), number(f"{m}_b").alias("b")) for m in metrics])
    long = paired.select(F.explode(sides).alias("s")).select("s.*").where("a is not null and b is not null")
    long = long.withColumn("diff", F.col("b") - F.col("a")).withColumn("rel", F.try_divide(F.col("diff"), F.col("b")) * 100)
    aggs = [F.count("*").alias("n")]
    for c in ("a", "b", "diff", "rel"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    for c in ("diff", "rel"):
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return long.groupBy("metric").agg(*aggs, pearson(F.col("a"), F.col("b")).alias("corr"))


def response_agreement(paired: DataFrame) -> DataFrame:
    """One row: identical and different responses, and the mean and deviation of the difference in characters (b - a)."""
    same = F.col("response_a").eqNullSafe(F.col("response_b"))
    length = F.when(~same, F.col("response_b.chars") - F.col("response_a.chars"))
    return paired.agg(
        F.count_if(same).alias("identical"), F.count_if(~same).alias("different"),
        (F.try_divide(F.count_if(same), F.count("*")) * 100).alias("identical_percent"),
        F.avg(length).alias("length_diff_mean"), F.stddev_pop(length).alias("length_diff_std"),
    )


def entropy_by_agreement(paired: DataFrame) -> DataFrame:
    """Entropy differences of identical and of different responses."""
    grouped = with_entropy(paired).withColumn("identical", F.col("response_a").eqNullSafe(F.col("response_b"))).groupBy("identical")
    return grouped.agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean"), F.stddev_pop("diff").alias("std"), F.min("diff").alias("min"), F.max("diff").alias("max"),
        share(F.col("diff") > 0).alias("positive_percent"), share(F.col("diff") < 0).alias("negative_percent"),
    )


def ratio_of_means(paired: DataFrame) -> DataFrame:
    """One row: the mean difference of identical responses as a percentage of their mean entropy in b, zeros left out."""
    same = with_entropy(paired).where(F.col("response_a").eqNullSafe(F.col("response_b")))
    return same.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.avg(F.when(F.col("entropy_b") != 0, F.col("entropy_b"))).alias("mean_b")).withColumn(
        "percent", F.try_divide("mean_diff", "mean_b") * 100
    )


def diff_percentiles(paired: DataFrame, ps: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(pair_class, p, diff, rel): exact percentiles, interpolated, of the differences of each class."""
    long = with_entropy(with_class(paired)).select("pair_class", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in ("diff", "rel")])).alias("v"))
    q = exact_percentiles(long.select("pair_class", "v.c", "v.x"), ["pair_class", "c"], "x", ps)
    rows = q.select("pair_class", "c", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), "q")).alias("x"))
    wide = rows.groupBy("pair_class", F.col("x.p").alias("p")).pivot("c", ["diff", "rel"]).agg(F.first("x.q"))
    return wide.select("pair_class", "p", "diff", "rel")


def class_summary(paired: DataFrame) -> DataFrame:
    """Per class: n; mean, deviation, median, extremes, range and coefficient of variation of the difference; shares by
    sign; mean percentage; correlation; mean and deviation of the top-k mass difference."""
    mass = number("avg_top_k_mass_b") - number("avg_top_k_mass_a")
    rows = materialise(with_entropy(with_class(paired)).select("pair_class", "entropy_a", "entropy_b", "diff", "rel", mass.alias("mass_diff")))
    medians = exact_percentiles(rows, ["pair_class"], "diff", (0.5,)).select("pair_class", F.get("q", F.lit(0)).alias("median"))
    return (
        rows.groupBy("pair_class")
        .agg(
            F.count("*").alias("n"), F.avg("diff").alias("mean"), F.stddev_pop("diff").alias("std"),
            F.min("diff").alias("min"), F.max("diff").alias("max"), (F.max("diff") - F.min("diff")).alias("range"),
            (F.try_divide(F.stddev_pop("diff"), F.avg("diff")) * 100).alias("cv_percent"),
            share(F.col("diff") > 0).alias("positive_percent"), share(F.col("diff") < 0).alias("negative_percent"),
            F.avg("rel").alias("mean_rel"), F.stddev_pop("rel").alias("std_rel"), pearson(F.col("entropy_a"), F.col("entropy_b")).alias("corr"),
            F.avg("mass_diff").alias("mass_mean"), F.stddev_pop("mass_diff").alias("mass_std"),
        )
        .join(F.broadcast(medians), "pair_class")
    )


def token_differences(paired: DataFrame) -> DataFrame:
    """One row over the pairs of same text and different tokens: n, mean and extremes of tokens a - b, more, fewer."""
    same = with_entropy(with_class(paired)).where("pair_class = 'same_text_diff_tokens'")
    d = F.col("num_tokens_a") - F.col("num_tokens_b")
    return same.agg(
        F.count("*").alias("n"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"), F.count_if(d > 0).alias("more"), F.count_if(d < 0).alias("fewer")
    )


def anomalies(paired: DataFrame) -> DataFrame:
    """Pairs of one response whose entropy in b is smaller by more than 0.001."""
    return with_entropy(paired).where(F.col("response_a").eqNullSafe(F.col("response_b")) & (F.col("diff") < ANOMALY))


def anomaly_counts(paired: DataFrame) -> DataFrame:
    tokens = ~F.col("num_tokens_a").eqNullSafe(F.col("num_tokens_b"))
    thinking = ~F.col("think_end_position_a").eqNullSafe(F.col("think_end_position_b"))
    return anomalies(paired).agg(
        F.count("*").alias("n"), F.count_if(tokens).alias("token_count_differs"), F.count_if(~tokens).alias("token_count_same"), F.count_if(thinking).alias("think_position_differs")
    )


def extremes(rows: DataFrame, by: Column, n: int, key: list[str] = KEY) -> DataFrame:
    """The first n rows in order of `by`, ties by key: a total order, so the result doesn't depend on the partitions."""
    return rows.orderBy(by, *key).limit(n)


def histogram(values: DataFrame, x: str, bins: int, lo: float | None = None, hi: float | None = None, by: str | None = None) -> DataFrame:
    """(bin, lower, upper, n): counts of x in equal bins of [lo, hi], by default of its whole range; empty bins count 0.

    Bins are closed on the left, the last on both sides; values outside and nulls are left out. Where all values are
    equal, the range is widened by one half on either side. by: a boolean column, for a histogram of each of its values.
    """
    spark = values.sparkSession
    flag = F.lit(True) if by is None else F.col(by)
    present = values.select(number(x).alias("x"), flag.alias("by")).where("x is not null")
    if lo is None or hi is None:
        present = materialise(present)
        r = present.agg(F.min("x").alias("a"), F.max("x").alias("b"))
        same = F.col("a") == F.col("b")
        bounds = r.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    else:
        bounds = spark.range(1).select(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    at = present.crossJoin(F.broadcast(bounds)).select("by", bin_number(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))  # bounds: one row
    counts = at.where("bin is not null").groupBy("by", "bin").agg(F.count("*").alias("n"))
    flags = F.array(F.lit(True)) if by is None else F.array(F.lit(True), F.lit(False))
    frame = bounds.where("lo is not null").select("lo", "hi", F.explode(flags).alias("by")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    shown = [] if by is None else [F.col("by").alias(by)]
    return frame.join(counts, ["by", "bin"], "left").select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), *shown)
