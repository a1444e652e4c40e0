"""Percentiles per group with bounded rank error, from merging centroid digests.

A digest of a group is a list of centroids (mean, weight). Values are sorted and clustered by the arcsine size function: the
centroid that holds quantile q has number floor(DELTA / 2pi * (asin(2q - 1) + pi / 2)), so clusters are small at the ends
and hold at most about pi / DELTA of the values in the middle; groups of up to DELTA / pi values keep every value. Digests
merge by clustering their centroids again with the same function, in any order and number: tasks, runs or days. All groups
of a batch are clustered at once, with array operations. A second pass over the rows counts, for every estimate, the values
below and up to it: its true rank error. Groups with an error above the bound are digested again four times as finely, and
those that still have one get their exact percentiles, by counting (see operators.ranks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ranks import exact_percentiles, with_groups
from tessella.session import materialise, ship

#: Fineness of the digests: at most DELTA / 2 centroids a group.
DELTA = 400
#: Largest rank error, as a share of the group's values, that goes uncorrected.
BOUND = 0.01
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Centroids that a task gathers before it clusters them.
GATHERED = 500_000
#: Groups (about 200 bytes each) whose estimates are broadcast for the counting pass; see operators.ranks.with_groups.
BROADCAST_GROUPS = 2_000
#: Digests of a group that one task merges at most, about: of more tasks, digests are merged in a tree.
FAN_IN = 64

_GROUP = ("dim", "key", "slice", "metric")
_DIGEST = "dim string, `key` string, slice string, metric string, mean double, weight bigint"


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of all groups, clustered and in order of (group, mean). group: non-negative integers."""
    if not len(group):
        return group, mean, weight
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order].astype("float64")
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    before = np.cumsum(weight) - weight
    inside = before - np.repeat(before[first], sizes)
    total = np.repeat(np.add.reduceat(weight, first), sizes)
    number = np.floor(delta / (2 * np.pi) * (np.arcsin(np.clip(2 * (inside + weight / 2) / total - 1, -1, 1)) + np.pi / 2))
    same = (group[1:] == group[:-1]) & (number[1:] == number[:-1]) & (np.isfinite(mean[1:]) == np.isfinite(mean[:-1]))
    at = np.flatnonzero(np.r_[True, ~same])
    mass = np.add.reduceat(weight, at)
    # around the cluster's first value, so that large means lose no digits
    base = mean[at]
    off = np.where(np.isfinite(mean), mean - np.repeat(base, np.diff(np.r_[at, len(mean)])), 0.0)
    return group[at], base + np.add.reduceat(off * weight, at) / mass, np.rint(mass).astype("int64")


def _cluster_frame(f: pd.DataFrame, delta: float, keys: tuple[str, ...] = _GROUP) -> pd.DataFrame:
    if f.empty:
        return f
    groups = f.groupby(list(keys), sort=False, dropna=False)
    ids = groups.ngroup().to_numpy()
    names = f[list(keys)].iloc[np.unique(ids, return_index=True)[1]].reset_index(drop=True)
    g, m, w = cluster(ids, f["mean"].to_numpy("float64"), f["weight"].to_numpy("int64"), delta)
    out = pd.concat([names.iloc[g].reset_index(drop=True), pd.DataFrame({"mean": m, "weight": w})], axis=1)
    return out[[*_GROUP, "mean", "weight", *keys[len(_GROUP) :]]]


def digest(df: DataFrame, dims: list[str], metrics: list[str], slice_by: Column | None = None, delta: float = DELTA) -> DataFrame:
    """Centroids (dim, key, slice, metric, mean, weight) of every metric by each of the dims, and by slice within it.

    key is the dim's value as a string, slice that of `slice_by` (a run, a day). Null keys and slices are groups of their
    own. Null and NaN are no values; infinite values are, and share no centroid with finite ones. A group without values
    has no centroids, nor has an empty table. The result is partial: a group's centroids come from several tasks, and
    `merge` makes one digest of them. Other columns are ignored.
    """
    ship(df.sparkSession)
    cols = [F.col(c).cast("string").alias(f"d{i}") for i, c in enumerate(dims)] + [(F.lit(None) if slice_by is None else slice_by).cast("string").alias("slice")]
    rows = df.select(*cols, *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            for j, metric in enumerate(metrics):
                own = b[b[f"m{j}"].notna()]
                for i, dim in enumerate(dims):
                    held.append(pd.DataFrame({"dim": dim, "key": own[f"d{i}"], "slice": own["slice"], "metric": metric, "mean": own[f"m{j}"], "weight": 1}))
                    size += len(own)
            if size >= GATHERED:
                held = [_cluster_frame(pd.concat(held, ignore_index=True), delta)]
                if (size := len(held[0])) >= GATHERED // 2:  # so many groups that holding them gains nothing
                    yield held.pop()
                    size = 0
        if held:
            yield _cluster_frame(pd.concat(held, ignore_index=True), delta)

    return rows.mapInPandas(partial, _DIGEST)


def _by_group(centroids: DataFrame, use: Callable[[pd.DataFrame], pd.DataFrame], schema: str, delta: float, keys: tuple[str, ...] = _GROUP) -> DataFrame:
    """use(frame) over whole groups: each group's centroids come sorted into one partition and are handed on in batches,
    of which the last group is held back, clustered, until its end is seen. Memory stays at a batch and one digest."""
    ship(centroids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            if b.empty:
                continue
            f = b if held is None else pd.concat([held, b], ignore_index=True)
            last = f[list(keys)].iloc[-1]
            tail = np.ones(len(f), bool)
            for c in keys:
                tail &= (f[c].isna() if pd.isna(last[c]) else f[c] == last[c]).to_numpy()
            held = f[tail].reset_index(drop=True)
            if len(held) > 8 * delta:
                held = _cluster_frame(held, 4 * delta, keys)
            if not tail.all():
                yield use(f[~tail])
        if held is not None:
            yield use(held)

    return centroids.select(*keys, "mean", "weight").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _tree(centroids: DataFrame, delta: float) -> DataFrame:
    """centroids of at most FAN_IN tasks a group: those of FAN_IN tasks are merged into one digest, layer by layer, so that a
    group that every task has a digest of doesn't bring all of them into one task."""
    keys = (*_GROUP, "task")
    held = materialise(centroids.select(*_GROUP, "mean", "weight", F.spark_partition_id().alias("task")))
    tasks = (held.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > FAN_IN:
        bundled = held.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        held = materialise(_by_group(bundled, lambda f: _cluster_frame(f, delta, keys), f"{_DIGEST}, task int", delta, keys))
        tasks = -(-tasks // FAN_IN)
    return held.drop("task")


def merge(*digests: DataFrame, over_slices: bool = False, delta: float = DELTA) -> DataFrame:
    """One digest a group from any number of digests; over_slices: one for all slices together (slice is null then)."""
    both = digests[0]
    for d in digests[1:]:
        both = both.unionByName(d)
    if over_slices:
        both = both.withColumn("slice", F.lit(None).cast("string"))
    return _by_group(_tree(both, delta), lambda f: _cluster_frame(f, delta), _DIGEST, delta)


def estimates(digests: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, delta: float = DELTA) -> DataFrame:
    """(dim, key, slice, metric, n, est: array of the percentiles) of merged or partial digests."""

    def use(f: pd.DataFrame) -> pd.DataFrame:
        f = _cluster_frame(f, delta)
        ids = f.groupby(list(_GROUP), sort=False, dropna=False).ngroup().to_numpy()
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = f.iloc[at][list(_GROUP)].reset_index(drop=True)
        mean, weight = f["mean"].to_numpy(), f["weight"].to_numpy()
        n, est = [], []
        for a, b in zip(at, np.r_[at[1:], len(f)], strict=True):
            w = weight[a:b]
            total = int(w.sum())
            ranks = np.cumsum(w) - w + (w - 1) / 2  # the middle rank of each centroid, from 0
            n.append(total)
            est.append(np.interp(np.array(percentiles) * (total - 1), ranks, mean[a:b]).tolist())
        return out.assign(n=n, est=est)

    return _by_group(_tree(digests, delta), use, "dim string, `key` string, slice string, metric string, n bigint, est array<double>", delta)


def certified(df: DataFrame, est: DataFrame, dims: list[str], metrics: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Each estimate over all slices with its true rank error: (dim, key, metric, n, p, estimate, rank_error).

    The exact percentile stands at rank t = p (n - 1), counted from 0. An estimate with `below` values under it and `upto`
    values not above it stands between ranks below - 1 and upto; rank_error is how far t lies outside, divided by n.
    """
    parts: list[DataFrame] = []
    for dim in dims:
        held = est.where(F.col("dim") == dim)
        own = held.groupBy("key").pivot("metric", metrics).agg(F.first("est").alias("e"), F.max("n").alias("n"))
        sizes = F.greatest(*[F.coalesce(f"`{m}_n`", F.lit(0)) for m in metrics], F.lit(0))
        own = own.select(F.struct(F.col("key").alias("k")).alias("g"), sizes.alias("size"), *[F.col(f"`{m}_e`").alias(f"e{j}") for j, m in enumerate(metrics)])
        total = held.groupBy("metric").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = df.select(F.struct(F.col(dim).cast("string").alias("k")).alias("g"), *[F.col(m).cast("double").alias(f"m{j}") for j, m in enumerate(metrics)])
        joined = with_groups(rows, own, total, most=BROADCAST_GROUPS)
        sums = []
        for j in range(len(metrics)):
            value = F.when(~F.isnan(f"m{j}"), F.col(f"m{j}"))
            for i in range(len(percentiles)):
                e = F.get(f"e{j}", F.lit(i))
                sums += [F.count_if(value < e).alias(f"b{j}_{i}"), F.count_if(value <= e).alias(f"u{j}_{i}")]
        counted = joined.groupBy("g").agg(*sums)
        for j, m in enumerate(metrics):
            pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"b{j}_{i}").alias("below"), F.col(f"u{j}_{i}").alias("upto"), F.lit(i).alias("i")) for i, p in enumerate(percentiles)])
            parts.append(counted.select(F.lit(dim).alias("dim"), F.col("g.k").alias("key"), F.lit(m).alias("metric"), F.explode(pairs).alias("c")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    out = est.alias("e").join(counts.alias("c"), F.expr("e.dim = c.dim and e.key <=> c.key and e.metric = c.metric"))
    t = F.col("c.c.p") * (F.col("e.n") - 1)
    off = F.greatest(F.lit(0.0), F.col("c.c.below") - 1 - t, t - F.col("c.c.upto")) / F.col("e.n")
    return out.select("e.dim", "e.key", "e.metric", "e.n", F.col("c.c.p").alias("p"), F.get("e.est", F.col("c.c.i")).alias("estimate"), off.alias("rank_error"))


def percentiles(
    df: DataFrame, dims: list[str], metrics: list[str], slice_by: Column | None = None, ps: tuple[float, ...] = PERCENTILES,
    delta: float = DELTA, bound: float = BOUND, rounds: int = 3,
) -> DataFrame:
    """(dim, key, metric, n, p, estimate, rank_error) for each value of each dim; rank_error is counted, not assumed.

    Digests are made by slice and merged. Where a counted error exceeds the bound, the group is digested again with a
    delta four times as large, `rounds` times in all; what is still beyond it then is replaced by the exact percentiles, so
    that no error exceeds the bound. Nulls, NaN and infinities: see digest(). Groups without
    values and empty tables give no rows.
    """
    same = F.expr("r.dim = b.dim and r.key <=> b.key and r.metric = b.metric")
    done: list[DataFrame] = []
    bad: DataFrame | None = None
    for k in range(rounds):
        fine = delta * 4**k
        parts = digest(df, dims, metrics, slice_by, fine)
        if bad is not None:
            parts = parts.alias("r").join(bad.alias("b"), same, "left_semi")
        est = materialise(estimates(parts.withColumn("slice", F.lit(None).cast("string")), ps, fine))
        result = materialise(certified(df, est, dims, metrics, ps))
        bad = result.where(F.col("rank_error") > bound).select("dim", "key", "metric").distinct()
        if bad.isEmpty():
            done.append(result)
            break
        done.append(result.alias("r").join(bad.alias("b"), same, "left_anti"))
    else:
        each = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for d in dims for m in metrics]
        left = df.select(F.explode(F.array(*each)).alias("r")).select("r.*").alias("r").join(bad.alias("b"), same, "left_semi")
        exact = exact_percentiles(left, ["dim", "key", "metric"], "x", ps)
        pairs = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("q").alias("e"))).alias("v")
        done.append(exact.select("dim", "key", "metric", "n", pairs).select("dim", "key", "metric", "n", "v.p", F.col("v.e").alias("estimate"), F.lit(0.0).alias("rank_error")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
