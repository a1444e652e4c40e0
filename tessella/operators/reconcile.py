"""Differences between two copies of a table, by invertible Bloom lookup tables.

Each side is reduced to (key hash, row hash) of the line that stands for its key. These pairs fall into buckets by key, and
every bucket has a lookup table: a pair is added by count and XOR to three of its cells. Adding the lines of one side with
+1 and of the other with -1 subtracts the tables, so equal pairs vanish however large the copies are. Peeling a bucket
(find a cell that holds one pair, note the pair, take it out of its other cells) lists the pairs that only one side has.
Only the rows of their keys are fetched and compared field by field. A bucket with more differences than its table can
give up is summed again with four times the cells and at last listed outright, so no difference is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise, ship, small_enough

#: Doubles that are further apart differ.
TOLERANCE = 1e-6
#: Keys that share a bucket, and cells in each of the three parts of its table. The cells hold about 1,200 pairs, that is
#: 600 changed keys of 4,096.
KEYS_PER_BUCKET, THIRD = 4096, 512
#: Differing keys (16 bytes each) up to which the list is broadcast; beyond, it is joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_PEELED = "k1 long, k2 long, bucket long, whole boolean"


def _grid_code(c: Column, tolerance: float) -> Column:
    """A code that only doubles within the tolerance share: their cell in a grid of that width. Null and NaN have own codes."""
    return (
        F.when(c.isNull(), F.lit(-(2**63)))
        .when(F.isnan(c), F.lit(-(2**63) + 1))
        .when(F.abs(c) < F.lit(4e18 * tolerance), F.floor(c / F.lit(tolerance)))
        .otherwise(F.xxhash64(c))
    )


def _row_hash(kinds: dict[str, str], fields: list[str], tolerance: float) -> Column:
    parts: list[Column] = []
    for f in fields:
        if kinds[f] in ("double", "float"):
            parts.append(_grid_code(F.col(f).cast("double"), tolerance))
        else:
            parts += [F.col(f), F.col(f).isNull()]  # xxhash64 passes over nulls: without this, shifted values look equal
    return F.xxhash64(*parts)


def _key_hashes(keys: list[str]) -> list[Column]:
    typed = [F.col(k).cast("string") for k in keys]
    return [F.xxhash64(*typed).alias("k1"), F.xxhash64(F.lit("again"), *reversed(typed)).alias("k2")]


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def representatives(df: DataFrame, keys: list[str], order: str, fields: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(k1, k2, h): hashes of key and row for the line with the highest `order` of each key.

    Only hashes are shuffled, after a maximum on the map side, so a key that holds a third of all lines is no load. Of
    lines with equal order, the one with the larger row hash stands.
    """
    return (
        _with_keys(df, keys)
        .select(*_key_hashes(keys), F.struct(F.col(order).alias("o"), _row_hash(dict(df.dtypes), fields, tolerance).alias("h")).alias("s"))
        .groupBy("k1", "k2")
        .agg(F.max("s").alias("s"))
        .select("k1", "k2", F.col("s.h").alias("h"))
    )


def _bucket(buckets: int) -> Column:
    return F.pmod("k2", F.lit(buckets).cast("long")).alias("bucket")


def subtracted_tables(left: DataFrame, right: DataFrame, buckets: int, third: int) -> DataFrame:
    """Cells of the subtracted tables that aren't empty: (bucket, cell, n, k1, k2, h, c).

    c is the hash of the whole pair; 16 bits of it choose each of the cells, and it tells a single pair from several.
    """
    pairs = left.withColumn("n", F.lit(1)).unionByName(right.withColumn("n", F.lit(-1)))
    c = F.xxhash64("k1", "k2", "h")
    bits = lambda i: F.shiftrightunsigned("c", 16 * i).bitwiseAND(F.lit(third - 1)) + F.lit(i * third)
    return (
        pairs.select(_bucket(buckets), "k1", "k2", "h", "n", c.alias("c"))
        .withColumn("cell", F.explode(F.array(*[bits(i).cast("int") for i in range(3)])))
        .groupBy("bucket", "cell")
        .agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in ("k1", "k2", "h", "c")])
        .where("n <> 0 or c <> 0 or h <> 0")
    )


def _pair_hash(k1: int, k2: int, h: int) -> int:
    """xxhash64(k1, k2, h) as Spark computes it: each value is hashed with the hash so far as the seed."""
    import xxhash

    seed = 42
    for x in (k1, k2, h):
        seed = xxhash.xxh64_intdigest((x & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed)
    return seed


def peel(cells: pd.DataFrame, third: int) -> tuple[list[tuple[int, int]], bool]:
    """Key hashes of the pairs that a bucket's subtracted table gives up, and whether it gave up all of them."""
    at = {int(r[0]): [int(x) for x in r[1:]] for r in cells[["cell", "n", "k1", "k2", "h", "c"]].itertuples(index=False)}
    found: list[tuple[int, int]] = []
    ready = [k for k, v in at.items() if abs(v[0]) == 1]
    while ready:
        cell = at.get(ready.pop())
        if cell is None or abs(cell[0]) != 1:
            continue
        n, k1, k2, h, c = cell
        u = c & 0xFFFFFFFFFFFFFFFF
        if _pair_hash(k1, k2, h) != u:
            continue
        found.append((k1, k2))
        for i in range(3):
            k = (u >> 16 * i & third - 1) + i * third
            own = at.setdefault(k, [0, 0, 0, 0, 0])
            own[0] -= n
            for j, x in enumerate((k1, k2, h, c), 1):
                own[j] ^= x
            if not any(own):
                del at[k]
            elif abs(own[0]) == 1:
                ready.append(k)
    return found, not at


def _peel_all(cells: DataFrame, third: int) -> DataFrame:
    def one(bucket: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, whole = peel(pdf, third)
        keys = np.array(found if whole else [], dtype=np.int64).reshape(-1, 2)
        out = pd.DataFrame({"k1": keys[:, 0], "k2": keys[:, 1]})
        if not whole:
            out = pd.DataFrame({"k1": [0], "k2": [0]})
        return out.assign(bucket=bucket[0], whole=whole)

    ship(cells.sparkSession)
    return cells.groupBy("bucket").applyInPandas(one, _PEELED)


def differing_keys(left: DataFrame, right: DataFrame, buckets: int, third: int = THIRD, retries: int = 2) -> DataFrame:
    """(k1, k2) of all keys whose pairs aren't the same on both sides. left and right: see representatives()."""
    parts: list[DataFrame] = []
    for _ in range(retries + 1):
        peeled = materialise(_peel_all(subtracted_tables(left, right, buckets, third), third))
        parts.append(peeled.where("whole").select("k1", "k2"))
        failed = peeled.where("not whole").select("bucket").distinct()
        if failed.isEmpty():
            break
        left, right = (x.withColumn("bucket", _bucket(buckets)).join(failed, "bucket", "left_semi").drop("bucket") for x in (left, right))
        third *= 4
    else:
        both = left.withColumnRenamed("h", "a").join(right.withColumnRenamed("h", "b"), ["k1", "k2"], "full_outer")
        parts.append(both.where("not (a <=> b)").select("k1", "k2"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _fetch(df: DataFrame, wanted: DataFrame, keys: list[str], order: str, fields: list[str], tolerance: float, side: str) -> DataFrame:
    """The standing line of each wanted key, as (k1, k2, <side>: struct of fields, <side>_key: struct of keys)."""
    named = [F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = _with_keys(df, keys).select(
        *_key_hashes(keys),
        F.struct(F.col(order).alias("o"), _row_hash(dict(df.dtypes), fields, tolerance).alias("h")).alias("s"),
        F.struct(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.struct(*named).alias("row")).alias("v"),
    )
    return rows.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max_by("v", "s").alias(side))


def _differs(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    if kind not in ("double", "float"):
        return ~a.eqNullSafe(b)
    a, b = a.cast("double"), b.cast("double")
    same = a.eqNullSafe(b) | F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= F.lit(tolerance)), F.lit(False))
    return ~same


def differences(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, fields: list[str],
    only_left: str = "only_in_left", only_right: str = "only_in_right", tolerance: float = TOLERANCE,
    keys_per_bucket: int = KEYS_PER_BUCKET, third: int = THIRD,
) -> DataFrame:
    """One row (keys..., kind, field) per key that one side lacks, and per field that differs for a shared key.

    On each side the line with the highest `order` stands for its key. kind is `only_left` or `only_right` with field
    "row", or "differs" with the field's name. Lines with a null in the key are left out; other nulls and NaN are equal
    only to themselves; doubles differ beyond the tolerance, other types unless equal. Empty texts are values. Columns
    besides keys, order and fields are ignored, whatever their names. An empty side makes every key of the other
    one-sided; two empty sides give no rows. third must be a power of two of at most 65,536.
    """
    kinds = dict(left.dtypes)
    n = max(left.count(), right.count())
    buckets = max(1, -(-n // keys_per_bucket))
    wanted = materialise(differing_keys(representatives(left, keys, order, fields, tolerance), representatives(right, keys, order, fields, tolerance), buckets, third))
    hinted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_KEYS) else wanted
    a, b = (_fetch(d, hinted, keys, order, fields, tolerance, s) for d, s in ((left, "a"), (right, "b")))
    both = a.join(b, ["k1", "k2"], "full_outer")
    changed = F.filter(
        F.array(*[F.when(_differs(F.col(f"a.row.f{i}"), F.col(f"b.row.f{i}"), kinds[f], tolerance), F.lit(f)) for i, f in enumerate(fields)]),
        lambda x: x.isNotNull(),
    )
    kind = F.when(F.col("b").isNull(), F.lit(only_left)).when(F.col("a").isNull(), F.lit(only_right)).otherwise(F.lit("differs"))
    names = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("row"))).otherwise(changed)
    key = F.coalesce(F.col("a.key"), F.col("b.key"))
    return both.select(*[key[f"k{i}"].alias(k) for i, k in enumerate(keys)], kind.alias("kind"), F.explode(names).alias("field"))
