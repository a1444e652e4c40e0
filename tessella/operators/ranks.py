"""Order statistics by counting: the values at given ranks of any number of groups at once.

Values get codes that order as they do. Each wanted rank lies in an interval of codes; a round divides all intervals at the next
bits in which their ends differ, counts the rows of each part (partial counts on the map side) and keeps the parts in which
wanted ranks lie. Only their rows stay for the next round, so no group is ever sorted or gathered, and no aggregate holds the
distinct values of a group. A rank is found when its part holds one value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import number
from tessella.session import discard, materialise, ship, small_enough

#: Bits by which a round divides an interval.
BITS = 10
#: Groups (about 100 bytes each) whose lines are broadcast; of more, those that hold more than one row in so many.
BROADCAST_GROUPS = 20_000


def _bits(x: pd.Series) -> pd.Series:
    b = (x.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF))


def _doubles(x: pd.Series) -> pd.Series:
    b = x.to_numpy("int64")
    return pd.Series((b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64))


def code_of(x: Column) -> Column:
    """Bigints that order as doubles do (the sign bit apart, IEEE 754 orders as integers); -0.0 equals 0.0. x: not null."""
    return F.pandas_udf(_bits, "bigint")(x)


def value_of(code: Column) -> Column:
    """The double that a code stands for."""
    return F.pandas_udf(_doubles, "double")(code)


def with_division(state: DataFrame, bits: int = BITS) -> DataFrame:
    """state (lo, hi) with shift and base, by which part_of() divides each interval into at most 2^bits parts, at the highest
    bits in which lo and hi differ. Integers only: no part is empty for want of precision."""
    shifted = state.withColumn("shift", F.greatest(F.expr(f"length(bin(lo ^ hi)) - {bits}"), F.lit(0)))
    return shifted.withColumn("base", F.expr("shiftright(lo, shift)"))


def part_of() -> Column:
    """The part of its interval in which a row's code lies, from 0."""
    return F.expr("cast(shiftright(code, shift) - base as int)")


def with_groups(rows: DataFrame, state: DataFrame, total: int, size: str = "size", most: int | None = None, lines: int | None = None) -> DataFrame:
    """rows joined with the lines of state of their group g; rows of groups without one drop out.

    State is broadcast while it has at most `most` lines. Else those of groups with more than total / most rows are, which
    can't be more than `most` groups, and only the others' rows are joined by a shuffle: no hot group is shuffled.
    size: the column of state that has the rows of a line's group; total: at least the number of rows; lines: how many lines
    state has, if that is known.
    """
    most = BROADCAST_GROUPS if most is None else most
    if lines <= most if lines is not None else small_enough(state, most):
        return rows.join(F.broadcast(state), "g")
    is_hot = F.col(size) > total / max(most, 1)
    hot, cold = state.where(is_hot), state.where(~is_hot)
    few = rows.join(F.broadcast(hot.select("g").distinct()), "g", "left_anti")
    return rows.join(F.broadcast(hot), "g").unionByName(few.join(cold, "g"))


def values_at(rows: DataFrame, wanted: DataFrame, bits: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """(g, rank, code) for each wanted (g, rank): the code at that rank, from 0, of the group's rows (g, code).

    Ranks outside a group and groups without rows give no line. Repeated codes take a rank each. A group has few ranks.
    bounds: (g, size, lo, hi) of the groups, if they are known.
    """
    bits = BITS if bits is None else bits
    if bounds is None:
        bounds = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    ranks = wanted.groupBy("g").agg(F.collect_set("rank").alias("ranks"))
    state = materialise(ranks.join(bounds, "g").select("g", "size", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "ranks"))
    done = state.where("lo = hi").select("g", F.explode(F.expr("filter(ranks, r -> r >= 0 and r < size)")).alias("rank"), F.col("lo").alias("code"))
    total, left = state.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.expr("lo < hi"))).first()
    before = Window.partitionBy("g", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^bits parts
    held: list[DataFrame] = []  # rows of this function's own
    while left:
        state = state.where("lo < hi")
        lines = with_division(state.select("g", "size", "lo", "hi"), bits)
        inside = with_groups(rows, lines, total, lines=left).where("code between lo and hi")
        counts = inside.groupBy("g", F.col("lo").alias("from"), part_of().alias("part")).agg(F.count("*").alias("n"), F.min("code").alias("least"), F.max("code").alias("most"))
        placed = counts.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
        joined = placed.join(state.withColumnRenamed("lo", "from"), ["g", "from"]).withColumn("below", F.col("below") + F.col("inside"))
        own = joined.withColumn("ranks", F.expr("filter(ranks, r -> r >= below and r < below + n)")).where("size(ranks) > 0")
        state = materialise(own.select("g", "size", F.col("least").alias("lo"), F.col("most").alias("hi"), "below", "ranks"))
        done = done.unionByName(state.where("lo = hi").select("g", F.explode("ranks").alias("rank"), F.col("lo").alias("code")))
        left = state.where("lo < hi").count()
        if left:
            fewer = materialise(with_groups(rows, state.where("lo < hi").select("g", "size", "lo", "hi"), total, lines=left).where("code between lo and hi").select("g", "code"))
            discard(*held)
            rows, held = fewer, [fewer]
    discard(*held)
    return done


def exact_percentiles(df: DataFrame, groups: list[str], value: Column | str, ps: tuple[float, ...] | list[float]) -> DataFrame:
    """(groups..., n, q): the exact percentiles of a value by group, interpolated between neighbours, as an array in order of ps.

    Null and NaN are no values, infinities are; a null group is a group of its own; groups without values and empty tables
    give no rows.
    """
    ship(df.sparkSession)
    g = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]) if groups else F.struct(F.lit(0).alias("g0"))
    rows = df.select(g.alias("g"), number(value).alias("x")).where("x is not null")
    rows = materialise(rows.select("g", code_of(F.col("x")).alias("code")))
    bounds = materialise(rows.groupBy("g").agg(F.count("*").alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi")))
    at = F.array(*[F.lit(float(p)) * (F.col("size") - 1) for p in ps])
    targets = bounds.select("g", F.col("size").alias("n"), F.posexplode(at).alias("i", "t")).withColumns({"below": F.floor("t"), "above": F.ceil("t")})
    wanted = targets.select("g", F.explode(F.array("below", "above")).alias("rank"))
    found = values_at(rows, wanted, bounds=bounds).select("g", "rank", value_of(F.col("code")).alias("v"))
    lo, hi = (found.select("g", F.col("rank").alias(k), F.col("v").alias(f"v_{k}")) for k in ("below", "above"))
    between = F.when((F.col("below") == F.col("above")) | (F.col("v_below") == F.col("v_above")), F.col("v_below"))
    q = between.otherwise((F.col("above") - F.col("t")) * F.col("v_below") + (F.col("t") - F.col("below")) * F.col("v_above"))
    each = targets.join(lo, ["g", "below"]).join(hi, ["g", "above"]).groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))).alias("s"))  # a line each of ps
    return each.select(*[F.col(f"g.g{i}").alias(c) for i, c in enumerate(groups)], "n", F.col("s.q").alias("q"))
