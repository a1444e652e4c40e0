"""The N highest-scoring items of every group, by simultaneous bisection of per-group cutoffs.

Every item has an order-preserving code: first the 64 bits of its score, then, where scores tie at a cutoff, the bytes of
its identifier, seven at a time from the first that tells apart. A group's cutoff lies in an interval of codes. A round divides
the intervals of all groups at once at SPLIT - 1 midpoints (the next bits in which the ends of an interval differ, so that
rounds are never lost on values that lie close together), counts the rows above each (partial counts on the map side: at most
SPLIT rows per group and task are shuffled), and keeps the part in which the N-th row lies. Only rows inside their group's
interval stay for the next round, about one in SPLIT. A group is done when the rows from some midpoint up are exactly as many as
it still needs. No group is ever sorted or gathered whole; only the N rows that each keeps are numbered at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranks import code_of, part_of, with_division, with_groups
from tessella.session import discard, materialise, ship

#: Parts into which a round divides each group's interval, a power of two.
SPLIT = 64
#: Bytes of the identifier in one code.
CHUNK = 7


def _common_bytes(a: Column, b: Column) -> Column:
    """How many bytes two identifiers begin with alike."""
    x, y = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    n = F.least(F.length(x), F.length(y)) / 2
    places = F.sequence(F.lit(0), n.cast("int"))  # the place after the shorter one differs always
    return F.get(F.filter(places, lambda i: F.substring(x, 2 * i + 1, F.lit(2)) != F.substring(y, 2 * i + 1, F.lit(2))), F.lit(0))


def _item_code(item: Column, skip: Column) -> Column:
    """Seven bytes of the UTF-8 identifier after the first `skip`, and how many they are, as a bigint; negative, as smaller
    identifiers go first."""
    part = F.substring(F.hex(item.cast("binary")), 2 * skip + 1, F.lit(2 * CHUNK))
    return -(F.conv(F.rpad(part, 2 * CHUNK, "0"), 16, 10).cast("bigint") * 8 + (F.length(part) / 2).cast("bigint"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bisect(rows: DataFrame, state: DataFrame, split: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Cutoffs of the groups of state (g, size, need, lo, hi), which have more than `need` of rows (g, item, code) in [lo, hi].

    First (g, size, cut): rows with a code from cut on are in. Second (g, size, cut, need): rows above cut are in, and `need`
    of the more than that many equal to it. total: number of rows.
    """
    done: list[DataFrame] = []
    ties: list[DataFrame] = []
    own: list[DataFrame] = []  # rows that this function has written
    down = Window.partitionBy("g").orderBy(F.desc("part"))  # at most `split` parts a group
    left = state.count()
    while left:
        inside = with_groups(rows, with_division(state, split.bit_length() - 1), total, lines=left).where("code between lo and hi")
        counts = inside.groupBy("g", "size", "need", part_of().alias("part")).agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
        above = F.sum("n").over(down) - F.col("n")
        found = counts.withColumn("need", F.col("need") - above).where("need between 1 and n")
        found = materialise(found.select("g", "size", "need", "n", "lo", "hi"))
        done.append(found.where("n = need").select("g", "size", F.col("lo").alias("cut")))
        ties.append(found.where("n > need and lo = hi").select("g", "size", F.col("lo").alias("cut"), "need"))
        state = found.where("n > need and lo < hi").drop("n")
        left = state.count()
        if left:
            fewer = materialise(with_groups(rows, state, total, lines=left).where("code between lo and hi").select("g", "item", "code"))
            discard(*own)
            rows, own = fewer, [fewer]
    discard(*own)
    return _union(done), _union(ties)


def _tie_ends(rows: DataFrame, need: DataFrame, split: int, total: int) -> DataFrame:
    """(g, end): the last identifier that is in, of the rows (g, item) of groups (g, size, need) that need some of them.

    What a group's smallest and largest identifier begin with alike is skipped, so that the code tells the others apart;
    where more than seven bytes are alike in a part, the next codes are taken in it alone.
    """
    ends: list[DataFrame] = []
    while not need.isEmpty():
        skip = rows.groupBy("g").agg(F.count("*").alias("size"), _common_bytes(F.min("item"), F.max("item")).alias("skip"))
        coded = materialise(with_groups(rows, skip, total).select("g", "item", _item_code(F.col("item"), F.col("skip")).alias("code")))
        bounds = coded.groupBy("g").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
        level, tied = _bisect(coded, materialise(need.join(bounds, "g")), split, total)
        # where no tie is left, the largest identifier with a code from the cutoff on
        ends.append(with_groups(coded, level, total).where("code >= cut").groupBy("g").agg(F.max("item").alias("end")))
        rows, need = materialise(with_groups(coded, tied, total).where("code = cut").select("g", "item")), materialise(tied.select("g", "size", "need"))
    return _union(ends)


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int, rank: str = "rank_no", split: int = SPLIT) -> DataFrame:
    """(groups..., item, rank) for the n items of each group with the highest score; all items where there are fewer.

    Equal scores rank by item ascending, in order of code points. An item counts once per group, with its highest score;
    repeated rows change nothing. Left out are rows whose item, score or first group column is null or whose score is
    NaN; null in another group column is a group of its own, infinite scores are scores, -0.0 equals 0.0, an empty
    identifier comes before all others. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    ship(df.sparkSession)
    g = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)])
    value = F.col(score).cast("double")
    kept = df.where(F.col(item).isNotNull() & F.col(groups[0]).isNotNull() & value.isNotNull() & ~F.isnan(value))
    best = kept.select(g.alias("g"), F.col(item).cast("string").alias("item"), value.alias("v")).groupBy("g", "item").agg(F.max("v").alias("v"))
    base = materialise(best.select("g", "item", code_of(F.col("v")).alias("code")))

    sizes = materialise(base.groupBy("g").agg(F.count("*").alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    none = F.lit(None).cast("string").alias("end")
    cuts = [sizes.where(F.col("size") <= n).select("g", "size", F.col("lo").alias("cut"), none)]
    state = sizes.where(F.col("size") > n).select("g", "size", F.lit(n).cast("bigint").alias("need"), "lo", "hi")
    if not state.isEmpty():
        plain, tied = _bisect(base, state, split, total)
        cuts.append(plain.select("g", "size", "cut", none))
        if not tied.isEmpty():
            rows = materialise(with_groups(base, tied, total).where("code = cut").select("g", "item"))
            cuts.append(tied.join(_tie_ends(rows, tied.select("g", "size", "need"), split, total), "g").select("g", "size", "cut", "end"))
    chosen = with_groups(base, materialise(_union(cuts)), total).where("code > cut or (code = cut and (end is null or item <= end))")
    numbered = chosen.withColumn(rank, F.row_number().over(Window.partitionBy("g").orderBy(F.desc("code"), F.asc("item"))).cast("bigint"))
    return numbered.select(*[F.col(f"g.g{i}").alias(c) for i, c in enumerate(groups)], F.col("item").alias(item), rank)
