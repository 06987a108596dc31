"""Overlap join of two large tables of intervals by bins of several widths.

Every interval has a level by its length: the first whose bins are as wide as it is long, so it touches at most two of them. Two
intervals meet at the coarser of their levels. So an interval is placed at its own level and looks up at the coarser levels that
the other side uses, two bins each at most, however long it is. Bins that hold very many intervals of one side are split
by a measured histogram, and each share meets all shares of the other side in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions.tables import stored

LEVELS = 8
STEP = 8
SHARE_ROWS = 100_000
MOST_SHARES = 4096
BIN = ("chrom", "level", "bin")
KEY = (*BIN, "kind")


#: By level: where an interval of that level is put, as (level, kind).
Places = dict[int, list[tuple[int, int]]]


def width_of(level: int, width: int) -> int:
    """The width of a level's bins; the last level has one bin for the whole contig."""
    return width * STEP**level if level < LEVELS else (1 << 63) - 1


def level_of(width: int) -> Column:
    """The level of an interval; one too long for all others has the last."""
    size = F.col("end") - F.col("start")
    level = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        level = F.when(size <= width_of(i, width), F.lit(i)).otherwise(level)
    return level


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def _places(places: Places, size: Callable[[int, int], int]) -> Column:
    """The places by level as one constant: arrays of (level, kind, size), the size of (from level, to level)."""
    empty = "CAST(array() AS array<struct<level: int, kind: int, size: bigint>>)"

    def listed(level: int) -> str:
        entries = [f"named_struct('level', {at}, 'kind', {kind}, 'size', {size(level, at)}L)" for at, kind in places.get(level, [])]
        return f"array({', '.join(entries)})" if entries else empty

    return F.expr(f"array({', '.join(listed(i) for i in range(LEVELS + 1))})")


def _spread(intervals: DataFrame, places: Places, width: int) -> DataFrame:
    """Intervals with the bins of every place they are put in, one or two each; those without a base are nowhere."""
    columns = intervals.columns
    full = intervals.where(F.col("start") < F.col("end")).withColumn("_level", level_of(width))
    put = full.select(*columns, F.explode(F.get(_places(places, lambda _, at: width_of(at, width)), F.col("_level"))).alias("_at"))
    bins = F.sequence(_div(F.col("start"), F.col("_at.size")), _div(F.col("end") - 1, F.col("_at.size")))
    return put.select(*columns, "_at.level", "_at.kind", F.explode(bins).alias("bin"))


def placed_counts(intervals: DataFrame, width: int) -> DataFrame:
    """(chrom, level, bin, n): how many intervals are placed in each bin; those without a base are nowhere."""
    return _spread(intervals, {i: [(i, 0)] for i in range(LEVELS + 1)}, width).groupBy(*BIN).agg(F.count("*").alias("n"))


def _levels(counts: DataFrame) -> list[int]:
    return sorted(r["level"] for r in counts.select("level").distinct().collect())


def _key_counts(counts: DataFrame, places: Places, name: str) -> DataFrame:
    """Rows per key as the intervals will be spread, from the counts of placed ones: a bin's intervals look up the bins above it."""
    parts = _places(places, lambda level, at: STEP ** (at - level) if at < LEVELS or level == at else (1 << 63) - 1)
    put = counts.select("chrom", "bin", "n", F.explode(F.get(parts, F.col("level"))).alias("_at"))
    key = put.select("chrom", "_at.level", _div(F.col("bin"), F.col("_at.size")).alias("bin"), "_at.kind", "n")
    return key.groupBy(*KEY).agg(F.sum("n").alias(name))


def crowded_keys(one: DataFrame, other: DataFrame, share_rows: int) -> DataFrame:
    """(key, one_shares, other_shares) of the keys where a side has more rows than a share.

    A share is at least one in ``MOST_SHARES`` of a side's rows, so there are at most twice as many such keys.
    """
    most = one.agg(F.sum("n_one")).first()[0] or 0, other.agg(F.sum("n_other")).first()[0] or 0
    sizes = [max(share_rows, n // MOST_SHARES + 1) for n in most]
    both = one.join(other, list(KEY))
    shares = both.select(
        *KEY, F.ceil(F.col("n_one") / sizes[0]).cast("int").alias("one_shares"), F.ceil(F.col("n_other") / sizes[1]).cast("int").alias("other_shares")
    )
    return shares.where((F.col("one_shares") > 1) | (F.col("other_shares") > 1))


def _dealt(rows: DataFrame, crowded: DataFrame, own: str, other: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the number of their own share, once for each share of the other side."""
    def last(shares: str) -> Column:
        return F.coalesce(F.col(shares), F.lit(1)) - 1

    joined = rows.join(F.broadcast(crowded), list(KEY), "left")
    numbered = joined.withColumn(own, F.pmod(F.xxhash64(*columns), last(f"{own}_shares") + 1).cast("int"))
    return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), last(f"{other}_shares")))).drop("one_shares", "other_shares")


def overlapping(one: DataFrame, other: DataFrame, width: int, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Every pair of rows whose intervals overlap, once: columns of ``one``, and those of ``other`` with ``t_start`` and ``t_end``.

    Both are (chrom, start, end, any more columns) and are read twice: once to count the intervals in each bin, which is a small
    table, and once to join them. Equal rows of a crowded bin fall in one share, so they are best folded before.
    """
    sides = {name: stored(placed_counts(df.select("chrom", "start", "end"), width), f"placed-{name}") for name, df in (("one", one), ("other", other))}
    at_one, at_other = _levels(sides["one"]), _levels(sides["other"])
    # Kind 0 meets where ``one`` is placed, at a level as coarse as that of ``other`` or coarser; kind 1 where only ``other`` is.
    put_one = {i: [(i, 0), *((j, 1) for j in at_other if j > i)] for i in at_one}
    put_other = {
        i: [*[(i, 0)] * (i in at_one), *[(i, 1)] * any(j < i for j in at_one), *((j, 0) for j in at_one if j > i)] for i in at_other
    }
    counts = _key_counts(sides["one"], put_one, "n_one"), _key_counts(sides["other"], put_other, "n_other")
    crowded = stored(crowded_keys(*counts, share_rows), "crowded")
    left = _spread(one, put_one, width)
    right = _spread(other, put_other, width)
    left = _dealt(left, crowded, "one", "other", one.columns)
    right = _dealt(right, crowded, "other", "one", other.columns).withColumnsRenamed({"start": "t_start", "end": "t_end"})
    met = left.join(right.hint("merge"), [*KEY, "one", "other"])
    widths = F.array(*[F.lit(width_of(i, width)).cast("long") for i in range(LEVELS + 1)])
    first = _div(F.greatest("start", "t_start"), F.get(widths, F.col("level")))
    met = met.where((F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end")) & (first == F.col("bin")))
    return met.drop("level", "bin", "kind", "one", "other")
