"""Pairs of intervals that overlap, such as a config's validity and the times at which it was used.

Intervals are put into bins of their own size: level l has bins of width BASE * RATIO^l,
and an interval goes to the least level at which it reaches over two bins at most. It also
has a row in each coarser level, two bins at most again, so a long interval is never
spread over the short bins. Two intervals meet at the coarser of their levels, and of the bins that they share
the one where the later of them begins reports the pair. What meets in a bin without
overlapping is a constant share of what overlaps, unless short intervals crowd beside a long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import whole_row

#: Width of a bin of level 0 in units of the interval's ends, and what a level is wider than the one below.
BASE, RATIO = 1, 4


def _ends(df: DataFrame, start: str, end: str) -> tuple[Column, Column]:
    """The ends as whole numbers; times in microseconds."""

    def number(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if kind == "timestamp_ntz":
            return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
        if kind == "timestamp":
            return F.unix_micros(F.col(name))
        if kind == "date":
            return F.unix_date(F.col(name)).cast("bigint")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return F.col(name).cast("bigint")
        raise TypeError(f"{name} is of type {kind}: the ends of intervals are whole numbers, dates or times")

    return number(start), number(end)


def _widths(shortest: int, longest: int) -> list[int]:
    """The widths of the levels, from the one that holds the shortest interval to the one that holds the longest."""
    widths = [BASE]
    while widths[-1] < shortest:
        widths.append(widths[-1] * RATIO)
    levels = [widths[-1]]
    while levels[-1] < longest:
        levels.append(levels[-1] * RATIO)
    return levels


def _binned(df: DataFrame, key: list[str], start: str, end: str, side: str, widths: list[int]) -> DataFrame:
    """A row per bin that an interval has at its own level and at each coarser one."""
    low, high = _ends(df, start, end)
    # The last unit that the half-open interval holds.
    whole = df.select(*key, whole_row(df).alias(side), low.alias(f"{side}_low"), (high - 1).alias(f"{side}_high")).where(f"{side}_low <= {side}_high")
    lowest, highest = F.col(f"{side}_low"), F.col(f"{side}_high")
    own = sum((F.when(highest - lowest >= w, 1).otherwise(0) for w in widths[:-1]), F.lit(0))
    bins = F.explode(F.array(*[
        F.when(F.lit(level) >= F.col("_own"), F.struct(F.lit(level).alias("level"), F.floor(lowest / F.lit(w)).alias("first"), F.floor(highest / F.lit(w)).alias("last")))
        for level, w in enumerate(widths)
    ]))
    at = whole.withColumn("_own", own).select("*", bins.alias("_b")).where("_b IS NOT NULL")
    spread = at.select("*", F.explode(F.sequence("_b.first", "_b.last")).alias("_bin"))
    return spread.select(*key, F.col("_b.level").alias("_level"), "_bin", side, f"{side}_low", f"{side}_high", (F.col("_own") == F.col("_b.level")).alias(f"{side}_own"))


def overlaps(
    left: DataFrame, right: DataFrame, key: list[str], start: str, end: str, right_start: str | None = None, right_end: str | None = None,
    out: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """``key`` and the structs of the rows of ``left`` and ``right`` whose half-open intervals [start, end) share a point, each pair once.

    Ends are whole numbers, dates or times, of the same type on both sides. An interval
    without a key, without an end, or with no point in it overlaps nothing. ``key`` may be
    empty. The levels follow the shortest and the longest interval, which one pass over the ends finds.
    """
    right_start, right_end = right_start or start, right_end or end
    spans = []
    for df, s, e in ((left, start, end), (right, right_start, right_end)):
        low, high = _ends(df, s, e)
        spans.append(df.select((high - low).alias("n")).where("n > 0"))
    shortest, longest = spans[0].unionByName(spans[1]).agg(F.min("n"), F.max("n")).first()
    widths = _widths(shortest or 1, longest or 1)
    a = _binned(left, key, start, end, "_l", widths)
    b = _binned(right, key, right_start, right_end, "_r", widths)
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("_level") + 1)
    later = F.greatest("_l_low", "_r_low")
    # They share a point; they meet at the coarser level; the bin in which the later one begins reports.
    pair = (F.col("_l_low") <= F.col("_r_high")) & (F.col("_r_low") <= F.col("_l_high"))
    met = a.join(b, [*key, "_level", "_bin"]).where(pair & (F.col("_l_own") | F.col("_r_own")) & (F.floor(later / width) == F.col("_bin")))
    return met.select(*key, F.col("_l").alias(out[0]), F.col("_r").alias(out[1]))
