"""Positions in a global order, and in the order of each key, without a window over all rows or over a whole key.

Rows are cut into ranges of the order, each range is sorted by its own task and written with its place in it, and a
range's first position is the sum of the counts of the ranges before it. A key of many rows reaches over
several ranges, and equal rows are told apart by where they stood in the input, so that they can be cut too.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.columns import quoted
from driftline.session import drop_path, scratch_path, written

#: The low bits of a place number the rows of its range.
PLACE_BITS = 33


def with_positions(placed: DataFrame, place: str, out: str) -> DataFrame:
    """``placed`` with the dense position ``out`` from 1, from a ``place`` that monotonically_increasing_id() gave to a written table.

    Only a count per range comes to the driver, and goes back as a list of as many sums.
    """
    spark = placed.sparkSession
    part = F.shiftright(F.col(quoted(place)), PLACE_BITS).cast("int")
    counts = sorted(placed.select(part.alias("part")).groupBy("part").count().collect())
    firsts = [0, *accumulate(n for _, n in counts)]
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, firsts, strict=False)], "_part int, _first bigint")
    within = F.col(quoted(place)).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # As many rows as there are ranges.
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(out, F.col("_first") + within + 1).drop("_part", "_first", place)


def numbered(df: DataFrame, out: str = "number") -> DataFrame:
    """``df`` with numbers from 1 without gaps, in no order that means anything; one write, no shuffle.

    The numbers stay as they are for the DataFrame returned, also when executors are lost.
    """
    return with_positions(written(df.withColumn("_place", F.monotonically_increasing_id()), "numbered"), "_place", out)


def global_ranks(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the position of each row, from 1, in ``order``; what is equal in it is numbered in some fixed order.

    Nulls stand where the order's columns put them. ``df`` is written, then shuffled once by ranges of the order, and
    written in it; a range is a task's share whatever the values, as the row's place in
    the input is the last column of the order.
    """
    return with_positions(_placed(df, order), "_place", out)


def prefix_sums(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value``, a whole number, over all rows up to each one in ``order``; nulls add nothing.

    As ``global_ranks``; inside its range a row's sum is a window's, and what the ranges before sum up to is added.
    """
    placed = _placed(df, order).withColumn("_part", F.shiftright("_place", PLACE_BITS).cast("int"))
    sums = sorted(placed.groupBy("_part").agg(F.coalesce(F.sum(quoted(value)), F.lit(0))).collect())
    firsts = [0, *accumulate(n for _, n in sums)]
    offsets = df.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sums, firsts, strict=False)], "_part int, _first bigint")
    running = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.withColumn("_inside", F.sum(F.coalesce(F.col(quoted(value)), F.lit(0))).over(running))
    # As many rows as there are ranges.
    return inside.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_first") + F.col("_inside")).drop("_part", "_place", "_inside", "_first")


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of ``df`` in ranges of ``order``, written with ``_place``."""
    spark = df.sparkSession
    path = scratch_path(spark, "unranked")
    # Written first: sampling the ranges reads it again, and its rows then have places that no retry can change.
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).withColumn("_tie", F.monotonically_increasing_id())
    whole = [*order, F.col("_tie")]
    ranges = rows.repartitionByRange(_ranges(spark), *whole).sortWithinPartitions(*whole)
    placed = written(ranges.drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "ranked")
    drop_path(spark, path)
    return placed


def _ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_ranks(df: DataFrame, key: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the position of each row, from 1, among the rows of its ``key`` in ``order``; null is a key like any other.

    Ranges are of (key, order), so a key that holds much of the table is sorted by many
    tasks. A key's first position comes back as one row per key, on the side of the join that Spark need not split.
    """
    keys = [F.col(quoted(k)) for k in key]
    positions = global_ranks(df, [*keys, *order], "_position")
    firsts = positions.groupBy(F.struct(*keys).alias("_who")).agg(F.min("_position").alias("_key_first"))
    who = F.struct(*keys)
    ranked = positions.withColumn("_who", who).join(firsts, "_who")
    return ranked.withColumn(out, F.col("_position") - F.col("_key_first") + 1).drop("_who", "_position", "_key_first")


def top_share(df: DataFrame, order: list[Column], eligible: Column, numerator: int, denominator: int, out: str = "rank") -> DataFrame:
    """``df`` with the rank from 1 of the first floor(n * numerator / denominator) of the n ``eligible`` rows in ``order``; else null."""
    marked = df.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    ranked = global_ranks(marked, [F.col("_eligible").desc(), *order], "_position")
    n = ranked.where("_eligible").count()
    drawn = n * numerator // denominator
    return ranked.withColumn(out, F.when(F.col("_position") <= F.lit(drawn), F.col("_position"))).drop("_eligible", "_position")
