"""Summaries that add up: distinct counts and quantiles of cells, kept as sketches by day and united along grouping sets.

A day's rows are summed up once, one row per cell. Any later question, for any set of dimensions and any days,
unites the stored sketches and never reads the rows again. The sketches are Spark's own: HyperLogLog, whose
relative error is about 1 / sqrt(2^LG), and KLL, whose error in rank is about 2 / K.
"""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.columns import quoted

#: Logarithm of the distinct sketch's places, and the quantile sketch's size; counts far below 2^LG are exact.
LG, K = 14, 400
NAMES = ["_n", "_distinct", "_values"]


def cells(rows: DataFrame, dims: list[str], distinct: str, value: str) -> DataFrame:
    """A row per cell of ``dims``: the number of rows and the sketches of ``distinct`` and of ``value``, a double.

    Null is a value of a dimension like any other; nulls of ``distinct`` and ``value`` are in no sketch.
    """
    return rows.groupBy(*[F.col(quoted(d)) for d in dims]).agg(
        F.count(F.lit(1)).alias("_n"),
        F.hll_sketch_agg(F.col(quoted(distinct)), F.lit(LG)).alias("_distinct"),
        F.kll_sketch_agg_double(F.col(quoted(value)).cast("double"), F.lit(K)).alias("_values"),
    )


def add_day(rows: DataFrame, path: str, day: str, dims: list[str], distinct: str, value: str) -> None:
    """Write the cells of one day's rows; no other day is read or written, and a day that comes again replaces itself."""
    cells(rows, dims, distinct, value).write.mode("overwrite").parquet(f"{path}/day={day}")


def grouping_sets(dims: list[str]) -> list[tuple[str, ...]]:
    """All subsets of the dimensions, as CUBE has them."""
    return list(chain.from_iterable(combinations(dims, n) for n in range(len(dims), -1, -1)))


def united(stored: DataFrame, dims: list[str], shares: list[float], sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """dims, grouped, n, distinct, quantiles: a row per cell of each grouping set (None: all), from stored cells alone.

    A dimension that a set leaves out is null, and ``grouped`` names those that it keeps, so that
    a total is told from a null value. ``quantiles`` are those of ``shares``; null where there is no value.
    """
    kept = grouping_sets(dims) if sets is None else sets
    none = {f.name: F.lit(None).cast(f.dataType) for f in stored.schema.fields}
    # One copy of a cell per set; cells are few, whatever the rows were.
    copies = F.explode(F.array(*[
        F.struct(F.lit(",".join(s)).alias("grouped"), *[(F.col(quoted(d)) if d in s else none[d]).alias(d) for d in dims]) for s in kept
    ]))
    spread = stored.select(copies.alias("c"), *NAMES).select("c.*", *NAMES)
    merged = spread.groupBy("grouped", *[quoted(d) for d in dims]).agg(
        F.sum("_n").alias("n"), F.hll_union_agg("_distinct").alias("_distinct"), F.kll_merge_agg_double("_values").alias("_values")
    )
    quantiles = F.when(F.kll_sketch_get_n_double("_values") > 0, F.kll_sketch_get_quantile_double("_values", F.array(*[F.lit(float(s)) for s in shares])))
    return merged.select("grouped", *[quoted(d) for d in dims], "n", F.hll_sketch_estimate("_distinct").alias("distinct"), quantiles.alias("quantiles"))


def read_days(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The stored cells of some days, or of all."""
    return spark.read.parquet(path).drop("day") if days is None else spark.read.parquet(*[f"{path}/day={d}" for d in days])
