"""The state in force at a time: each observation with the newest declaration of its key that is not later.

Both tables are cut into slices of time with about as many rows each. Inside a slice a
running value over (key, slice) finds the declaration; what a slice begins with is carried
over as one row per key and slice, so that no window goes over a whole key and a key
that holds much of the table is worked on by as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.columns import whole_row
from driftline.operators.changes import even_slices

#: What a row is, in the order in which rows of one time are read.
CARRIED, DECLARED, OBSERVED = 0, 1, 2


def in_force(
    observed: DataFrame, declared: DataFrame, key: list[str], at: str, since: str,
    tiebreak: list[str] = (), out: str = "declared", slices: int | None = None,
) -> DataFrame:
    """``observed`` with ``out``, the struct of the ``declared`` row of its key with the greatest ``since`` not above ``at``; else null.

    Of declarations at one time the greatest in ``tiebreak`` counts. A declaration in force
    at its own time, to the last digit, is in force. Rows without a key or a time meet
    nothing: such observations come back with null. ``slices`` is their number at most; by default it follows the shuffle.
    """
    key = list(key)
    keyed = " AND ".join(f"`{k}` IS NOT NULL" for k in key)
    whole = f"{keyed} AND `{at}` IS NOT NULL"
    seen = observed.where(whole)
    stated = declared.where(f"{keyed} AND `{since}` IS NOT NULL")
    kind, none = seen.schema[at].dataType, F.lit(None)
    order = F.struct(F.col(since).alias("at"), *[F.col(t) for t in tiebreak])
    rows = whole_row(declared)
    one = stated.select(*key, F.col(since).cast(kind).alias("_at"), F.lit(DECLARED).alias("_side"), order.alias("_order"), rows.alias("_declared"), none.cast(observed.schema).alias("_observed"))
    two = seen.select(*key, F.col(at).alias("_at"), F.lit(OBSERVED).alias("_side"), none.cast(order_type(stated, since, tiebreak)).alias("_order"), none.cast(declared.schema).alias("_declared"), whole_row(observed).alias("_observed"))
    both = one.unionByName(two)
    times = both.select("_at")
    both = both.withColumn("_slice", even_slices(times, ["_at"], slices))
    carried = _carried(both, key)
    # The carried rows come first in their slice, and of the rest what is declared comes before what is observed.
    running = W.partitionBy(*key, "_slice").orderBy(F.col("_side") > CARRIED, "_at", "_side", "_order").rowsBetween(W.unboundedPreceding, 0)
    read = both.unionByName(carried).withColumn("_found", F.last("_declared", ignorenulls=True).over(running))
    met = read.where(F.col("_side") == OBSERVED).select("_observed.*", F.col("_found").alias(out))
    rest = observed.where(f"NOT coalesce({whole}, false)").withColumn(out, none.cast(declared.schema))
    return met.unionByName(rest)


def order_type(stated: DataFrame, since: str, tiebreak: list[str]):
    return stated.select(F.struct(F.col(since).alias("at"), *[F.col(t) for t in tiebreak]).alias("o")).schema["o"].dataType


def _carried(both: DataFrame, key: list[str]) -> DataFrame:
    """A row per key and slice that the key has rows in: the last declaration of the slices before, null where there is none."""
    last = F.max_by("_declared", F.when(F.col("_side") == DECLARED, F.col("_order")))
    ends = both.groupBy(*key, "_slice").agg(last.alias("_last"))
    # At most as many rows per key as there are slices.
    before = W.partitionBy(*key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_declared", F.last("_last", ignorenulls=True).over(before)).where("_declared IS NOT NULL")
    rest = {f.name: F.lit(None).cast(f.dataType) for f in both.schema.fields if f.name in ("_at", "_order", "_observed")}
    return carried.drop("_last").withColumns({"_side": F.lit(CARRIED), **rest}).select(*both.columns)
