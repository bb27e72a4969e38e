"""Histories: newest revision, previous value, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_revision(log: DataFrame, key: list[str], revision: str, tiebreak: list[str]) -> DataFrame:
    """The newest record of each key; equal revisions are settled by ``tiebreak``.

    Asking a window for its first row lets Spark keep one row per key inside each task
    before the shuffle, so a key with a third of all rows costs no more than any other.
    Streams have no such window and use the aggregate that means the same.
    """
    if log.isStreaming:
        rest = [c for c in log.columns if c not in key]
        newest = F.max_by(F.struct(*rest), F.struct(revision, *tiebreak)).alias("_newest")
        return log.groupBy(*key).agg(newest).select(*key, "_newest.*").select(*log.columns)
    newest_first = [F.col(c).desc() for c in (revision, *tiebreak)]
    place = F.row_number().over(W.partitionBy(*key).orderBy(*newest_first))
    return log.withColumn("_place", place).where("_place = 1").drop("_place")


#: Slices that ``even_slices`` makes at most; a choice among them is worked out per row.
MOST_SLICES = 512


def with_previous(
    log: DataFrame, key: list[str], order: list[str], values: list[str], slice_by: Column | None = None
) -> DataFrame:
    """Add ``_prev``, the struct of ``values`` in the row before, null for the first.

    Every key, null included, is worked on in slices, each a group of its own, so that a hot
    one spreads over as many tasks as it has slices. ``slice_by`` must never fall as
    ``order`` rises; by default it is ``even_slices`` of the order. The row
    before the first of a slice is the last of a slice before: first and last rows, few as
    they are, meet once more by key. Both passes read one shuffle of the log.
    """
    cut = even_slices(log, order) if slice_by is None else slice_by
    # The state is a column of its own, so that both passes want the same shuffle.
    state = F.col("_state")
    here = W.partitionBy(*key, "_slice").orderBy(*order)
    staged = log.withColumns({"_slice": cut, "_state": F.struct(*values)}).withColumns(
        {
            "_prev": F.lag(state).over(here),
            "_first": F.lag(F.lit(True)).over(here).isNull(),
            "_last": F.lead(F.lit(True)).over(here).isNull(),
        }
    )
    across = W.partitionBy(*key).orderBy("_slice", *order)
    ends = staged.where("_first OR _last").withColumn("_prev", F.lag(state).over(across))
    return (
        staged.where("NOT _first")
        .select(*log.columns, "_prev")
        .unionByName(ends.where("_first").select(*log.columns, "_prev"))
    )


#: Rows per slice that ``even_slices`` looks at.
SLICE_SAMPLE = 64


def even_slices(log: DataFrame, order: list[str], slices: int | None = None) -> Column:
    """A ``slice_by`` for ``with_previous`` with about as many rows in each slice.

    Takes one pass over the columns of ``order``, whatever their types; the bounds are rows of a
    random sample, so that they follow the rows: a key whose rows crowd into an hour, or
    into one value that only the next column tells apart, is cut there. Rows that are equal in all of ``order`` stay together.
    """
    if slices is None:
        slices = min(MOST_SLICES, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(order)]
    kinds = [f.dataType for f in log.select(*columns).schema.fields]
    names = [f"c{i}" for i in range(len(order))]
    # Rows with the least of a random number each: a sample of fixed size, kept by each task as it reads.
    sample = log.select(*columns).orderBy(F.rand(7)).limit(SLICE_SAMPLE * slices).orderBy(*names).collect()
    wide = len(sample) / slices
    bounds = list(dict.fromkeys(tuple(sample[int(i * wide)]) for i in range(1, slices) if int(i * wide)))
    place = F.struct(*[F.col(c) for c in order])
    cut = [F.struct(*[F.lit(v).cast(k) for v, k in zip(b, kinds, strict=True)]) for b in bounds]
    return _bucket(place, cut) if cut else F.lit(0)


def _bucket(place: Column, bounds: list[Column]) -> Column:
    """How many of the sorted bounds are not above the place, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(place >= bounds[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def desired_changed(
    log: DataFrame, key: list[str], order: list[str], fields: list[str], slice_by: Column | None = None
) -> DataFrame:
    """Events whose desired fields differ from those of the event before of that key.

    The first event of a key counts as changed; null equals null.
    """
    kept = with_previous(log, key, order, fields, slice_by)
    same = F.col("_prev").isNotNull() & F.col("_prev").eqNullSafe(F.struct(*fields))
    return kept.where(~same).drop("_prev")


def condition_transitions(
    log: DataFrame, key: list[str], order: list[str], status: str, slice_by: Column | None = None
) -> DataFrame:
    """Rows at which the status of a condition changes, with the status before.

    The first row of a key is no transition. The time of a kept row is the new
    last-transition time.
    """
    kept = with_previous(log, key, order, [status], slice_by)
    before = F.col(f"_prev.{status}")
    return (
        kept.where(F.col("_prev").isNotNull() & ~before.eqNullSafe(F.col(status)))
        .withColumn("previous_status", before)
        .drop("_prev")
    )
