"""Drift episodes: runs of drifting observations of a resource with no more than a gap between neighbours.

On a table they are islands between gaps. Rows are cut into slices of time; inside a slice
a running sum numbers the islands, and only the first and the last island of a slice, few as
they are, meet those of other slices once more by key. On a stream they are session windows behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.changes import even_slices

COLUMNS = ["start", "end", "length", "observations", "reasons"]


def _measured(df: DataFrame, key: list[str]) -> DataFrame:
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1_000_000
    return df.select(*key, "start", "end", seconds.alias("length"), "observations", F.sort_array("reasons").alias("reasons"))


def _apart(at: Column, before: Column, gap: str) -> Column:
    """Whether a time is more than the gap after the one before; the first of all is."""
    return F.coalesce(at > before + F.expr(f"INTERVAL {gap}"), F.lit(True))


def drift_episodes(drifts: DataFrame, key: list[str], at: str, reason: str, gap: str, slices: int | None = None) -> DataFrame:
    """key, start, end, length in seconds, observations and the sorted distinct reasons of each episode.

    ``drifts`` has a row per observation that drifted; those of a resource that lie ``gap`` (such as
    '1 hour') apart at most are one episode. Null is a key like any other; rows without a time are no
    observations; a null reason is not listed. Reasons are a set of small size, such as names of fields.
    """
    timed = drifts.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("_at"), F.col(reason).alias("_reason"))
    timed = timed.withColumn("_slice", even_slices(timed, ["_at"], slices))
    here = W.partitionBy(*key, "_slice").orderBy("_at")
    islands = (
        timed.withColumn("_new", _apart(F.col("_at"), F.lag("_at").over(here), gap).cast("int"))
        .withColumn("_island", F.sum("_new").over(here.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*key, "_slice", "_island")
        .agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count(F.lit(1)).alias("observations"), F.collect_set("_reason").alias("reasons"))
    )
    inside = W.partitionBy(*key, "_slice")
    islands = islands.withColumn("_edge", (F.col("_island") == 1) | (F.col("_island") == F.max("_island").over(inside)))
    whole = islands.where("NOT _edge").select(*key, "start", "end", "observations", "reasons")
    # Two islands per key and slice at most: those that may go on in another slice.
    across = W.partitionBy(*key).orderBy("start")
    edges = (
        islands.where("_edge")
        .withColumn("_new", _apart(F.col("start"), F.lag("end").over(across), gap).cast("int"))
        .withColumn("_island", F.sum("_new").over(across.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*key, "_island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("observations").alias("observations"),
            F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons"),
        )
    )
    return _measured(whole.unionByName(edges.select(*whole.columns)), key)


def session_episodes(drifts: DataFrame, key: list[str], at: str, reason: str, gap: str, lateness: str) -> DataFrame:
    """The same of a stream, in append mode: an episode comes once nothing can be added to it.

    Observations up to ``lateness`` behind the newest one so far, drifting or not, are part of
    their episode however late they come; older ones are dropped. Keep observations without
    drift in ``drifts``, with a null ``reason``, so that time goes on where nothing drifts.
    """
    timed = drifts.where(F.col(at).isNotNull()).withWatermark(at, lateness)
    # A session of no length is left out, and unlike a filter that is decided behind the watermark.
    length = F.when(F.col(reason).isNotNull(), F.lit(gap)).otherwise(F.lit("0 seconds"))
    windows = timed.groupBy(F.session_window(at, length).alias("_session"), *key).agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("observations"), F.collect_set(reason).alias("reasons")
    )
    return _measured(windows, key)
