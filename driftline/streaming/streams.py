"""The reconcile operators over streams.

Every query takes ``trigger`` as keyword arguments of ``DataStreamWriter.trigger``.
Sinks write one folder per micro-batch and overwrite it, so a batch that is run again
after a failure replaces its own output and nothing else. State is a table in key buckets
(``KeyedState``) of which a micro-batch opens those of its keys, so every micro-batch is an
ordinary batch plan whose cost follows the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from driftline.operators.changes import latest_revision, with_previous
from driftline.operators.metrics import add_deltas, state_deltas
from driftline.operators.observe import newest_per_key
from driftline.plans.reconcile import reconcile
from driftline.sources.sinks import changelog_rows
from driftline.streaming.state import KeyedState

# The default intervals.
POLL = {"processingTime": "1 minute"}
METRIC_INTERVAL = {"processingTime": "5 seconds"}


def _start(
    df: DataFrame, out: str, trigger: dict, mode: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def _replace(rows: DataFrame, out: str, epoch: int, name: str = "rows") -> DataFrame:
    """Write ``rows`` as the output of ``epoch`` and give them as the written table, whose size Spark knows."""
    path = f"{out}/{name}/epoch={epoch}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_rows(spark: SparkSession, out: str) -> DataFrame:
    """Everything a stream has written to ``out``, with the ``epoch`` that wrote it."""
    return spark.read.parquet(f"{out}/rows")


def stream_observe(
    source: DataFrame, desired: DataFrame, kind: str, key: str, out: str, trigger: dict = POLL
) -> StreamingQuery:
    """Check every resource that is observed against its declared state, once per micro-batch.

    The newest observation of each key is written first; it then meets the declared
    table, read within the batch's range of keys, as a side whose size is known, and a small
    one is broadcast instead of shuffling the declared table. What nobody observes is the
    matter of ``stream_check_all``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        newest = _replace(newest_per_key(batch.where(F.col(key).isNotNull()), key), out, epoch, "observed")
        low, high = newest.agg(F.min(key), F.max(key)).first()
        wanted = desired.where(F.col(key).between(F.lit(low), F.lit(high)))
        _replace(reconcile(wanted, newest, kind, key, only_fetched=True, unique=True), out, epoch)

    return _start(source, out, trigger, "append", write)


def stream_check_all(
    ticks: DataFrame, desired: Callable[[], DataFrame], observed: Callable[[], DataFrame], kind: str, key: str,
    out: str, trigger: dict = POLL,
) -> StreamingQuery:
    """Check everything that is declared at each tick, also what no observation speaks of.

    ``ticks`` only gives the pace, such as the rate source. ``desired`` and ``observed`` are asked
    anew each time; ``observed`` has a row per key, such as the table of ``stream_latest_status``.
    What is declared and gone gets its CREATE here.
    """

    def write(_: DataFrame, epoch: int) -> None:
        _replace(reconcile(desired(), observed(), kind, key, unique=True), out, epoch)

    return _start(ticks, out, trigger, "append", write)


def stream_desired_changed(
    source: DataFrame,
    key: list[str],
    order: list[str],
    fields: list[str],
    out: str,
    trigger: dict = POLL,
    deleted: str | None = None,
) -> StreamingQuery:
    """Pass events whose desired fields differ from the last event of their key.

    Events are compared inside the micro-batch, a hot key in slices by many tasks; only the
    first event of each key meets the state, and only the last one enters it. Order within a micro-batch is
    ``order``; across micro-batches it is arrival. ``deleted`` is a condition on events that end a
    key: its state goes, and the next event of the key is a first one again.
    """
    spark = source.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        state = KeyedState(
            spark, f"{out}/state", batch.withColumn("_epoch", F.lit(epoch).cast("bigint")).schema, key, ["_epoch", *order], deleted,
            # What arrives later is newer here, so that nothing can come late.
            lateness=0,
        )
        gone = F.coalesce(F.expr(deleted), F.lit(False)) if deleted else F.lit(False)
        staged = with_previous(batch.withColumn("_gone", gone), key, order, [*fields, "_gone"])
        now, before = F.struct(*fields), F.struct(*[F.col(f"_prev.{f}") for f in fields])
        same = ~F.col("_prev._gone") & before.eqNullSafe(now)
        later = staged.where(F.col("_prev").isNotNull() & ~same).select(*batch.columns)
        firsts = _replace(staged.where("_prev IS NULL").select(*batch.columns), out, epoch, "firsts")
        who = F.struct(*key).alias("_who")
        last = state.lookup(firsts, epoch).select(who, F.struct(*fields).alias("_last"))
        met = firsts.withColumn("_who", F.struct(*key)).join(last, "_who", "left")
        changed = met.where(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(now)).select(*batch.columns)
        _replace(later.unionByName(changed), out, epoch)
        newest = latest_revision(batch, key, order[0], order[1:])
        state.write(newest.withColumn("_epoch", F.lit(epoch).cast("bigint")), epoch)

    return _start(source, out, trigger, "append", write)


def stream_state_metrics(
    source: DataFrame, key: list[str], revision: str, tiebreak: list[str], out: str,
    trigger: dict = METRIC_INTERVAL, deleted: str | None = None, lateness: int | None = None,
) -> StreamingQuery:
    """Counts per kind of all resources as they are, at each tick.

    ``source`` has ``key``, ``kind`` and ``conditions``; a late lower revision changes nothing. Every
    micro-batch is a tick: it takes off the counts what its resources were, adds what they are
    now, and writes the counts. It reads the counts of the tick before and the state of the
    batch's buckets, never all resources.
    """
    spark = source.sparkSession
    order = [revision, *tiebreak]

    def write(batch: DataFrame, epoch: int) -> None:
        state = KeyedState(spark, f"{out}/state", batch.schema, key, order, deleted, lateness)
        newest = _replace(latest_revision(batch, key, revision, tiebreak), out, epoch, "newest")
        live = ~F.coalesce(F.expr(deleted), F.lit(False)) if deleted else F.lit(True)
        facts = F.struct(F.struct(*order).alias("order"), "kind", "conditions", live.alias("live"))
        now = newest.select(F.struct(*key).alias("_who"), facts.alias("now"))
        known = state.lookup(newest, epoch, ended=True).select(F.struct(*key).alias("_who"), facts.alias("was"))
        met = now.join(known, "_who", "left").where("was IS NULL OR now.order >= was.order")
        deltas = state_deltas(met.where("was.live").select("was.*"), met.where("now.live").select("now.*"))
        _replace(add_deltas(_counts(spark, out, epoch), deltas), out, epoch)
        state.write(newest, epoch)

    return _start(source, out, trigger, "append", write)


def _counts(spark: SparkSession, out: str, epoch: int) -> DataFrame:
    """The counts of the tick before ``epoch``: a row per kind."""
    schema = "kind string, total bigint, ready bigint, synced bigint"
    return spark.read.schema(schema).parquet(f"{out}/rows/epoch={epoch - 1}") if epoch else spark.createDataFrame([], schema)


def stream_rows(source: DataFrame, out: str, trigger: dict = POLL) -> StreamingQuery:
    """Append rows, such as those of ``log_lines``, as they come."""
    return (
        source.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/rows")
        .trigger(**trigger)
        .start()
    )


def stream_changelog(
    plan: DataFrame, kind: str, key: str, at: Column, version: str, out: str, trigger: dict = POLL
) -> StreamingQuery:
    """Append a change record for every action of a stream of planned resources; see ``changelog_rows``."""
    return stream_rows(changelog_rows(plan, kind, key, at, version), out, trigger)


def stream_latest_status(
    source: DataFrame, key: list[str], revision: str, tiebreak: list[str], out: str,
    trigger: dict = POLL, deleted: str | None = None, lateness: int | None = None,
) -> StreamingQuery:
    """Keep the newest status per resource; late lower revisions change nothing, also those of a resource that ``deleted`` has ended.

    A micro-batch writes the newest row of each resource it speaks of. Rows may come ``lateness``
    micro-batches after the end of their resource, any number by default.
    """
    spark = source.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        state = KeyedState(spark, f"{out}/state", batch.schema, key, [revision, *tiebreak], deleted, lateness)
        state.write(latest_revision(batch, key, revision, tiebreak), epoch)
        spark.range(1).select(F.lit(epoch + 1).alias("epochs")).coalesce(1).write.mode("overwrite").json(f"{out}/epochs")

    return _start(source, out, trigger, "append", write)


def read_status_rows(
    source: DataFrame, out: str, key: list[str], revision: str, tiebreak: list[str], deleted: str | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """The latest status per resource of a ``stream_latest_status`` of rows like ``source``'s.

    ``only`` names resources by their ``key``: no bucket but theirs is opened.
    """
    spark = source.sparkSession
    epochs = spark.read.schema("epochs int").json(f"{out}/epochs").first()["epochs"]
    state = KeyedState(spark, f"{out}/state", source.schema, key, [revision, *tiebreak], deleted)
    if only is None:
        return state.rows(epochs)
    wanted = only.select(*key).distinct()
    who = lambda df: df.withColumn("_who", F.struct(*key))
    return who(state.lookup(wanted, epochs)).join(who(wanted).select("_who"), "_who", "left_semi").drop("_who")
