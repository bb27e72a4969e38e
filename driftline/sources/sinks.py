"""Writing status, change log and record log as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.operators.changes import latest_revision
from driftline.operators.dataflow import log_lines
from driftline.session import path_exists
from driftline.streaming.state import BUCKETS, KeyedState


def merge_status(
    prior: DataFrame | None, fresh: DataFrame, key: list[str], revision: str, tiebreak: list[str]
) -> DataFrame:
    """The newest status per resource out of the prior snapshot and fresh observations."""
    rows = fresh if prior is None else prior.unionByName(fresh)
    return latest_revision(rows, key, revision, tiebreak)


def write_status(status: DataFrame, path: str, as_of: str) -> None:
    """Write one snapshot; writing the same ``as_of`` again replaces only that snapshot."""
    status.write.mode("overwrite").parquet(f"{path}/as_of={as_of}")


def read_status(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """One snapshot; the other ones are not listed or read."""
    return spark.read.parquet(f"{path}/as_of={as_of}")


class StatusTable:
    """The newest status per resource, upserted in numbered batches: copy on write by key bucket.

    A batch rewrites the buckets of the resources that it speaks of and then names the new files in a
    manifest, so a reader sees all of a batch or nothing of it, and goes on with the files it began with for
    some more batches. A batch that comes again changes nothing. Of a resource's rows the one of
    the greatest ``revision`` and ``tiebreak`` stays; one for which ``deleted`` holds ends it.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, key: list[str], revision: str, tiebreak: list[str],
        deleted: str | None = None, buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.revision, self.tiebreak = spark, path, revision, tiebreak
        self.state = KeyedState(spark, path, schema, key, [revision, *tiebreak], deleted, buckets=buckets, fanout=1)

    def batches(self) -> int:
        """How many batches have been written whole."""
        if not path_exists(self.spark, f"{self.path}/batches"):
            return 0
        return self.spark.read.schema("n int").json(f"{self.path}/batches/*").agg(F.max("n")).first()[0] or 0

    def upsert(self, fresh: DataFrame, batch: int) -> bool:
        """Write the batch of this number, from 0 without gaps; False where it has been written before."""
        known = self.batches()
        if batch < known:
            return False
        if batch > known:
            raise ValueError(f"batch {batch} comes after {known} batches")
        self.state.write(latest_revision(fresh, self.state.key, self.revision, self.tiebreak), batch)
        self.spark.range(1).select(F.lit(batch + 1).alias("n")).coalesce(1).write.mode("overwrite").json(f"{self.path}/batches/{batch}")
        return True

    def rows(self) -> DataFrame:
        """The status of every resource after the last whole batch."""
        return self.state.rows(self.batches())


def changelog_rows(plan: DataFrame, kind: str, key: str, at: Column, version: str) -> DataFrame:
    """One record per action taken: time, kind, key, action, steps, version tag, error."""
    error = F.col("error") if "error" in plan.columns else F.lit(None).cast("string")
    return plan.where("action <> 'NOOP'").select(
        at.alias("ts"),
        F.lit(kind).alias("kind"),
        F.col(key).cast("string").alias("key"),
        "action",
        "steps",
        F.lit(version).alias("version"),
        error.alias("error"),
    )


def write_changelog(records: DataFrame, path: str) -> None:
    """Append change records, in one folder per kind so that readers can prune."""
    records.write.mode("append").partitionBy("kind").parquet(path)


def write_log(records: DataFrame, path: str, level: str, payload: str | None = None) -> None:
    """Append one log line per record."""
    log_lines(records, level, payload).write.mode("append").parquet(path)


def write_keyed_table(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table bucketed and sorted by its key.

    Desired and observed tables saved with the same key and bucket count are joined,
    run after run, without shuffling either.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
