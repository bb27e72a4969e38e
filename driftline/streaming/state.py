"""State of a stream as a log-structured table: runs of changed rows in key buckets, merged level by level.

A micro-batch writes the rows that it changed as one run, split by a hash of the key into
buckets, and a reader that knows its keys opens only their buckets. When a bucket has
``FANOUT`` runs of a level they become one run of the next level, so a row is written
again a logarithmic number of times and a bucket never has many runs. A manifest per
micro-batch names the runs of every bucket; it is written last, so a micro-batch that fails
leaves what went before as it was, and one that comes again is known and left out. With a
fan-out of 1 every write merges at once: each bucket is one run, rewritten when it is touched.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from driftline.operators.changes import latest_revision
from driftline.session import drop_path, path_exists

BUCKETS = 64
#: Runs of a level in a bucket that become one run of the next level.
FANOUT = 4
#: Micro-batches for which the runs that a merge has replaced stay for those who still read them.
GRACE = 2
BUCKET, EPOCH = "_bucket", "_written"

#: bucket: runs as (level, folder), newest last.
Runs = dict[int, list[tuple[int, str]]]


class KeyedState:
    """The newest row of each ``key``, in ``path``; ``order`` says which row of a key is the newest.

    A row for which ``deleted`` holds ends its key: no read shows the key, and the row itself
    stays, so that an older row that comes late does not bring the key back. After
    ``lateness`` micro-batches it goes with the next merge that reaches the lowest
    level; None keeps it for good. Null is a key like any other.

    ``buckets`` is chosen for a state when it is first written, and holds from then on.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, key: list[str], order: list[str], deleted: str | None = None,
        lateness: int | None = None, buckets: int = BUCKETS, fanout: int = FANOUT,
    ):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        self.deleted, self.lateness, self.buckets, self.fanout = deleted, lateness, buckets, fanout
        self.stored = StructType([*schema.fields, StructField(EPOCH, LongType())])
        self.dealt = StructType([*self.stored.fields, StructField(BUCKET, IntegerType())])

    # What is where.

    def manifest(self, epochs: int) -> dict:
        """runs by bucket, the number of buckets, and what merges have replaced, after the first ``epochs`` micro-batches."""
        if not epochs:
            return {"buckets": self.buckets, "runs": {}, "replaced": []}
        row = self.spark.read.schema("manifest string").json(f"{self.path}/manifest={epochs - 1}").first()
        found = json.loads(row["manifest"])
        found["runs"] = {int(b): [tuple(r) for r in runs] for b, runs in found["runs"].items()}
        return found

    def _write_manifest(self, epoch: int, manifest: dict) -> None:
        rows = self.spark.range(1).select(F.lit(json.dumps(manifest)).alias("manifest")).coalesce(1)
        rows.write.mode("overwrite").json(f"{self.path}/manifest={epoch}")

    def bucket(self, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets or self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, epochs: int) -> list[int]:
        """The buckets that the keys of ``rows`` are in; at most as many as the state has."""
        n = self.manifest(epochs)["buckets"]
        return sorted(r[0] for r in rows.select(self.bucket(n).alias("b")).distinct().collect())

    # Reading.

    def _read(self, folders: Iterable[str]) -> DataFrame:
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*folders)

    def _newest(self, rows: DataFrame) -> DataFrame:
        # Of equal rows the one that was written last; the order decides first.
        return latest_revision(rows, self.key, self.order[0], [*self.order[1:], EPOCH])

    def _ended(self) -> Column:
        return F.coalesce(F.expr(self.deleted), F.lit(False)) if self.deleted else F.lit(False)

    def folders(self, epochs: int, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders that a read of these buckets (None: all) opens."""
        runs = self.manifest(epochs)["runs"]
        chosen = runs if buckets is None else [b for b in buckets if b in runs]
        return [f"{self.path}/{folder}/{BUCKET}={b}" for b in chosen for _, folder in runs[b]]

    def rows(self, epochs: int, buckets: Iterable[int] | None = None, ended: bool = False) -> DataFrame:
        """The newest rows after the first ``epochs`` micro-batches, of all buckets or of some; keys that have ended only if asked for."""
        newest = self._newest(self._read(self.folders(epochs, buckets)))
        return (newest if ended else newest.where(~self._ended())).drop(EPOCH)

    def lookup(self, rows: DataFrame, epochs: int, ended: bool = False) -> DataFrame:
        """The state's rows in the buckets that the keys of ``rows`` are in; no other bucket is opened."""
        return self.rows(epochs, self.buckets_of(rows, epochs), ended)

    # Writing.

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> None:
        columns = [f.name for f in self.stored.fields]
        # A task per bucket, or several where a bucket is large.
        dealt = rows.select(*columns, self.bucket(buckets).alias(BUCKET)).hint("rebalance", BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def _dealt_to(self, folder: str) -> list[int]:
        """The buckets that a run has rows in."""
        return sorted(r[0] for r in self.spark.read.schema(self.dealt).parquet(f"{self.path}/{folder}").select(BUCKET).distinct().collect())

    def done(self, epoch: int) -> bool:
        """Whether the micro-batch ``epoch`` has been written whole."""
        return path_exists(self.spark, f"{self.path}/manifest={epoch}/_SUCCESS")

    def write(self, changed: DataFrame, epoch: int) -> bool:
        """Add the newest row of each key that the micro-batch ``epoch`` (from 0) has changed; a row older than the state's changes nothing.

        False, and nothing is written, where the same micro-batch has been written before.
        """
        if self.done(epoch):
            return False
        manifest = self.manifest(epoch)
        n, runs = manifest["buckets"], manifest["runs"]
        columns = [f.name for f in self.schema.fields]
        folder = f"changes={epoch}"
        self._write(changed.select(*columns, F.lit(epoch).cast("bigint").alias(EPOCH)), folder, n)
        touched = self._dealt_to(folder)
        runs = {**runs, **{b: [*runs.get(b, []), (0, folder)] for b in touched}}
        merges = {b: m for b in touched if (m := due(runs[b], self.fanout))}
        replaced = []
        if merges:
            merged = f"merged={epoch}"
            self._write(self._merged(runs, merges, epoch), merged, n)
            # A bucket of which nothing is left has no folder.
            left = self._dealt_to(merged)
            for b, (keep, level) in merges.items():
                replaced += [f"{f}/{BUCKET}={b}" for _, f in runs[b][keep:]]
                runs[b] = [*runs[b][:keep], *([(level, merged)] if b in left else [])]
        waiting = [r for r in manifest["replaced"] if r[0] + GRACE >= epoch]
        for _, gone in (r for r in manifest["replaced"] if r[0] + GRACE < epoch):
            drop_path(self.spark, f"{self.path}/{gone}")
        self._write_manifest(epoch, {"buckets": n, "runs": {b: r for b, r in runs.items() if r}, "replaced": [*waiting, *([epoch, f] for f in replaced)]})
        if epoch > GRACE:
            drop_path(self.spark, f"{self.path}/manifest={epoch - GRACE - 1}")
        return True

    def _merged(self, runs: Runs, merges: dict[int, tuple[int, int]], epoch: int) -> DataFrame:
        """The newest rows of the runs that are merged; rows that ended a key long ago go where nothing older lies below."""
        whole = [b for b, (keep, _) in merges.items() if not keep]
        newest = self._newest(self._read(f"{self.path}/{f}/{BUCKET}={b}" for b, (keep, _) in merges.items() for _, f in runs[b][keep:]))
        if self.deleted is None or self.lateness is None or not whole:
            return newest
        old = F.col(EPOCH) + self.lateness < epoch
        lowest = self.bucket(self.manifest(epoch)["buckets"]).isin(whole)
        return newest.where(~(self._ended() & old & lowest))


def due(runs: list[tuple[int, str]], fanout: int) -> tuple[int, int] | None:
    """How many of a bucket's runs stay as they are, and the level of the run that the others become; None if no level is full."""
    if fanout == 1:
        return (0, 0) if len(runs) > 1 else None
    keep, level = len(runs), 0
    while True:
        start = keep
        while start and runs[start - 1][0] <= level:
            start -= 1
        # The run made of the levels above counts as one of this level.
        if keep - start + (keep < len(runs)) < fanout:
            break
        keep, level = start, level + 1
    return None if keep == len(runs) else (keep, level)
