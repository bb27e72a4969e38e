"""Snapshots of a table with a tree of digests, so that two of them are compared where they differ only.

Rows are dealt to buckets by a hash of the key. A bucket's digest is a sum over its rows, so rows that
repeat count and their order does not, and a node of the tree is the sum of the nodes below it. Two snapshots
are compared from the root down; only buckets whose digests differ are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from driftline.functions.columns import quoted, whole_row

#: Buckets of a snapshot, a power of FAN; nodes of a level that have one parent.
BUCKETS, FAN = 256, 16
#: Digits of a row's digest that each of its parts takes; two parts of 60 bits and sums of them.
PARTS = {"low": (1, 15), "high": (16, 15)}
DIGESTS = "level int, node int, n bigint, low decimal(38,0), high decimal(38,0)"


def row_digests(df: DataFrame) -> list[Column]:
    """Two numbers that tell rows apart: parts of the SHA-256 of the row as JSON, which leaves nulls out and quotes texts."""
    digest = F.sha2(F.to_json(whole_row(df)), 256)
    return [F.conv(F.substring(digest, at, n), 16, 10).cast("decimal(38,0)").alias(name) for name, (at, n) in PARTS.items()]


def levels(buckets: int) -> int:
    """How many levels stand above the buckets, the root included."""
    count, n = 0, 1
    while n < buckets:
        n *= FAN
        count += 1
    if n != buckets:
        raise ValueError(f"the number of buckets is a power of {FAN}")
    return count


def write_snapshot(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Write ``df`` in buckets of ``key`` (null is a key like any other), and its digests; a second write replaces the first."""
    top = levels(buckets)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(quoted(k)) for k in key]), F.lit(buckets)).cast("int"))
    # A task per bucket, or several where a bucket is large.
    dealt.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
    rows = _rows(df.sparkSession, path, df.schema)
    sums = [F.sum(c).alias(c) for c in PARTS]
    leaves = rows.select("_bucket", *row_digests(rows.drop("_bucket"))).groupBy(F.col("_bucket").alias("node")).agg(F.count(F.lit(1)).alias("n"), *sums)
    # One row per bucket: a level above is a sum of its nodes.
    each = F.explode(F.sequence(F.lit(0), F.lit(top)))
    nodes = leaves.select(each.alias("level"), "node", "n", *PARTS).withColumn("node", F.floor(F.col("node") / F.pow(F.lit(FAN), F.col("level"))).cast("int"))
    tree = nodes.groupBy("level", "node").agg(F.sum("n").alias("n"), *sums)
    tree.repartition(1, "level").write.mode("overwrite").partitionBy("level").parquet(f"{path}/digests")


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{path}/rows")


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A snapshot's rows, of this schema."""
    return _rows(spark, path, schema).drop("_bucket")


def _digests(spark: SparkSession, path: str, level: int, nodes: list[int]) -> DataFrame:
    return spark.read.schema(DIGESTS).parquet(f"{path}/digests").where((F.col("level") == level) & F.col("node").isin(nodes)).drop("level")


def _some_rows(spark: SparkSession, path: str, schema: StructType, buckets: list[int]) -> DataFrame:
    """The rows of these buckets; the folders of others are not so much as listed."""
    present = sorted(r["node"] for r in _digests(spark, path, 0, buckets).select("node").collect())
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/_bucket={b}" for b in present])


def differing_buckets(spark: SparkSession, old: str, new: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets whose digests differ, found from the root down; at most as many numbers as there are buckets."""
    suspects = [0]
    for level in range(levels(buckets), -1, -1):
        one, two = (_digests(spark, path, level, suspects).alias(name) for path, name in ((old, "o"), (new, "n")))
        same = F.lit(True)
        for c in ("n", *PARTS):
            same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        both = one.join(two, F.col("o.node") == F.col("n.node"), "full").where(~same)
        found = sorted(r[0] for r in both.select(F.coalesce("o.node", "n.node")).collect())
        if not found or not level:
            return found
        suspects = [node * FAN + i for node in found for i in range(FAN)]
    return []


def snapshot_difference(spark: SparkSession, old: str, new: str, schema: StructType, buckets: int = BUCKETS) -> DataFrame:
    """The rows of which the two snapshots have not the same number, with ``change``: how many more the new one has, or fewer.

    Rows are compared in all columns, null equal to null; a column of maps cannot be. Snapshots have been
    written with the same key and number of buckets. Buckets of equal digests are not read.
    """
    differing = differing_buckets(spark, old, new, buckets)
    signed = None
    for path, sign in ((old, -1), (new, 1)):
        rows = _some_rows(spark, path, schema, differing)
        part = rows.select(whole_row(rows).alias("_row"), F.lit(sign).alias("_sign"))
        signed = part if signed is None else signed.unionByName(part)
    changes = signed.groupBy("_row").agg(F.sum("_sign").alias("change")).where("change <> 0")
    return changes.select("_row.*", "change")
