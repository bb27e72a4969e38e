"""Synthetic records, as the generating processor of the example flow emits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as X

#: Records one task row stands for before they are spelled out.
CHUNK = 10_000

# Settings of the example generator.
PERIOD = "5 sec"
BATCH_SIZE = 1
RECORD_SIZE = "1 KB"


def generate_records(generators: DataFrame, duration_ms: int) -> DataFrame:
    """Records of every generator over ``duration_ms``: one batch per period, from time 0.

    ``generators`` has ``generator_id``, ``period``, ``batch_size`` and ``record_size``.
    Work is cut into chunks that are spread over the cluster before any record exists,
    so one busy generator is shared by many tasks. The number of tasks is stated, since
    the chunks alone look too small to keep apart.
    """
    tasks = int(generators.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    period = X.duration_ms(F.col("period"))
    ticks = F.ceil(F.lit(duration_ms) / period)
    planned = generators.select(
        "generator_id",
        period.alias("_period"),
        F.col("batch_size").cast("bigint").alias("_batch"),
        X.size_bytes(F.col("record_size")).alias("_size"),
        (ticks * F.col("batch_size")).cast("bigint").alias("_total"),
    ).where("_total > 0")
    chunks = planned.withColumn(
        "_from", F.explode(F.sequence(F.lit(0), F.col("_total") - 1, F.lit(CHUNK)))
    ).repartition(tasks, "generator_id", "_from")
    upto = F.least(F.col("_from") + CHUNK, F.col("_total")) - 1
    return chunks.withColumn("sequence", F.explode(F.sequence("_from", upto))).select(
        "generator_id",
        "sequence",
        (F.floor(F.col("sequence") / F.col("_batch")) * F.col("_period")).alias("offset_ms"),
        F.repeat(F.lit("x"), F.col("_size").cast("int")).alias("content"),
    )


def generate_stream(
    spark: SparkSession, batch_size: int = BATCH_SIZE, period_ms: int = 5000, record_bytes: int = 1024
) -> DataFrame:
    """The same as an endless stream: ``batch_size`` records per micro-batch."""
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", batch_size)
        .option("advanceMillisPerBatch", period_ms)
        .load()
    )
    content = F.repeat(F.lit("x"), record_bytes).alias("content")
    return ticks.select("timestamp", F.col("value").alias("sequence"), content)
