"""Fleet counts. Every aggregate here combines inside each task before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.conditions import condition_status


def group_counts(components: DataFrame, parent: str, state: str) -> DataFrame:
    """Running, stopped, disabled and invalid components per group.

    ``state`` holds ``running``, ``stopped``, ``disabled`` or ``invalid`` in any case.
    """
    folded = components.select(parent, F.lower(F.col(state)).alias("_state"))
    return folded.groupBy(parent).agg(
        *[
            F.count_if(F.col("_state") == name).cast("int").alias(f"{name}Count")
            for name in ("running", "stopped", "disabled", "invalid")
        ]
    )


def state_metrics(resources: DataFrame, *more: Column) -> DataFrame:
    """Per kind: resources in total, ready and synced.

    ``resources`` has ``kind`` and ``conditions``; ``more`` adds grouping columns, such
    as a time window.
    """
    conditions = F.col("conditions")
    return resources.groupBy("kind", *more).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(condition_status(conditions, "Ready") == "True").alias("ready"),
        F.count_if(condition_status(conditions, "Synced") == "True").alias("synced"),
    )


def state_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per kind what ``total``, ``ready`` and ``synced`` change by when the resources ``before`` are replaced by those ``after``."""
    signed = before.select("kind", "conditions", F.lit(-1).alias("_sign")).unionByName(after.select("kind", "conditions", F.lit(1).alias("_sign")))
    holds = lambda name: F.when(condition_status(F.col("conditions"), name) == "True", F.col("_sign")).otherwise(0)
    return signed.groupBy("kind").agg(
        F.sum("_sign").alias("total"), F.sum(holds("Ready")).alias("ready"), F.sum(holds("Synced")).alias("synced")
    )


def add_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """The counts of ``state_metrics`` after ``deltas``; a kind that has no resource left goes."""
    both = counts.unionByName(deltas).groupBy("kind")
    return both.agg(*[F.sum(c).alias(c) for c in ("total", "ready", "synced")]).where("total > 0")


#: Bits of an age that each pass of ``reconcile_metrics`` settles; so many bins per group at most.
AGE_DIGITS = (42, 21, 0)
SHARES = {"age_p50": 0.5, "age_p95": 0.95}


def reconcile_metrics(changelog: DataFrame, age: str = "age_seconds") -> DataFrame:
    """Per kind and action: records, failures and the median and 95th percentile of age.

    A percentile is the least age that this share of the records with an age does not
    exceed. It is exact at every size: records are counted per whole age, and the place
    of each percentile is narrowed down by the high, the middle and the low bits of the age.
    """
    kept = changelog.select("kind", "action", F.col(age).cast("bigint").alias("_age"), F.col("error").isNotNull().alias("_bad"))
    counted = kept.groupBy("kind", "action", "_age").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_bad").alias("_failed"))
    group = F.struct("kind", "action")
    ages = counted.where("_age IS NOT NULL").select(group.alias("_group"), "_age", "_n")
    share = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("share")) for c, p in SHARES.items()])).alias("_of")
    places = (
        ages.groupBy("_group").agg(F.sum("_n").alias("_all"))
        .select("_group", "_all", share)
        .select("_group", F.col("_of.column").alias("_column"), F.ceil(F.col("_all") * F.col("_of.share")).alias("_place"), F.lit(0).cast("bigint").alias("_bin"))
    )
    above = 63
    for bits in AGE_DIGITS:
        bins = ages.select("_group", F.shiftright("_age", bits).alias("_next"), "_n").groupBy("_group", "_next").agg(F.sum("_n").alias("_n"))
        inside = bins.join(places, "_group") if above == 63 else bins.withColumn(
            "_bin", F.shiftright("_next", above - bits)
        ).join(places, ["_group", "_bin"])
        running = W.partitionBy("_group", "_column").orderBy("_next")
        placed = inside.withColumn("_upto", F.sum("_n").over(running.rowsBetween(W.unboundedPreceding, 0)))
        hit = (F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place"))
        places = placed.where(hit).select(
            "_group", "_column", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_place"), F.col("_next").alias("_bin")
        )
        above = bits
    wide = places.groupBy("_group").agg(*[F.max(F.when(F.col("_column") == c, F.col("_bin"))).alias(c) for c in SHARES])
    totals = counted.groupBy(group.alias("_group")).agg(F.sum("_n").alias("n"), F.sum("_failed").alias("failed"))
    return totals.join(wide, "_group", "left").select("_group.*", "n", "failed", *SHARES)


def source_rates(records: DataFrame, source: str, at: str, window: str = "1 hour") -> DataFrame:
    """Per source: records, first and last time, windows with a record and the most records in one of them.

    Records are counted per source and window first, inside each task already, so a source with most of
    the records is as many rows as it has windows. Records without a time are counted, but are in no
    window; those without a source are one source.
    """
    counted = records.groupBy(F.col(source).alias("source"), F.window(at, window).alias("_window")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last")
    )
    untimed = records.where(F.col(at).isNull()).groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.unionByName(untimed, allowMissingColumns=True).groupBy("source").agg(
        F.sum("_n").alias("records"), F.min("_first").alias("first"), F.max("_last").alias("last"),
        F.count("_window").alias("windows"), F.max(F.when(F.col("_window").isNotNull(), F.col("_n"))).alias("busiest"),
    )


def attribute_skew(records: DataFrame, attributes: list[str]) -> DataFrame:
    """Per attribute: records, distinct values, the commonest value (of equal ones the least as text), its count,
    and by how many hundredths that count is above the mean of all values.

    Says before a shuffle by an attribute whether one value would hold it up. Null is a value. The records are read once,
    as one row per attribute; counts per value combine inside each task.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    counted = records.select(F.explode(pairs).alias("_of")).groupBy("_of.attribute", "_of.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("attribute").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("values"),
        F.min_by(F.struct("value"), F.struct(-F.col("n"), "value")).alias("_top"), F.max("n").alias("most"),
    ).select("attribute", "records", "values", F.col("_top.value").alias("commonest"), "most", F.expr("most * `values` * 100 div records").alias("of_mean"))
