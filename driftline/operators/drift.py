"""Field-by-field comparison of declared and observed state.

Pure column work on rows that already hold both sides: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import compare as C
from driftline.functions.unnest import unnest
from driftline.kinds import KINDS


def drift_reasons(kind: str, desired: Column, observed: Column) -> Column:
    """Reasons in check order; the first is where an early exit would stop."""
    spec = KINDS[kind]
    compared = F.concat(*[check(desired, observed) for check in spec.checks])
    if not spec.has_component:
        return compared
    return F.when(observed["component"].isNull(), F.array(F.lit("component"))).otherwise(compared)


def drift(df: DataFrame, kind: str, desired: str = "desired", observed: str = "observed") -> DataFrame:
    """Add ``reasons`` and ``up_to_date``; rows without an observed side have no reasons
    and are not up to date."""
    o = F.col(observed)
    reasons = F.when(o.isNull(), C.no_reasons()).otherwise(
        drift_reasons(kind, F.col(desired), o)
    )
    return df.withColumn("reasons", reasons).withColumn(
        "up_to_date", o.isNotNull() & (F.size("reasons") == 0)
    )


def diff_named_rows(
    desired: DataFrame, observed: DataFrame, owner: str, position: str = "position"
) -> DataFrame:
    """``named_list_diff`` for lists kept as rows, one row per difference.

    Both sides have ``owner``, ``name``, ``value``, ``description`` and ``position``;
    ``has_body`` on the observed side is false for an entry without a body. Joined on
    (owner, name), so an owner with very many entries spreads over all tasks. A null name
    reads as ``''``; owners that only the observed side has are not compared.
    """
    name = F.coalesce("name", F.lit(""))
    desired, observed = desired.withColumn("name", name), observed.withColumn("name", name)
    last = (
        observed.where("has_body")
        .groupBy(owner, "name")
        .agg(F.max_by(F.struct("value", "description"), F.col(position)).alias("_last"))
    )
    matched = desired.join(last, [owner, "name"], "left")
    text = F.coalesce(F.col("description"), F.lit(""))
    per_entry = F.when(
        F.col("_last").isNull(), F.array(F.concat(F.lit("parameter:"), "name"))
    ).otherwise(
        F.concat(
            C.reason(
                F.col("value") != F.col("_last.value"), F.concat(F.lit("parameter_value:"), "name")
            ),
            C.reason(
                (text != "") & (text != F.col("_last.description")),
                F.concat(F.lit("parameter_description:"), "name"),
            ),
        )
    )
    entries = unnest(matched, [owner], per_entry, "reason")
    sizes = (
        desired.select(owner, F.lit(1).alias("_n"))
        .unionByName(observed.select(owner, F.lit(-1).alias("_n")))
        .groupBy(owner)
        .agg(F.sum("_n").alias("_n"), F.max(F.col("_n") > 0).alias("_declared"))
    )
    counts = sizes.where("_declared AND _n != 0").select(owner, F.lit("parameter_count").alias("reason"))
    return entries.unionByName(counts)


def drift_summary(drifted: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind, outcome and reason with subtotals (an extension).

    ``drifted`` has ``exists``, ``error``, ``reasons`` and ``up_to_date``. A row with
    several reasons counts once under each, and the subtotals count reasons.
    """
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(~F.col("exists"), "missing")
        .when(F.col("up_to_date"), "up_to_date")
        .otherwise("drifted")
    )
    rows = drifted.select(
        F.col(kind).alias("kind"), outcome.alias("outcome"), F.explode_outer("reasons").alias("reason")
    ).withColumn("reason", F.coalesce("reason", F.lit("-")))
    return rows.rollup("kind", "outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
