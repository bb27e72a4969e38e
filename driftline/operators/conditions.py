"""Conditions of resources and the columns a list view shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.changes import latest_revision

# The condition an action sets, as (type, status, reason).
ACTION_CONDITIONS = {
    "CREATE": ("Ready", "False", "Creating"),
    "UPDATE": ("Ready", "True", "Available"),
    "NOOP": ("Ready", "True", "Available"),
    "DELETE": ("Ready", "False", "Deleting"),
}


def conditions_by_type(conditions: DataFrame, key: list[str], tiebreak: list[str]) -> DataFrame:
    """At most one condition per resource and type; the latest transition wins."""
    return latest_revision(conditions, [*key, "type"], "lastTransitionTime", tiebreak)


def condition_status(conditions: Column, kind: str) -> Column:
    """Status of the condition of a type in a condition list, null without one."""
    return F.try_element_at(F.filter(conditions, lambda c: c["type"] == kind), F.lit(1))["status"]


def set_condition(df: DataFrame, action: str = "action") -> DataFrame:
    """Add ``condition`` (type, status, reason) for the action of each row.

    ``exists`` says whether the resource was found. What was found is available; what was
    not gets a condition only from its creation, so none where that is forbidden or
    where a deletion is through. Rows with an error keep no condition either: observing failed before any was set.
    """
    value = F.lit(None).cast("struct<type:string,status:string,reason:string>")
    for name, (kind, status, why) in ACTION_CONDITIONS.items():
        stated = F.struct(
            F.lit(kind).alias("type"), F.lit(status).alias("status"), F.lit(why).alias("reason")
        )
        sets = F.col(action) == name if name == "CREATE" else F.col("exists") & (F.col(action) == name)
        value = F.when(sets, stated).otherwise(value)
    return df.withColumn("condition", value)


def external_name(annotations: Column) -> Column:
    """Value of the annotation whose key ends in ``/external-name``."""
    named = F.map_filter(annotations, lambda k, v: F.endswith(k, F.lit("/external-name")))
    return F.try_element_at(F.map_values(named), F.lit(1))


def printer_columns(resources: DataFrame, as_of: Column) -> DataFrame:
    """List view of resources: READY, SYNCED, EXTERNAL-NAME and AGE in seconds.

    ``resources`` has ``metadata`` (with ``name``, ``annotations``,
    ``creationTimestamp``) and ``conditions``. Age is taken at ``as_of``.
    """
    created = F.col("metadata.creationTimestamp")
    return resources.select(
        F.col("metadata.name").alias("name"),
        condition_status(F.col("conditions"), "Ready").alias("ready"),
        condition_status(F.col("conditions"), "Synced").alias("synced"),
        external_name(F.col("metadata.annotations")).alias("external_name"),
        F.timestamp_diff("SECOND", created, as_of).alias("age_seconds"),
    )
