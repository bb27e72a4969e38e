"""Queries on versioned flows: conversations are flows, their turns versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import EVENTS_SQL, events, joined, pick, query, table, tag
from driftline.functions import scalars as X
from driftline.operators import drift as D, extensions, observe as O, planning
from driftline.operators.payloads import build_import as import_payload

FLOW_SQL = """
fl AS (SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS INTEGER) - 1 AS want,
              CAST(count(*) FILTER (role = 'assistant') AS INTEGER) AS have,
              max(turn) AS newest, sum(length(text)) % 3 AS style FROM conversations GROUP BY 1),
fs AS (SELECT *, CASE style WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'STOPPED' ELSE 'DISABLED' END AS state,
              CASE WHEN want > 0 AND want <> have THEN 'flowVersion' ELSE '' END AS reasons FROM fl)
"""


def flows(spark, folder):
    """A flow per conversation: user turns give the wanted version, answers the current one."""
    counted = (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(
            F.count_if(F.col("role") == "user").cast("int").alias("users"),
            F.count_if(F.col("role") == "assistant").cast("int").alias("answers"),
            F.max("turn").alias("newest"),
            F.sum(F.length("text")).alias("chars"),
        )
    )
    style = F.col("chars") % 3
    return counted.select(
        "conv_id",
        "newest",
        style.alias("style"),
        F.struct(
            F.lit("root").alias("parentGroupId"),
            F.lit("registry").alias("registryId"),
            F.lit("bucket").alias("bucketId"),
            tag("flow-", "conv_id").alias("flowId"),
            (F.col("users") - 1).alias("flowVersion"),
            F.when(style == 0, F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))).alias("position"),
            pick(style, {0: "RUNNING", 1: "", 2: "DISABLED"}).alias("desiredState"),
        ).alias("desired"),
        F.struct(
            F.col("answers").alias("currentVersion"),
            F.when(style != 2, F.struct(F.lit("UP_TO_DATE").alias("state"))).alias("versionControlInformation"),
            F.col("users").alias("runningCount"),
            F.col("answers").alias("stoppedCount"),
        ).alias("observed"),
    )


@query("drift_flow", f"WITH {FLOW_SQL} SELECT conv_id, reasons, reasons = '' AS up_to_date FROM fs")
def drift_flow(spark, folder):
    return D.drift(flows(spark, folder), "RegistryFlow").select(
        "conv_id", joined(F.col("reasons")).alias("reasons"), "up_to_date"
    )


@query("steps_flow", f"""
WITH {FLOW_SQL},
p AS (SELECT *, CASE WHEN conv_id % 5 = 1 THEN 'DELETE' WHEN conv_id % 5 = 2 THEN 'CREATE'
                     WHEN reasons <> '' THEN 'UPDATE' ELSE 'NOOP' END AS action FROM fs)
SELECT conv_id, action, CASE action WHEN 'DELETE' THEN 'SCHEDULE_STOPPED,REFRESH,DELETE'
   WHEN 'CREATE' THEN concat_ws(',', 'IMPORT', CASE WHEN state = 'RUNNING' THEN 'SCHEDULE_RUNNING' END)
   WHEN 'UPDATE' THEN concat_ws(',', 'GET_VCI', CASE WHEN style <> 2 THEN 'CHANGE_VERSION' END, 'GET_GROUP',
        CASE WHEN state = 'RUNNING' AND have > 0 THEN 'SCHEDULE_RUNNING' END,
        CASE WHEN state = 'STOPPED' AND want + 1 > 0 THEN 'SCHEDULE_STOPPED' END)
   ELSE '' END AS steps FROM p""")
def steps_flow(spark, folder):
    drifted = D.drift(flows(spark, folder), "RegistryFlow")
    marked = drifted.withColumn("exists", F.col("conv_id") % 5 != 2).withColumn(
        "deletion_requested", F.col("conv_id") % 5 == 1
    )
    plan = planning.plan_steps(planning.plan_action(marked), "RegistryFlow")
    return plan.select("conv_id", "action", joined(F.col("steps")).alias("steps"))


@query("build_import", """
SELECT conv_id, turn, 'flow-' || conv_id AS flow_id,
       CAST(CASE WHEN turn - 1 <= 0 THEN -1 ELSE turn - 1 END AS INTEGER) AS version,
       CASE WHEN role = 'user' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, CAST(0 AS BIGINT) AS revision
FROM conversations""")
def build_import(spark, folder):
    rows = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.struct(
            F.lit("root").alias("parentGroupId"),
            F.lit("registry").alias("registryId"),
            F.lit("bucket").alias("bucketId"),
            tag("flow-", "conv_id").alias("flowId"),
            (F.col("turn") - 1).cast("int").alias("flowVersion"),
            F.when(
                F.col("role") == "user", F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
            ).alias("position"),
        ).alias("desired"),
    )
    control = "payload.component.versionControlInformation"
    return import_payload(rows).select(
        "conv_id",
        "turn",
        F.col(f"{control}.flowId").alias("flow_id"),
        F.col(f"{control}.version").alias("version"),
        F.col("payload.component.position.x").alias("x"),
        F.col("payload.revision.version").alias("revision"),
    )


@query("flow_current", """
WITH t AS (SELECT conv_id, count(*) AS turns, max(turn) AS newest FROM conversations GROUP BY 1)
SELECT conv_id, CAST(CASE WHEN conv_id % 4 IN (0, 1) THEN newest ELSE turns * 10 END AS INTEGER) AS current_version,
       CASE conv_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS stale
FROM t""")
def flow_current(spark, folder):
    """Lookups that answer with a number, with text, or fail."""
    seen = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.max("turn").alias("newest")
    )
    style = F.col("conv_id") % 4
    version = F.when(style < 2, F.col("newest").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("newest").cast("string"), F.lit('"'))
    )
    info = seen.select(
        "conv_id",
        F.try_parse_json(version).alias("version"),
        pick(style, {0: "STALE", 1: "UP_TO_DATE", 2: "LOCALLY_MODIFIED_AND_STALE"}, "stale").alias("state"),
        (style == 3).alias("failed"),
    )
    prior = seen.select(
        "conv_id",
        (F.col("turns") * 10).cast("int").alias("current_version"),
        F.lit(False).alias("stale"),
    )
    return O.flow_current(seen.select("conv_id"), info, prior, "conv_id")


@query("latest_available", """
SELECT conv_id AS flow_id, max(turn) AS latest_version FROM conversations GROUP BY 1""")
def latest_available(spark, folder):
    turns = table(spark, folder, "conversations")
    versions = turns.select(F.col("conv_id").alias("flow_id"), F.col("turn").alias("version"))
    return extensions.latest_available(versions.select("flow_id").distinct(), versions)


@query("is_stale", f"""
WITH {EVENTS_SQL}
SELECT event_id, k % 5 IN (0, 1) AS stale FROM ev""")
def is_stale(spark, folder):
    names = {0: "STALE", 1: "LOCALLY_MODIFIED_AND_STALE", 2: "stale", 3: "UP_TO_DATE"}
    return events(spark, folder).select(
        "event_id", X.is_stale(pick(F.col("k") % 5, names)).alias("stale")
    )


@query("version_number", f"""
WITH {EVENTS_SQL}
SELECT event_id, CAST(CASE WHEN k % 4 IN (0, 1) THEN k ELSE -1 END AS INTEGER) AS version FROM ev""")
def version_number(spark, folder):
    """A JSON number, with or without a fraction, counts; text and null keep the prior one."""
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("k") % 4 == 0, k)
        .when(F.col("k") % 4 == 1, F.concat(k, F.lit(".75")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit('"'), k, F.lit('"')))
        .otherwise("null")
    )
    return events(spark, folder).select(
        "event_id", X.number_to_int(F.try_parse_json(text), F.lit(-1)).alias("version")
    )
