"""Registry of the queries and the bindings several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.changes import latest_revision

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL it must agree with."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined(items: Column) -> Column:
    """A list as text, so that both engines hash it alike."""
    return F.array_join(items, ",")


def tag(text: str, key: Column | str) -> Column:
    """A name made of a text and a key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(text), key.cast("string"))


def pick(value: Column, choices: dict, default=None) -> Column:
    """``choices[value]`` as a column."""
    out = F.lit(default)
    for key, result in choices.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


# Events with the number in their JSON text.

EVENTS_SQL = "ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )


# Orders as groups, their lines as components.

RUN_STATE = {"F": "RUNNING", "O": "STOPPED", "P": "DISABLED"}

GROUPS_SQL = """
c AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS running,
             count(*) FILTER (l_linestatus = 'O') AS stopped FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS key, o_custkey, o_orderdate, c.l_orderkey IS NOT NULL AS present,
             CASE o_orderstatus WHEN 'F' THEN 'RUNNING' WHEN 'O' THEN 'STOPPED'
                  ELSE 'DISABLED' END AS desired_state,
             coalesce(running, 0) AS running, coalesce(stopped, 0) AS stopped,
             CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS want,
             CASE WHEN running >= 3 THEN '5-LOW' ELSE o_orderpriority END AS have
      FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
gd AS (SELECT *,
         CASE WHEN want <> '' AND want <> have THEN 'comments' END AS r_comments,
         CASE WHEN desired_state = 'RUNNING' AND stopped > 0 THEN 'stopped_count' END AS r_stopped,
         CASE WHEN desired_state = 'STOPPED' AND running > 0 THEN 'running_count' END AS r_running
       FROM g),
gr AS (SELECT *, concat_ws(',', r_comments, r_stopped, r_running) AS reasons,
              coalesce(r_comments, r_stopped, r_running) IS NULL AS up_to_date FROM gd)
"""


def desired_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One declared group per order: ``key``, ``o_orderdate`` and ``desired``."""
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        "o_custkey",
        "o_orderdate",
        "o_orderstatus",
        "o_totalprice",
        priority.alias("priority"),
        F.struct(
            F.col("o_custkey").cast("string").alias("parentGroupId"),
            tag("order ", "o_orderkey").alias("name"),
            F.lit(None).cast("struct<x:double,y:double>").alias("position"),
            F.when(priority == "4-NOT SPECIFIED", "").otherwise(priority).alias("comments"),
            F.lit("").alias("parameterContextId"),
            pick(F.col("o_orderstatus"), RUN_STATE).alias("desiredState"),
        ).alias("desired"),
    )


def component_counts(spark: SparkSession, folder: str, which: str = "true") -> DataFrame:
    """Counts per order of the lines that the condition ``which`` holds for."""
    from driftline.operators.metrics import group_counts

    lines = table(spark, folder, "lineitem").where(which).select(
        F.col("l_orderkey").alias("key"),
        pick(F.col("l_linestatus"), {"F": "running", "O": "stopped"}).alias("state"),
    )
    return group_counts(lines, "key", "state")


def observed_groups(counted: DataFrame) -> DataFrame:
    """Add ``observed`` to declared groups that already carry their component counts."""
    running = F.coalesce("runningCount", F.lit(0))
    entity = F.struct(
        F.col("key").cast("string").alias("id"),
        F.struct(F.lit(0).cast("bigint").alias("version")).alias("revision"),
        F.struct(
            tag("order ", "key").alias("name"),
            F.when(running >= 3, "5-LOW").otherwise(F.col("priority")).alias("comments"),
        ).alias("component"),
        running.alias("runningCount"),
        F.coalesce("stoppedCount", F.lit(0)).alias("stoppedCount"),
        F.coalesce("disabledCount", F.lit(0)).alias("disabledCount"),
        F.coalesce("invalidCount", F.lit(0)).alias("invalidCount"),
    )
    return counted.withColumn("observed", entity)


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Declared groups with their observed side; a group without lines has counts of 0."""
    counted = desired_groups(spark, folder).join(component_counts(spark, folder), "key", "left")
    return observed_groups(counted).withColumn("exists", F.lit(True))


# Users as resources: property maps of the first and of the second half of the month.

HALF = "2024-01-16 00:00:00"

PROPERTIES_SQL = f"""
{EVENTS_SQL},
pe AS (SELECT *, event_type || ':' || CAST(hour(ts) // 6 AS VARCHAR) AS prop,
              ts < TIMESTAMP '{HALF}' AS early FROM ev),
pl AS (SELECT user_id, early, prop, event_type, k FROM pe
       QUALIFY row_number() OVER (PARTITION BY user_id, early, prop ORDER BY ts DESC, event_id DESC) = 1),
pu AS (SELECT user_id, early, event_type FROM pe
       QUALIFY row_number() OVER (PARTITION BY user_id, early ORDER BY ts DESC, event_id DESC) = 1),
dp AS (SELECT user_id, prop, event_type, CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k // 25 AS VARCHAR) END AS val
       FROM pl WHERE early),
op AS (SELECT user_id, prop, event_type, k, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k // 25 AS VARCHAR) END AS val
       FROM pl WHERE NOT early),
du AS (SELECT user_id, event_type AS want FROM pu WHERE early),
ou AS (SELECT user_id, event_type AS have FROM pu WHERE NOT early),
pd AS (SELECT d.user_id, d.prop, d.val AS dval, o.user_id IS NULL AS absent, o.val AS oval
       FROM dp d JOIN ou ON ou.user_id = d.user_id
       LEFT JOIN op o ON o.user_id = d.user_id AND o.prop = d.prop
       WHERE o.user_id IS NULL OR (d.val IS NOT NULL AND d.val <> coalesce(o.val, ''))),
wl AS (SELECT user_id, prop, event_type, CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k // 25 AS VARCHAR) END AS val FROM pe
       QUALIFY row_number() OVER (PARTITION BY user_id, prop ORDER BY ts DESC, event_id DESC) = 1),
pr AS (SELECT user_id, string_agg('property:' || prop, ',' ORDER BY prop) AS r_props FROM pd GROUP BY 1)
"""


def user_properties(spark: SparkSession, folder: str, early: bool | None, null_every: int) -> DataFrame:
    """Per user the property map of one half of the month, or all of it, and the last event type in it.

    Rows are reduced to one per (user, property) before the map of a user is formed,
    so a map is as long as a user has property names, however many events there are.
    """
    half = F.col("ts") < F.lit(HALF).cast("timestamp_ntz")
    when = F.struct("ts", "event_id")
    value = F.when(F.col("k") % null_every != 0, F.floor(F.col("k") / 25).cast("string"))
    log = (
        events(spark, folder)
        .where(F.lit(True) if early is None else half if early else ~half)
        .withColumn(
            "prop",
            F.concat("event_type", F.lit(":"), F.floor(F.hour("ts") / 6).cast("string")),
        )
        .select("user_id", "prop", "ts", "event_id", "event_type", "k")
    )
    newest = latest_revision(log, ["user_id", "prop"], "ts", ["event_id"]).select(
        "user_id", "prop", "event_type", value.alias("val"), when.alias("at")
    )
    return newest.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("prop", "val"))).alias("props"),
        F.collect_list(F.struct(F.col("prop").alias("name"), F.col("val").alias("value"),
                                F.col("event_type").alias("description"))).alias("entries"),
        F.max_by("event_type", "at").alias("last_type"),
    )


PROCESSOR_WANT = {"view": "RUNNING", "click": "RUNNING", "purchase": "STOPPED", "error": "DISABLED", "signup": ""}
PROCESSOR_HAVE = {"view": "Running", "click": "RUNNING", "purchase": "Stopped", "error": "Disabled"}
SERVICE_WANT = {"view": "ENABLED", "click": "ENABLED", "purchase": "DISABLED", "signup": "DISABLED", "error": ""}
SERVICE_HAVE = {"view": "ENABLED", "click": "Enabled", "signup": "ENABLING", "purchase": "DISABLED", "error": "DISABLED"}


def sql_case(column: str, choices: dict) -> str:
    """``choices[column]`` as SQL."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items())
    return f"CASE {column} {arms} END"


def two_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both halves with ``user_id``, ``props``, ``entries`` and ``last_type``."""
    return (
        user_properties(spark, folder, early=True, null_every=10),
        user_properties(spark, folder, early=False, null_every=7),
    )
