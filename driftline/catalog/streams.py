"""Queries that run a stream over the event files to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import GROUPS_SQL, events, joined, pick, query, sql_case, table, tag
from driftline.catalog import changes as H
from driftline.catalog.groups import component_counts, desired_groups, observed_groups
from driftline.session import scratch_path
from driftline.streaming import streams

ALL = {"availableNow": True}


#: Times at which the events are cut into what arrives one after the other.
CUTS = ("2024-01-16 00:00:00",)


def finish(query):
    query.awaitTermination()


def in_turns(spark, folder, start):
    """Let the events arrive in turns, each a run of the stream that ``start`` makes from its source.

    The stream stops in between and goes on from its checkpoint, so state is carried over.
    """
    feed = scratch_path(spark, "feed")
    log = events(spark, folder)
    schema = log.schema
    cuts = [F.lit(c).cast("timestamp_ntz") for c in CUTS]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        after = F.lit(True) if low is None else F.col("ts") >= low
        before = F.lit(True) if high is None else F.col("ts") < high
        log.where(after & before).write.mode("append").parquet(feed)
        start(spark.readStream.schema(schema).parquet(feed)).awaitTermination()
    return spark.read.schema(schema).parquet(feed)


@query("stream_desired_changed", """
SELECT user_id, event_id, event_type FROM
 (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NULL OR p <> event_type""")
def stream_desired_changed(spark, folder):
    out = scratch_path(spark, "changed")
    in_turns(spark, folder, lambda source: streams.stream_desired_changed(
        source.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"], out, ALL
    ))
    return streams.read_rows(spark, out).select("user_id", "event_id", "event_type")


@query("stream_latest_status", """
SELECT user_id, event_id, event_type AS state FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_status(spark, folder):
    out = scratch_path(spark, "latest")
    keys = ["user_id"], "ts", ["event_id"]
    seen = lambda source: source.select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    feed = in_turns(spark, folder, lambda source: streams.stream_latest_status(seen(source), *keys, out, ALL))
    return streams.read_status_rows(seen(feed), f"{out}", *keys).drop("ts")


@query("stream_state_metrics", f"""
WITH cuts(tick, upto) AS (VALUES (0, TIMESTAMP '{CUTS[0]}'), (1, TIMESTAMP '9999-01-01 00:00:00')),
l AS (SELECT tick, user_id, event_type FROM events JOIN cuts ON ts < upto
      QUALIFY row_number() OVER (PARTITION BY tick, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT CAST(tick AS INTEGER) AS tick, {sql_case("user_id % 6", H.KIND_NAMES)} AS kind, count(*) AS total,
       count(*) FILTER (event_type <> 'error') AS ready, count(*) FILTER (user_id % 2 = 0) AS synced FROM l GROUP BY ALL""")
def stream_state_metrics(spark, folder):
    """All users as resources, counted as they are at each tick."""
    out = scratch_path(spark, "metrics")

    def condition(name, good):
        return F.struct(F.lit(name).alias("type"), F.when(good, "True").otherwise("False").alias("status"))

    def resources(source):
        return source.select(
            "user_id", "ts", "event_id", pick(F.col("user_id") % 6, H.KIND_NAMES).alias("kind"),
            F.array(condition("Ready", F.col("event_type") != "error"), condition("Synced", F.col("user_id") % 2 == 0)).alias("conditions"),
        )

    in_turns(spark, folder, lambda source: streams.stream_state_metrics(resources(source), ["user_id"], "ts", ["event_id"], out, ALL))
    return streams.read_rows(spark, out).select(F.col("epoch").cast("int").alias("tick"), "kind", "total", "ready", "synced")


@query("stream_observe", f"""
WITH {GROUPS_SQL}
SELECT key, CASE WHEN up_to_date THEN 'NOOP' ELSE 'UPDATE' END AS action, reasons FROM gr WHERE present""")
def stream_observe(spark, folder):
    """Observed groups arrive as files, some in an older state too, and are checked against the declared ones."""
    feed, out = scratch_path(spark, "observed"), scratch_path(spark, "checked")
    wanted = desired_groups(spark, folder)
    seen = observed_groups(wanted.join(component_counts(spark, folder), "key")).select("key", "observed")
    older = seen.where("key % 3 = 0").withColumn(
        "observed", F.col("observed").withField("revision.version", F.lit(-1).cast("bigint")).withField("runningCount", F.lit(99))
    )
    seen.unionByName(older).write.parquet(feed)
    source = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    finish(streams.stream_observe(source, wanted, "ProcessGroup", "key", out, ALL))
    return streams.read_rows(spark, out).select(
        "key", "action", joined(F.col("reasons")).alias("reasons")
    )


@query("stream_check_all", f"""
WITH {GROUPS_SQL}
SELECT key, CASE WHEN NOT present THEN 'CREATE' WHEN up_to_date THEN 'NOOP' ELSE 'UPDATE' END AS action,
       CASE WHEN present THEN reasons ELSE '' END AS reasons FROM gr""")
def stream_check_all(spark, folder):
    """At a tick every declared group is checked; those without an observed side are to be created."""
    out = scratch_path(spark, "all-checked")
    path = scratch_path(spark, "ticks")
    table(spark, folder, "region").select("r_regionkey").write.parquet(path)
    ticks = spark.readStream.schema("r_regionkey int").parquet(path)
    wanted = desired_groups(spark, folder)
    seen = observed_groups(wanted.join(component_counts(spark, folder), "key")).select("key", "observed")
    finish(streams.stream_check_all(ticks, lambda: wanted, lambda: seen, "ProcessGroup", "key", out, ALL))
    return streams.read_rows(spark, out).select("key", "action", joined(F.col("reasons")).alias("reasons"))


@query("stream_changelog", """
SELECT ts, 'Processor' AS kind, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action,
       CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS steps, 'v1' AS version,
       CASE event_type WHEN 'signup' THEN 'event ' || event_id END AS error
FROM events WHERE event_type <> 'view'""")
def stream_changelog(spark, folder):
    """Events as planned actions; views have nothing to do."""
    out = scratch_path(spark, "stream-changelog")
    kind = F.col("event_type")

    def plan(source):
        return source.select(
            "ts", "user_id", pick(kind, {"error": "DELETE", "view": "NOOP"}, "UPDATE").alias("action"),
            F.array(pick(kind, {"error": "DELETE"}, "PUT")).alias("steps"),
            F.when(kind == "signup", tag("event ", "event_id")).alias("error"),
        )

    in_turns(spark, folder, lambda source: streams.stream_changelog(plan(source), "Processor", "user_id", F.col("ts"), "v1", out, ALL))
    return spark.read.parquet(f"{out}/rows").withColumn("steps", joined(F.col("steps")))
