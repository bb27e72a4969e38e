"""Queries on histories: states in force, episodes of drift, overlapping intervals, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import query, table
from driftline.catalog.streams import ALL, finish
from driftline.operators import asof, episodes, overlaps, ranks, summaries
from driftline.sources import sinks, snapshots
from driftline.session import scratch_path
from driftline.streaming import streams

DECLARING = ("purchase", "signup")


@query("state_in_force", """
WITH d AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup')),
o AS (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'signup'))
SELECT o.event_id, d.event_id AS declared_id, d.event_type AS declared_state, o.event_type <> 'view' AND d.event_type = 'signup' AS drifts
FROM o ASOF LEFT JOIN d ON o.user_id = d.user_id AND o.ts >= d.ts""")
def state_in_force(spark, folder):
    """Purchases and signups declare a user's state; each other event meets the one in force at its time."""
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    states = F.col("event_type").isin(*DECLARING)
    met = asof.in_force(log.where(~states), log.where(states), ["user_id"], "ts", "ts", ["event_id"])
    drifts = (F.col("event_type") != "view") & (F.col("declared.event_type") == "signup")
    return met.select("event_id", F.col("declared.event_id").alias("declared_id"), F.col("declared.event_type").alias("declared_state"), drifts.alias("drifts"))


GAP = "6 hours"

EPISODES_SQL = """
d AS (SELECT user_id, ts, event_type AS reason FROM events WHERE event_type IN ('error', 'purchase')),
n AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOURS, true) AS fresh FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM n),
e AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", epoch_us(max(ts)) - epoch_us(min(ts)) AS us, count(*) AS observations,
      string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM i GROUP BY user_id, island)
"""


def drifting(events):
    """Errors and purchases as observations that drifted."""
    return events.select("user_id", "ts", F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")).alias("reason"))


def told(found):
    return found.select("user_id", "start", "end", F.round(F.col("length") * 1_000_000).cast("bigint").alias("us"), "observations", F.array_join("reasons", ",").alias("reasons"))


@query("drift_episodes", f"WITH {EPISODES_SQL} SELECT * FROM e")
def drift_episodes(spark, folder):
    log = drifting(table(spark, folder, "events")).where("reason IS NOT NULL")
    return told(episodes.drift_episodes(log, ["user_id"], "ts", "reason", GAP))


#: Times at which the events of the stream are cut, and how far those of one user in four come behind.
TURNS = ("2024-01-11", "2024-01-21", "2024-02-01")
LATE_HOURS = 20


@query("stream_drift_episodes", f"WITH {EPISODES_SQL} SELECT * FROM e")
def stream_drift_episodes(spark, folder):
    """The same from a stream in which a quarter of the users' events come hours late, within what the watermark allows.

    Two last observations without drift, long after the others, let the open episodes end.
    """
    feed, out = scratch_path(spark, "late-events"), scratch_path(spark, "episodes")
    log = drifting(table(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    comes = F.when(F.col("user_id") % 4 == 0, F.col("ts") + F.expr(f"INTERVAL {LATE_HOURS} HOURS")).otherwise(F.col("ts"))
    turn = sum((F.when(comes >= F.lit(t).cast("timestamp"), 1).otherwise(0) for t in TURNS), F.lit(0))
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit("2024-06-01").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("reason"))
    for i in range(len(TURNS) + 3):
        rows = log.where(turn == i) if i <= len(TURNS) else end
        rows.write.mode("append").parquet(feed)
        source = spark.readStream.schema(log.schema).parquet(feed)
        found = episodes.session_episodes(source, ["user_id"], "ts", "reason", GAP, "2 days")
        finish(streams.stream_rows(found, out, ALL))
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    return told(rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


@query("overlapping_usage", """
WITH v AS (SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate AS since, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS until FROM lineitem WHERE l_linenumber = 1),
u AS (SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate AS since, l_shipdate + to_days(CAST(1 + l_orderkey % 400 AS INTEGER)) AS until FROM lineitem WHERE l_linenumber > 1)
SELECT v.l_partkey AS part, v.l_orderkey AS config, u.l_orderkey AS used_by, u.l_linenumber AS line
FROM v JOIN u ON v.l_partkey = u.l_partkey AND v.since < u.until AND u.since < v.until""")
def overlapping_usage(spark, folder):
    """First lines as configs of a part, valid for as many days as they have pieces; other lines use it for up to 400 days."""
    lines = table(spark, folder, "lineitem")

    def spans(rows, days):
        length = F.make_dt_interval(days.cast("int"))
        return rows.select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("since"), (F.col("l_shipdate") + length).alias("until"))

    valid = spans(lines.where("l_linenumber = 1"), F.col("l_quantity"))
    used = spans(lines.where("l_linenumber > 1"), 1 + F.col("l_orderkey") % 400)
    pairs = overlaps.overlaps(valid, used, ["l_partkey"], "since", "until", out=("config", "usage"))
    return pairs.select(
        F.col("l_partkey").alias("part"), F.col("config.l_orderkey").alias("config"), F.col("usage.l_orderkey").alias("used_by"), F.col("usage.l_linenumber").alias("line")
    )


@query("global_ranks", """
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem""")
def global_ranks(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.global_ranks(lines, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_extendedprice")


@query("keyed_ranks", """
SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem""")
def keyed_ranks(spark, folder):
    """Three keys, each with a share of all lines."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_shipdate")
    return ranks.keyed_ranks(lines, ["l_returnflag"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_shipdate")


@query("stream_live_status", """
SELECT user_id, event_id, event_type AS state FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def stream_live_status(spark, folder):
    """An error ends a user's status; the first half of the month comes after the second and brings nothing back."""
    feed, out = scratch_path(spark, "late-feed"), scratch_path(spark, "live")
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    keys = ["user_id"], "ts", ["event_id"]
    for part in (log.where(~early), log.where(early)):
        part.write.mode("append").parquet(feed)
        source = spark.readStream.schema(log.schema).parquet(feed)
        finish(streams.stream_latest_status(source, *keys, out, ALL, deleted="state = 'error'"))
    return streams.read_status_rows(log, out, *keys, deleted="state = 'error'").drop("ts")


@query("snapshot_difference", """
WITH old AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem),
new AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 1000 <> 8
 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey % 1000 = 9),
c AS (SELECT *, 1 AS change FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old) UNION ALL SELECT *, -1 FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new))
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, sum(change)::BIGINT AS change FROM c GROUP BY ALL""")
def snapshot_difference(spark, folder):
    """Lines of a day and of the next: some orders have changed, some have gone, some lines are there twice."""
    old = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    turn = F.col("l_orderkey") % 1000
    changed = old.where(turn != 8).withColumn("l_quantity", F.when(turn == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    new = changed.unionByName(old.where(turn == 9))
    paths = scratch_path(spark, "day"), scratch_path(spark, "day")
    for df, path in zip((old, new), paths, strict=True):
        snapshots.write_snapshot(df, path, ["l_orderkey"], 16)
    return snapshots.snapshot_difference(spark, *paths, old.schema, 16)


@query("status_upserts", """
SELECT user_id, event_id, event_type AS state FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def status_upserts(spark, folder):
    """Events as status reports in three batches, the second of which comes twice."""
    log = table(spark, folder, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    status = sinks.StatusTable(spark, scratch_path(spark, "status-table"), log.schema, ["user_id"], "ts", ["event_id"], buckets=16)
    for batch, part in enumerate((0, 1, 1, 2)):
        status.upsert(log.where(F.col("event_id") % 3 == part), batch if batch < 2 else batch - 1)
    return status.rows().drop("ts")


@query("summary_cube", """
SELECT concat_ws(',', CASE WHEN grouping(event_type) = 0 THEN 'event_type' END, CASE WHEN grouping(part) = 0 THEN 'part' END) AS grouped,
       event_type, part, count(*) AS n, count(DISTINCT user_id) AS "distinct"
FROM (SELECT *, user_id % 3 AS part FROM events) GROUP BY CUBE (event_type, part)""")
def summary_cube(spark, folder):
    """Events summed up by day, and the days united along all sets of event type and part; so few users are counted exactly."""
    path = scratch_path(spark, "summaries")
    log = table(spark, folder, "events").withColumn("part", F.col("user_id") % 3)
    for day, (low, high) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01"))):
        rows = log.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")))
        summaries.add_day(rows, path, str(day), ["event_type", "part"], "user_id", "value")
    return summaries.united(summaries.read_days(spark, path), ["event_type", "part"], [0.5]).drop("quantiles")
