"""Queries on histories: revisions, state changes, conditions, apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import EVENTS_SQL, events, pick, query, table, tag
from driftline.functions import compare as C
from driftline.operators import changes, conditions, metrics, planning
from driftline.session import scratch_path
from driftline.sources import sinks

LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


@query("latest_revision", f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}) = 1""")
def latest_revision(spark, folder):
    lines = table(spark, folder, "lineitem")
    return changes.latest_revision(
        lines, ["l_orderkey", "l_linenumber"], LINE_ORDER[0], LINE_ORDER[1:]
    )


def state_log(spark, folder):
    """Events as a log of desired states, for users in order of time."""
    return events(spark, folder).select("user_id", "ts", "event_id", "event_type")


def by_hour():
    return F.date_trunc("hour", F.col("ts"))


@query("desired_changed", """
SELECT user_id, event_id, event_type FROM
 (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS NULL OR p <> event_type""")
def desired_changed(spark, folder):
    log = state_log(spark, folder)
    kept = changes.desired_changed(log, ["user_id"], ["ts", "event_id"], ["event_type"])
    return kept.select("user_id", "event_id", "event_type")


CONDITIONS_SQL = f"""
{EVENTS_SQL},
cd AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'Synced' ELSE 'Ready' END AS type,
              CASE WHEN event_type = 'error' OR k % 3 = 0 THEN 'False' ELSE 'True' END AS status, event_type AS reason
       FROM ev)
"""


def condition_log(spark, folder):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "Synced").otherwise("Ready")
    bad = (F.col("event_type") == "error") | (F.col("k") % 3 == 0)
    return events(spark, folder).select(
        "user_id",
        "event_id",
        kind.alias("type"),
        F.when(bad, "False").otherwise("True").alias("status"),
        F.col("event_type").alias("reason"),
        F.col("ts").alias("lastTransitionTime"),
    )


@query("conditions_by_type", f"""
WITH {CONDITIONS_SQL}
SELECT user_id, event_id, type, status, reason FROM cd
QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY ts DESC, event_id DESC) = 1""")
def conditions_by_type(spark, folder):
    log = condition_log(spark, folder)
    return conditions.conditions_by_type(log, ["user_id"], ["event_id"]).drop("lastTransitionTime")


@query("condition_transitions", f"""
WITH {CONDITIONS_SQL}
SELECT user_id, event_id, type, status, p AS previous_status FROM
 (SELECT *, lag(status) OVER (PARTITION BY user_id, type ORDER BY ts, event_id) AS p FROM cd)
WHERE p IS NOT NULL AND p <> status""")
def condition_transitions(spark, folder):
    moved = changes.condition_transitions(
        condition_log(spark, folder), ["user_id", "type"], ["lastTransitionTime", "event_id"], "status"
    )
    return moved.select("user_id", "event_id", "type", "status", "previous_status")


KIND_NAMES = {0: "Processor", 1: "Connection", 2: "ControllerService", 3: "ProcessGroup", 4: "ParameterContext", 5: "RegistryFlow"}
AS_OF = "2024-02-01 00:00:00"


def resources(spark, folder):
    """Users as resources with their newest condition per type."""
    newest = conditions.conditions_by_type(condition_log(spark, folder), ["user_id"], ["event_id"])
    listed = newest.groupBy("user_id").agg(
        F.collect_list(F.struct("type", "status", "reason")).alias("conditions")
    )
    born = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("born"))
    user = F.col("user_id")
    return listed.join(born, "user_id").select(
        "user_id",
        pick(user % 6, KIND_NAMES).alias("kind"),
        F.struct(
            tag("user-", "user_id").alias("name"),
            F.when(
                user % 5 != 0,
                F.create_map(F.lit("example.org/external-name"), tag("id-", "user_id")),
            ).alias("annotations"),
            F.col("born").alias("creationTimestamp"),
        ).alias("metadata"),
        "conditions",
    )


@query("printer_columns", f"""
WITH {CONDITIONS_SQL},
l AS (SELECT user_id, type, status FROM cd
      QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY ts DESC, event_id DESC) = 1)
SELECT 'user-' || user_id AS name, max(status) FILTER (type = 'Ready') AS ready,
       max(status) FILTER (type = 'Synced') AS synced,
       CASE WHEN user_id % 5 <> 0 THEN 'id-' || user_id END AS external_name,
       CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(any_value(born))) / 1000000) AS BIGINT) AS age_seconds
FROM l JOIN (SELECT user_id, min(ts) AS born FROM events GROUP BY 1) USING (user_id) GROUP BY user_id""")
def printer_columns(spark, folder):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return conditions.printer_columns(resources(spark, folder), as_of)


@query("state_metrics", f"""
WITH {CONDITIONS_SQL},
l AS (SELECT user_id, type, status FROM cd
      QUALIFY row_number() OVER (PARTITION BY user_id, type ORDER BY ts DESC, event_id DESC) = 1)
SELECT {"CASE user_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in KIND_NAMES.items()) + " END"} AS kind,
       count(DISTINCT user_id) AS total, count(*) FILTER (type = 'Ready' AND status = 'True') AS ready,
       count(*) FILTER (type = 'Synced' AND status = 'True') AS synced
FROM l GROUP BY 1""")
def state_metrics(spark, folder):
    return metrics.state_metrics(resources(spark, folder))


REPORTED = {0: "Running", 1: "RUNNING", 2: "Stopped", 3: "Disabled", 4: "stopped"}
STATE_SQL = f"""
{EVENTS_SQL},
sx AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'STOPPED' WHEN 'error' THEN 'DISABLED' END AS want,
              CASE k % 6 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in REPORTED.items())} END AS have FROM ev)
"""


def states(spark, folder, compare):
    """A declared state against a reported one; both may be absent."""
    want = pick(F.col("event_type"), {"view": "RUNNING", "click": "STOPPED", "error": "DISABLED"})
    have = pick(F.col("k") % 6, REPORTED)
    return events(spark, folder).select("event_id", compare(want, have).alias("same"))


@query("state_fold_equal", f"""
WITH {STATE_SQL} SELECT event_id, lower(coalesce(want, '')) = lower(coalesce(have, '')) AS same FROM sx""")
def state_fold_equal(spark, folder):
    return states(spark, folder, C.state_fold_equal)


@query("state_exact_equal", f"""
WITH {STATE_SQL} SELECT event_id, coalesce(want, '') = coalesce(have, '') AS same FROM sx""")
def state_exact_equal(spark, folder):
    return states(spark, folder, C.state_exact_equal)


APPLY_SQL = f"""
{EVENTS_SQL},
cu AS (SELECT s_suppkey AS key, CAST(floor(abs(s_acctbal)) AS BIGINT) % 100 AS revision, s_name AS name FROM supplier),
w AS (SELECT user_id, event_id, k, event_type, cu.key IS NOT NULL AS known, cu.revision AS current,
             event_type = 'error' AS del, k = 0 AND event_type <> 'error' AS creates
      FROM ev LEFT JOIN cu ON cu.key = user_id),
f AS (SELECT *, (known AND k = current) OR (NOT known AND creates) AS fits FROM w),
r AS (SELECT *, fits AND row_number() OVER (PARTITION BY user_id, fits ORDER BY event_id) = 1 AS won FROM f)
"""


def revision_writes(spark, folder):
    """Suppliers as current records, events as writes that submit a revision."""
    current = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"),
        F.pmod(F.floor(F.abs("s_acctbal")), F.lit(100)).cast("bigint").alias("revision"),
        F.col("s_name").alias("name"),
    )
    batch = events(spark, folder).select(
        F.col("user_id").alias("key"),
        F.col("k").alias("revision"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.col("event_type").alias("name"),
    )
    return current, batch


@query("apply_checked", f"""
WITH {APPLY_SQL}
SELECT user_id AS key, event_id AS seq,
       CASE WHEN won THEN 'applied' WHEN NOT known AND NOT creates THEN 'not_found' ELSE 'conflict' END AS outcome,
       CASE WHEN won AND NOT del THEN CASE WHEN known THEN current + 1 ELSE 0 END END AS new_revision FROM r""")
def apply_checked(spark, folder):
    current, batch = revision_writes(spark, folder)
    writes = planning.classify_writes(current, batch, "key")
    return writes.select("key", "seq", "outcome", "new_revision")


@query("apply_next_snapshot", f"""
WITH {APPLY_SQL},
a AS (SELECT user_id AS key, CASE WHEN known THEN current + 1 ELSE 0 END AS revision, event_type AS name, del FROM r WHERE won)
SELECT key, revision, name FROM a WHERE NOT del
UNION ALL SELECT key, revision, name FROM cu WHERE key NOT IN (SELECT key FROM a)""")
def apply_next_snapshot(spark, folder):
    current, batch = revision_writes(spark, folder)
    return planning.apply_checked(current, batch, "key")[2]


@query("sink_status", """
SELECT user_id, event_id, event_type AS state FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def sink_status(spark, folder):
    """Two observation batches, merged into two snapshots; the later one is read."""
    path = scratch_path(spark, "status")
    seen = events(spark, folder).select("user_id", "ts", "event_id", F.col("event_type").alias("state"))
    cut = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    keys = ["user_id"], "ts", ["event_id"]
    sinks.write_status(sinks.merge_status(None, seen.where(cut), *keys), path, "2024-01-15")
    prior = sinks.read_status(spark, path, "2024-01-15")
    sinks.write_status(sinks.merge_status(prior, seen.where(~cut), *keys), path, "2024-01-31")
    return sinks.read_status(spark, path, "2024-01-31").drop("ts")
