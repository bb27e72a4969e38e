"""Group queries: orders are groups, their lines the components."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import (
    GROUPS_SQL, component_counts, desired_groups, groups, joined, observed_groups, pick, query, table, tag,
)
from driftline.functions import compare as C
from driftline.functions import scalars as X
from driftline.operators import conditions, drift as D, extensions, metrics, observe as O, planning
from driftline.operators.payloads import build_payload, update_payload
from driftline.plans.reconcile import reconcile
from driftline.session import scratch_path
from driftline.sources import sinks

STEPS_SQL = """
st AS (SELECT *,
  CASE action WHEN 'CREATE' THEN 'POST'
    WHEN 'UPDATE' THEN concat_ws(',', 'PUT',
        CASE WHEN desired_state = 'RUNNING' AND stopped > 0 THEN 'SCHEDULE_RUNNING' END,
        CASE WHEN desired_state = 'STOPPED' AND running > 0 THEN 'SCHEDULE_STOPPED' END)
    WHEN 'DELETE' THEN CASE WHEN running > 0 THEN 'SCHEDULE_STOPPED,REFRESH,DELETE' ELSE 'DELETE' END
    ELSE '' END AS steps FROM pa)
"""
PLAN_SQL = f"""
{GROUPS_SQL},
pa AS (SELECT *, CASE WHEN NOT present THEN 'CREATE' WHEN NOT up_to_date THEN 'UPDATE' ELSE 'NOOP' END AS action
       FROM gr),
{STEPS_SQL}
"""
DELETE_SQL = f"""
{GROUPS_SQL},
pa AS (SELECT *, CASE WHEN desired_state = 'DISABLED' THEN CASE WHEN present THEN 'DELETE' ELSE 'NOOP' END
                      WHEN NOT present THEN 'CREATE' WHEN NOT up_to_date THEN 'UPDATE' ELSE 'NOOP' END AS action
       FROM gr),
{STEPS_SQL}
"""


def planned(spark, folder, counts=None):
    """The reconcile of all groups; a group without lines does not exist yet."""
    counts = component_counts(spark, folder) if counts is None else counts
    seen = desired_groups(spark, folder).join(counts, "key", "left")
    found = observed_groups(seen).withColumn("exists", F.col("runningCount").isNotNull())
    sides = found.withColumn("observed", F.when(F.col("exists"), F.col("observed")))
    return planning.plan_steps(planning.plan_action(D.drift(sides, "ProcessGroup")), "ProcessGroup")


def deleting(spark, folder):
    """As ``planned``, with deletion requested for the groups that want DISABLED."""
    plan = planned(spark, folder).drop("action", "allowed", "steps")
    marked = plan.withColumn("deletion_requested", F.col("desired.desiredState") == "DISABLED")
    return planning.plan_steps(planning.plan_action(marked), "ProcessGroup")


@query("reconcile_groups", f"""
WITH {PLAN_SQL}
SELECT key, desired_state, CAST(CASE WHEN present THEN running END AS INTEGER) AS running,
       CAST(CASE WHEN present THEN stopped END AS INTEGER) AS stopped,
       CASE WHEN present THEN reasons ELSE '' END AS reasons, action, steps FROM st""")
def reconcile_groups(spark, folder):
    """The flagship: declared groups, their counted components, drift, action, steps."""
    return planned(spark, folder).select(
        "key",
        F.col("desired.desiredState").alias("desired_state"),
        F.col("observed.runningCount").alias("running"),
        F.col("observed.stoppedCount").alias("stopped"),
        joined(F.col("reasons")).alias("reasons"),
        "action",
        joined(F.col("steps")).alias("steps"),
    )


@query("group_counts", """
SELECT l_orderkey AS key, CAST(count(*) FILTER (l_linestatus = 'F') AS INTEGER) AS running,
       CAST(count(*) FILTER (l_linestatus = 'O') AS INTEGER) AS stopped,
       CAST(0 AS INTEGER) AS disabled, CAST(0 AS INTEGER) AS invalid
FROM lineitem GROUP BY 1""")
def group_counts(spark, folder):
    return component_counts(spark, folder).select(
        "key",
        *[F.col(f"{n}Count").alias(n) for n in ("running", "stopped", "disabled", "invalid")],
    )


@query("default_state", """
SELECT o_orderkey AS key,
       CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' ELSE 'STOPPED' END AS group_state,
       CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' ELSE 'DISABLED' END AS service_state
FROM orders""")
def default_state(spark, folder):
    state = pick(F.col("o_orderstatus"), {"F": "RUNNING", "O": ""})
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"),
        X.default_state(state, "ProcessGroup").alias("group_state"),
        X.default_state(state, "ControllerService").alias("service_state"),
    )


@query("build_group", """
SELECT o_orderkey AS key, 'order ' || o_orderkey AS name,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS comments,
       CASE WHEN o_orderstatus = 'F' THEN 'ctx-' || o_custkey END AS context_id,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x, CAST(0 AS BIGINT) AS revision
FROM orders""")
def build_group(spark, folder):
    status = F.col("o_orderstatus")
    placed = desired_groups(spark, folder).withColumn(
        "desired",
        F.col("desired")
        .withField(
            "parameterContextId",
            F.when(status == "F", tag("ctx-", "o_custkey")).otherwise(""),
        )
        .withField(
            "position",
            F.when(status != "P", F.struct(F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"))),
        ),
    )
    return build_payload(placed, "ProcessGroup").select(
        "key",
        "payload.component.name",
        "payload.component.comments",
        F.col("payload.component.parameterContext.id").alias("context_id"),
        F.col("payload.component.position.x").alias("x"),
        F.col("payload.revision.version").alias("revision"),
    )


@query("update_payload", """
SELECT o_orderkey AS key, 'g' || o_orderkey AS id, 'g' || o_orderkey AS component_id,
       'order ' || o_orderkey AS name, CAST(month(o_orderdate) AS BIGINT) AS revision
FROM orders""")
def update_payload_query(spark, folder):
    built = build_payload(desired_groups(spark, folder), "ProcessGroup")
    named = built.withColumn("external_name", tag("g", "key")).withColumn(
        "revision", F.month("o_orderdate").cast("bigint")
    )
    return update_payload(named, "external_name", "revision").select(
        "key",
        "payload.id",
        F.col("payload.component.id").alias("component_id"),
        "payload.component.name",
        F.col("payload.revision.version").alias("revision"),
    )


@query("drift_group", f"WITH {GROUPS_SQL} SELECT key, reasons, up_to_date FROM gr")
def drift_group(spark, folder):
    return D.drift(groups(spark, folder), "ProcessGroup").select(
        "key", joined(F.col("reasons")).alias("reasons"), "up_to_date"
    )


@query("count_vs_state", f"WITH {GROUPS_SQL} SELECT key, concat_ws(',', r_stopped, r_running) AS reasons FROM gd")
def count_vs_state(spark, folder):
    rows = groups(spark, folder)
    o = F.col("observed")
    found = C.count_vs_state(F.col("desired.desiredState"), o["runningCount"], o["stoppedCount"])
    return rows.select("key", joined(found).alias("reasons"))


@query("plan_action", f"""
WITH {PLAN_SQL}
SELECT key, CASE WHEN action = 'UPDATE' AND key % 3 = 0 THEN 'NOOP' ELSE action END AS action,
       NOT (action = 'UPDATE' AND key % 3 = 0) AS allowed FROM st""")
def plan_action(spark, folder):
    plan = planned(spark, folder).drop("action", "allowed", "steps")
    policies = F.when(F.col("key") % 3 == 0, F.array(F.lit("Observe"), F.lit("Create"))).otherwise(
        F.array(F.lit("*"))
    )
    return planning.plan_action(plan.withColumn("managementPolicies", policies)).select(
        "key", "action", "allowed"
    )


@query("steps_group", f"WITH {DELETE_SQL} SELECT key, action, steps FROM st")
def steps_group(spark, folder):
    return deleting(spark, folder).select("key", "action", joined(F.col("steps")).alias("steps"))


@query("step_order", f"""
WITH {DELETE_SQL},
parts AS (SELECT key, string_split(steps, ',') AS s FROM st WHERE steps <> '')
SELECT key, CAST(i - 1 AS INTEGER) AS position, s[i] AS step
FROM (SELECT key, s, unnest(range(1, len(s) + 1)) AS i FROM parts)""")
def step_order(spark, folder):
    return planning.step_order(deleting(spark, folder), ["key"])


@query("set_condition", f"""
WITH {DELETE_SQL}
SELECT key, CASE WHEN present OR action = 'CREATE' THEN 'Ready' END AS type,
       CASE WHEN action = 'CREATE' OR (present AND action = 'DELETE') THEN 'False' WHEN present THEN 'True' END AS status,
       CASE WHEN action = 'CREATE' THEN 'Creating' WHEN present AND action = 'DELETE' THEN 'Deleting' WHEN present THEN 'Available' END AS reason
FROM st""")
def set_condition(spark, folder):
    return conditions.set_condition(deleting(spark, folder)).select("key", "condition.*")


@query("drift_summary", f"""
WITH {PLAN_SQL},
r AS (SELECT key, CASE WHEN NOT present THEN 'missing' WHEN up_to_date THEN 'up_to_date' ELSE 'drifted' END AS outcome,
             unnest(CASE WHEN present AND reasons <> '' THEN string_split(reasons, ',') ELSE ['-'] END) AS reason
      FROM st)
SELECT kind, outcome, reason, count(*) AS n
FROM (SELECT 'ProcessGroup' AS kind, outcome, reason FROM r) GROUP BY ROLLUP (kind, outcome, reason)""")
def drift_summary(spark, folder):
    rows = planned(spark, folder).withColumn("kind", F.lit("ProcessGroup")).withColumn(
        "error", F.lit(None).cast("string")
    )
    return D.drift_summary(rows)


@query("observe_after_apply", f"""
WITH {GROUPS_SQL}
SELECT key, '' AS reasons, true AS up_to_date FROM gr""")
def observe_after_apply(spark, folder):
    """After one round of updates every group is as declared."""
    plan = planning.plan_steps(
        planning.plan_action(D.drift(groups(spark, folder), "ProcessGroup")), "ProcessGroup"
    )
    return planning.converge(plan, "ProcessGroup").select(
        "key", joined(F.col("reasons")).alias("reasons"), "up_to_date"
    )


OBSERVE_SQL = """
c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS key, o_orderpriority <> '4-NOT SPECIFIED' AS named, n,
             CASE WHEN n >= 7 THEN 500 WHEN n = 6 THEN 404 END AS status,
             CASE WHEN n >= 5 THEN 'get group ' || o_orderkey || ' failed' END AS failure
      FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
f AS (SELECT *, failure IS NOT NULL AND (coalesce(status, 0) = 404 OR contains(failure, '404')) AS lost FROM o)
"""


def observed_lookups(spark, folder):
    """Result of looking up every group that has lines: a record or a failure."""
    n = F.col("n")
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("key").cast("string").alias("external_name"),
            F.struct("n").alias("observed"),
            F.when(n >= 7, 500).when(n == 6, 404).alias("http_status"),
            F.when(n >= 5, F.format_string("get group %d failed", "key")).alias("error_text"),
        )
    )


def named_groups(spark, folder):
    named = F.when(F.col("priority") == "4-NOT SPECIFIED", "").otherwise(F.col("key").cast("string"))
    return desired_groups(spark, folder).withColumn("external_name", named)


@query("observe", f"""
WITH {OBSERVE_SQL}
SELECT key, named AND n IS NOT NULL AND failure IS NULL AS exists,
       CASE WHEN named AND failure IS NOT NULL AND NOT lost THEN failure END AS error,
       CASE WHEN named AND failure IS NULL THEN n END AS n FROM f""")
def observe(spark, folder):
    return O.observe(
        named_groups(spark, folder), observed_lookups(spark, folder), "external_name", "key", unique=True
    ).select("key", "exists", "error", "observed.n")


@query("missing", """
SELECT o_orderkey AS key, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def missing(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    return O.missing(desired_groups(spark, folder), lines, "key").select("key", "o_custkey")


@query("present", """
SELECT o_orderkey AS key, o_custkey FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def present(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"))
    return O.present(desired_groups(spark, folder), lines, "key").select("key", "o_custkey")


def changelog(spark, folder):
    return sinks.changelog_rows(
        deleting(spark, folder), "ProcessGroup", "key", F.col("o_orderdate"), "v1"
    )


@query("sink_changelog", f"""
WITH {DELETE_SQL}
SELECT o_orderdate AS ts, 'ProcessGroup' AS kind, CAST(key AS VARCHAR) AS key, action, steps, 'v1' AS version,
       CAST(NULL AS VARCHAR) AS error
FROM st WHERE action <> 'NOOP'""")
def sink_changelog(spark, folder):
    path = scratch_path(spark, "changelog")
    sinks.write_changelog(changelog(spark, folder), path)
    return spark.read.parquet(path).withColumn("steps", joined(F.col("steps")))


@query("reconcile_metrics", f"""
WITH {DELETE_SQL}
SELECT 'ProcessGroup' AS kind, action, count(*) AS n, CAST(0 AS BIGINT) AS failed
FROM st WHERE action <> 'NOOP' GROUP BY action""")
def reconcile_metrics(spark, folder):
    return aged_metrics(spark, folder).drop("age_p50", "age_p95")


@query("reconcile_ages", f"""
WITH {DELETE_SQL},
ag AS (SELECT action, CAST(floor((epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(o_orderdate)) / 1000000) AS BIGINT) AS age,
              row_number() OVER (PARTITION BY action ORDER BY o_orderdate DESC) AS i, count(*) OVER (PARTITION BY action) AS n
       FROM st WHERE action <> 'NOOP')
SELECT 'ProcessGroup' AS kind, action, any_value(n) AS n, CAST(0 AS BIGINT) AS failed,
       max(age) FILTER (i = ceil(n * 0.5)) AS age_p50, max(age) FILTER (i = ceil(n * 0.95)) AS age_p95
FROM ag GROUP BY action""")
def aged_metrics(spark, folder):
    """Actions with the exact percentiles of their age."""
    as_of = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    aged = changelog(spark, folder).withColumn(
        "age_seconds", F.timestamp_diff("SECOND", F.col("ts"), as_of)
    )
    return metrics.reconcile_metrics(aged)


@query("state_conflicts", """
SELECT l_orderkey AS group_id, l_linenumber, l_partkey,
       CASE l_linestatus WHEN 'F' THEN 'RUNNING' ELSE 'STOPPED' END AS desired_state,
       CASE o_orderstatus WHEN 'F' THEN 'RUNNING' ELSE 'STOPPED' END AS group_state
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE (o_orderstatus = 'F' AND l_linestatus = 'O') OR (o_orderstatus = 'O' AND l_linestatus = 'F')""")
def state_conflicts(spark, folder):
    parents = desired_groups(spark, folder).select(
        F.col("key").alias("group_id"), F.col("desired.desiredState").alias("desired_state")
    )
    children = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), "l_linenumber", "l_partkey",
        pick(F.col("l_linestatus"), {"F": "RUNNING", "O": "STOPPED"}).alias("desired_state"),
    )
    return extensions.state_conflicts(parents, children)


ACTION_SQL = """CASE WHEN NOT named OR n IS NULL OR lost THEN 'CREATE' WHEN failure IS NOT NULL THEN 'ERROR' ELSE 'UPDATE' END AS action"""


def named_plan(spark, folder):
    """The whole chain with failed lookups: errors neither create nor update."""
    lookups = observed_lookups(spark, folder).withColumn(
        "observed",
        F.struct(
            F.col("external_name").alias("id"),
            F.struct(F.lit(0).cast("bigint").alias("version")).alias("revision"),
            F.struct(
                F.concat(F.lit("order "), "external_name").alias("name"), F.lit("").alias("comments")
            ).alias("component"),
            F.col("observed.n").cast("int").alias("runningCount"),
            F.lit(0).alias("stoppedCount"),
        ),
    )
    return reconcile(named_groups(spark, folder), lookups, "ProcessGroup", "external_name", "key", unique=True)


@query("reconcile_named_groups", f"""
WITH {OBSERVE_SQL}
SELECT key, {ACTION_SQL},
       CASE WHEN NOT named OR n IS NULL OR lost THEN 'POST' WHEN failure IS NOT NULL THEN ''
            WHEN o_orderstatus = 'O' THEN 'PUT,SCHEDULE_STOPPED' ELSE 'PUT' END AS steps
FROM f JOIN orders ON o_orderkey = key""")
def reconcile_named_groups(spark, folder):
    return named_plan(spark, folder).select("key", "action", joined(F.col("steps")).alias("steps"))


@query("reconcile_failures", f"""
WITH {OBSERVE_SQL}, a AS (SELECT {ACTION_SQL} FROM f)
SELECT 'ProcessGroup' AS kind, action, count(*) AS n, count(*) FILTER (action = 'ERROR') AS failed FROM a GROUP BY action""")
def reconcile_failures(spark, folder):
    """Actions and failures where some lookups failed."""
    rows = sinks.changelog_rows(named_plan(spark, folder), "ProcessGroup", "key", F.col("o_orderdate"), "v1")
    return metrics.reconcile_metrics(rows.withColumn("age_seconds", F.lit(None).cast("bigint"))).drop("age_p50", "age_p95")


@query("changelog_errors", f"""
WITH {OBSERVE_SQL}
SELECT CAST(key AS VARCHAR) AS key, 'ERROR' AS action, failure AS error FROM f WHERE named AND failure IS NOT NULL AND NOT lost""")
def changelog_errors(spark, folder):
    """The change log's rows that say why nothing was done."""
    rows = sinks.changelog_rows(named_plan(spark, folder), "ProcessGroup", "key", F.col("o_orderdate"), "v1")
    return rows.where("error IS NOT NULL").select("key", "action", "error")


@query("drift_outcomes", f"""
WITH {OBSERVE_SQL},
a AS (SELECT {ACTION_SQL}, o_orderstatus FROM f JOIN orders ON o_orderkey = key),
r AS (SELECT CASE action WHEN 'CREATE' THEN 'missing' WHEN 'ERROR' THEN 'error' ELSE 'drifted' END AS outcome,
             unnest(CASE WHEN action <> 'UPDATE' THEN ['-'] WHEN o_orderstatus = 'O' THEN ['comments', 'running_count'] ELSE ['comments'] END) AS reason FROM a)
SELECT kind, outcome, reason, count(*) AS n FROM (SELECT 'ProcessGroup' AS kind, outcome, reason FROM r) GROUP BY ROLLUP (kind, outcome, reason)""")
def drift_outcomes(spark, folder):
    """The summary where some lookups failed."""
    return D.drift_summary(named_plan(spark, folder).withColumn("kind", F.lit("ProcessGroup")))


@query("observe_repeated", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey || '}' DESC) = 1)
SELECT o_orderkey AS key, l_orderkey IS NOT NULL AS exists, CAST(l_linenumber AS BIGINT) AS revision, l_partkey AS n
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def observe_repeated(spark, folder):
    """Every line as an observation of its order, its number the revision: the newest counts."""
    seen = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        F.struct(F.struct(F.col("l_linenumber").cast("bigint").alias("version")).alias("revision"), F.col("l_partkey").alias("n")).alias("observed"),
    )
    return O.observe(desired_groups(spark, folder), seen, "key").select(
        "key", "exists", F.col("observed.revision.version").alias("revision"), "observed.n"
    )


FIRST_LINES = "l_linenumber <= 3"


@query("writes_outstanding", f"""
WITH e AS (WITH {GROUPS_SQL.replace("FROM lineitem GROUP", f"FROM lineitem WHERE {FIRST_LINES} GROUP")}
           SELECT key, present, up_to_date, CASE WHEN present THEN reasons ELSE '' END AS reasons FROM gr),
l AS (WITH {GROUPS_SQL} SELECT key, present, up_to_date, CASE WHEN present THEN reasons ELSE '' END AS reasons FROM gr)
SELECT key, CASE WHEN e.present THEN 'UPDATE' ELSE 'CREATE' END AS action, e.reasons AS "before", l.reasons AS "after",
       CASE WHEN NOT l.present THEN 'missing' WHEN l.up_to_date THEN 'done' ELSE 'drifting' END AS outcome
FROM e JOIN l USING (key) WHERE NOT (e.present AND e.up_to_date)""")
def writes_outstanding(spark, folder):
    """Planned when three lines of each order were there, and looked at again when all were."""
    early = component_counts(spark, folder, FIRST_LINES)
    later = observed_groups(desired_groups(spark, folder).join(component_counts(spark, folder), "key")).select("key", "observed")
    found = planning.outstanding_writes(planned(spark, folder, early), later, "ProcessGroup", "key")
    return found.withColumns({c: joined(F.col(c)) for c in ("before", "after")})
