"""Queries on property maps, services, processors and parameter contexts of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import (
    PROCESSOR_HAVE, PROCESSOR_WANT, PROPERTIES_SQL, SERVICE_HAVE, SERVICE_WANT, events, joined, pick,
    query, sql_case, two_halves, user_properties, tag,
)
from driftline.functions import compare as C
from driftline.functions import scalars as X
from driftline.operators import drift as D, planning
from driftline.operators.payloads import build_payload

PROCESSOR_SQL = f"""
{PROPERTIES_SQL},
x AS (SELECT du.user_id, have IS NOT NULL AS present, want, have,
        CASE want {" ".join(f"WHEN '{k}' THEN '{v or 'STOPPED'}'" for k, v in PROCESSOR_WANT.items())} END AS ds,
        coalesce({sql_case("have", PROCESSOR_HAVE)}, '') AS os, r_props
      FROM du LEFT JOIN ou USING (user_id) LEFT JOIN pr USING (user_id)),
xr AS (SELECT *, CASE WHEN user_id % 4 = 0 THEN 'name' END AS r_name,
        CASE WHEN want IN ('view', 'error') AND have <> want THEN 'schedulingPeriod' END AS r_period,
        CASE WHEN have <> 'signup' AND lower(ds) <> lower(os) THEN 'state' END AS r_state FROM x),
xf AS (SELECT *, CASE WHEN present THEN concat_ws(',', r_name, r_props, r_period, r_state) ELSE '' END AS reasons
       FROM xr),
xp AS (SELECT *, present AND reasons = '' AS up_to_date,
        CASE WHEN user_id % 5 = 0 THEN CASE WHEN present THEN 'DELETE' ELSE 'NOOP' END
             WHEN NOT present THEN 'CREATE' WHEN reasons <> '' THEN 'UPDATE' ELSE 'NOOP' END AS action FROM xf)
"""


def processors(spark, folder):
    """Processors per user: declared from the first half, observed in the second."""
    early, late = two_halves(spark, folder)
    user = tag("user ", "user_id")
    want = early.select(
        "user_id",
        F.struct(
            F.lit("root").alias("parentGroupId"),
            F.lit("worker").alias("type"),
            user.alias("name"),
            F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).alias("position"),
            F.struct(
                F.col("props").alias("properties"),
                F.array(F.lit("failure")).alias("autoTerminatedRelationships"),
                F.lit("").alias("schedulingStrategy"),
                F.when(F.col("last_type").isin("view", "error"), F.col("last_type"))
                .otherwise("").alias("schedulingPeriod"),
                F.lit(1).alias("concurrentlySchedulableTaskCount"),
                F.lit("30 sec").alias("penaltyDuration"),
                F.lit("1 sec").alias("yieldDuration"),
                F.lit("WARN").alias("bulletinLevel"),
                F.lit("").alias("comments"),
            ).alias("config"),
            pick(F.col("last_type"), PROCESSOR_WANT).alias("desiredState"),
        ).alias("desired"),
    )
    have = late.select(
        "user_id",
        F.struct(
            F.col("user_id").cast("string").alias("id"),
            F.struct(F.col("user_id").alias("version")).alias("revision"),
            # Users whose last event is a sign-up report no status at all.
            F.when(
                F.col("last_type") != "signup",
                F.struct(pick(F.col("last_type"), PROCESSOR_HAVE).alias("runStatus")),
            ).alias("status"),
            F.struct(
                F.when(F.col("user_id") % 4 != 0, user).otherwise("other").alias("name"),
                F.struct(
                    F.col("props").alias("properties"),
                    F.lit("TIMER_DRIVEN").alias("schedulingStrategy"),
                    F.col("last_type").alias("schedulingPeriod"),
                ).alias("config"),
                F.lit("VALID").alias("validationStatus"),
                F.array().cast("array<string>").alias("validationErrors"),
            ).alias("component"),
        ).alias("observed"),
    )
    return want.join(have, "user_id", "left").withColumn("exists", F.col("observed").isNotNull())


@query("drift_processor", f"WITH {PROCESSOR_SQL} SELECT user_id, reasons, up_to_date FROM xp")
def drift_processor(spark, folder):
    return D.drift(processors(spark, folder), "Processor").select(
        "user_id", joined(F.col("reasons")).alias("reasons"), "up_to_date"
    )


def planned_processors(spark, folder):
    drifted = D.drift(processors(spark, folder), "Processor").withColumn(
        "deletion_requested", F.col("user_id") % 5 == 0
    )
    return planning.plan_steps(planning.plan_action(drifted), "Processor")


@query("steps_processor", f"""
WITH {PROCESSOR_SQL}
SELECT user_id, action, CASE action WHEN 'CREATE' THEN 'POST'
   WHEN 'UPDATE' THEN 'STOP,REFRESH,PUT' || CASE WHEN ds = 'RUNNING' THEN ',START' ELSE '' END
   WHEN 'DELETE' THEN CASE WHEN os = 'RUNNING' THEN 'STOP,REFRESH,' ELSE '' END || 'DELETE' ELSE '' END AS steps
FROM xp""")
def steps_processor(spark, folder):
    return planned_processors(spark, folder).select(
        "user_id", "action", joined(F.col("steps")).alias("steps")
    )


@query("converge_processors", f"""
WITH {PROCESSOR_SQL},
nk AS (SELECT user_id, string_agg('property:' || prop, ',' ORDER BY prop) AS r FROM pd
       WHERE absent AND dval IS NULL GROUP BY 1)
SELECT user_id, concat_ws(',', r, CASE WHEN ds = 'DISABLED' THEN 'state' END) AS reasons
FROM xp LEFT JOIN nk USING (user_id) WHERE action = 'UPDATE'""")
def converge_processors(spark, folder):
    """What still drifts after an update: null properties without a key, DISABLED."""
    after = planning.converge(planned_processors(spark, folder), "Processor")
    return after.where("action = 'UPDATE'").select(
        "user_id", joined(F.col("reasons")).alias("reasons")
    )


@query("build_processor", f"""
WITH {PROPERTIES_SQL},
n AS (SELECT user_id, count(val) AS sent, count(*) AS declared FROM dp GROUP BY 1)
SELECT user_id, 'user ' || user_id AS name, 'worker' AS type, 'root' AS parent,
       CASE WHEN want <> 'error' THEN CAST(sent AS INTEGER) END AS sent_properties,
       CASE WHEN want <> 'error' THEN '30 sec' END AS penalty,
       CASE WHEN want <> 'view' THEN CAST(1.0 AS DOUBLE) END AS x, CAST(0 AS BIGINT) AS revision
FROM n JOIN du USING (user_id)""")
def build_processor(spark, folder):
    rows = processors(spark, folder)
    kept = rows.withColumn("last", F.col("desired.config.schedulingPeriod"))
    bare = kept.withColumn(
        "desired",
        F.col("desired")
        .withField("config", F.when(F.col("last") != "error", F.col("desired.config")))
        .withField("position", F.when(F.col("last") != "view", F.col("desired.position"))),
    )
    c = "payload.component"
    return build_payload(bare, "Processor").select(
        "user_id",
        f"{c}.name",
        f"{c}.type",
        F.col(f"{c}.parentGroupId").alias("parent"),
        F.size(F.map_keys(f"{c}.config.properties")).alias("sent_properties"),
        F.col(f"{c}.config.penaltyDuration").alias("penalty"),
        F.col(f"{c}.position.x").alias("x"),
        F.col("payload.revision.version").alias("revision"),
    )


@query("drop_null_props", f"WITH {PROPERTIES_SQL} SELECT user_id, prop, val FROM wl WHERE val IS NOT NULL")
def drop_null_props(spark, folder):
    whole = user_properties(spark, folder, early=None, null_every=10)
    return whole.select("user_id", F.explode(X.drop_null_props(F.col("props"))).alias("prop", "val"))


@query("map_subset_diff", f"""
WITH {PROPERTIES_SQL}
SELECT d.user_id, 'property:' || d.prop AS reason FROM dp d LEFT JOIN op o ON o.user_id = d.user_id AND o.prop = d.prop
WHERE o.user_id IS NULL OR (d.val IS NOT NULL AND d.val <> coalesce(o.val, ''))""")
def map_subset_diff(spark, folder):
    early, late = two_halves(spark, folder)
    both = early.select("user_id", "props").join(
        late.select("user_id", F.col("props").alias("have")), "user_id", "left"
    )
    diff = C.map_subset_diff(F.col("props"), F.col("have"))
    return both.select("user_id", F.explode(diff).alias("reason"))


SERVICE_SQL = f"""
{PROPERTIES_SQL},
s AS (SELECT du.user_id, have IS NOT NULL AS present,
        CASE WHEN want IN ('view', 'click') THEN 'ENABLED' ELSE 'DISABLED' END AS ds,
        {sql_case("have", SERVICE_HAVE)} AS os, r_props
      FROM du LEFT JOIN ou USING (user_id) LEFT JOIN pr USING (user_id)),
sf AS (SELECT *, CASE WHEN present THEN concat_ws(',', r_props, CASE WHEN ds <> os THEN 'state' END) ELSE '' END
        AS reasons FROM s),
sp AS (SELECT *, present AND reasons = '' AS up_to_date,
        CASE WHEN user_id % 5 = 0 THEN CASE WHEN present THEN 'DELETE' ELSE 'NOOP' END
             WHEN NOT present THEN 'CREATE' WHEN reasons <> '' THEN 'UPDATE' ELSE 'NOOP' END AS action FROM sf)
"""


def services(spark, folder):
    early, late = two_halves(spark, folder)
    user = tag("user ", "user_id")
    want = early.select(
        "user_id",
        F.struct(
            F.lit("root").alias("parentGroupId"),
            F.lit("pool").alias("type"),
            user.alias("name"),
            F.col("props").alias("properties"),
            F.col("last_type").alias("comments"),
            pick(F.col("last_type"), SERVICE_WANT).alias("desiredState"),
        ).alias("desired"),
    )
    have = late.select(
        "user_id",
        F.struct(
            F.col("user_id").cast("string").alias("id"),
            F.struct(F.col("user_id").alias("version")).alias("revision"),
            F.struct(
                user.alias("name"),
                F.col("props").alias("properties"),
                pick(F.col("last_type"), SERVICE_HAVE).alias("state"),
            ).alias("component"),
        ).alias("observed"),
    )
    return want.join(have, "user_id", "left").withColumn("exists", F.col("observed").isNotNull())


@query("drift_service", f"WITH {SERVICE_SQL} SELECT user_id, reasons, up_to_date FROM sp")
def drift_service(spark, folder):
    return D.drift(services(spark, folder), "ControllerService").select(
        "user_id", joined(F.col("reasons")).alias("reasons"), "up_to_date"
    )


@query("steps_service", f"""
WITH {SERVICE_SQL}
SELECT user_id, action, CASE action
   WHEN 'CREATE' THEN concat_ws(',', 'POST', CASE WHEN ds = 'ENABLED' THEN 'ENABLE' END)
   WHEN 'UPDATE' THEN concat_ws(',', CASE WHEN os = 'ENABLED' THEN 'DISABLE,REFRESH' END, 'PUT',
                                CASE WHEN ds = 'ENABLED' THEN 'ENABLE' END)
   WHEN 'DELETE' THEN concat_ws(',', CASE WHEN os = 'ENABLED' THEN 'DISABLE,REFRESH' END, 'DELETE')
   ELSE '' END AS steps FROM sp""")
def steps_service(spark, folder):
    drifted = D.drift(services(spark, folder), "ControllerService").withColumn(
        "deletion_requested", F.col("user_id") % 5 == 0
    )
    plan = planning.plan_steps(planning.plan_action(drifted), "ControllerService")
    return plan.select("user_id", "action", joined(F.col("steps")).alias("steps"))


@query("build_service", f"""
WITH {PROPERTIES_SQL}
SELECT du.user_id, 'user ' || du.user_id AS name, 'pool' AS type, want AS comments, 'root' AS parent,
       prop, val, CAST(0 AS BIGINT) AS revision
FROM du JOIN dp USING (user_id) WHERE val IS NOT NULL""")
def build_service(spark, folder):
    c = "payload.component"
    return build_payload(services(spark, folder), "ControllerService").select(
        "user_id",
        f"{c}.name",
        f"{c}.type",
        f"{c}.comments",
        F.col(f"{c}.parentGroupId").alias("parent"),
        F.explode(f"{c}.properties").alias("prop", "val"),
        F.col("payload.revision.version").alias("revision"),
    )


# Parameter contexts: the properties of a user as a list of named parameters.

def declared_parameters(entries):
    """Parameters without a value also state no description."""
    return F.transform(
        entries,
        lambda e: F.struct(
            e["name"].alias("name"),
            e["value"].alias("value"),
            F.when(e["value"].isNotNull(), e["description"]).otherwise("").alias("description"),
            e["name"].startswith("error").alias("sensitive"),
        ),
    )


def contexts(spark, folder):
    early, late = two_halves(spark, folder)
    user = tag("user ", "user_id")
    want = early.select(
        "user_id",
        F.struct(
            user.alias("name"),
            F.col("last_type").alias("description"),
            declared_parameters(F.col("entries")).alias("parameters"),
            F.when(F.col("last_type") == "view", F.array(F.lit("base"), F.lit("extra")))
            .alias("inheritedParameterContexts"),
        ).alias("desired"),
    )
    have = late_parameters(late).select(
        "user_id",
        F.struct(
            F.col("user_id").cast("string").alias("id"),
            F.struct(
                user.alias("name"), F.col("last_type").alias("description"), "parameters"
            ).alias("component"),
        ).alias("observed"),
    )
    return want.join(have, "user_id", "left")


def late_parameters(late):
    """Observed parameters, each inside an entity of its own."""
    entry = lambda e: F.struct(
        F.struct(
            e["name"].alias("name"), e["value"].alias("value"), e["description"].alias("description")
        ).alias("parameter")
    )
    return late.withColumn("parameters", F.transform("entries", entry))


CONTEXT_SQL = f"""
WITH {PROPERTIES_SQL},
e AS (SELECT du.user_id, want, have FROM du LEFT JOIN ou USING (user_id)),
n AS (SELECT user_id, sum(s) AS diff FROM (SELECT user_id, 1 AS s FROM dp UNION ALL SELECT user_id, -1 FROM op) GROUP BY 1),
r AS (SELECT user_id, 'description' AS reason FROM e WHERE want <> have
      UNION ALL SELECT user_id, 'parameter_count' FROM n JOIN e USING (user_id) WHERE diff <> 0 AND have IS NOT NULL
      UNION ALL SELECT d.user_id, CASE WHEN o.user_id IS NULL THEN 'parameter:' ELSE 'parameter_value:' END || d.prop
      FROM dp d JOIN ou ON ou.user_id = d.user_id LEFT JOIN op o ON o.user_id = d.user_id AND o.prop = d.prop
      WHERE o.user_id IS NULL OR d.val <> o.val),
g AS (SELECT user_id, string_agg(reason, ',' ORDER BY reason) AS reasons,
             string_agg(CASE WHEN reason = 'description' THEN '1' WHEN reason = 'parameter_count' THEN '2' ELSE '3' END, '' ORDER BY
               CASE WHEN reason = 'description' THEN '1' WHEN reason = 'parameter_count' THEN '2' ELSE '3' END) AS checks FROM r GROUP BY 1)
"""


@query("drift_context", f"""{CONTEXT_SQL}
SELECT user_id, coalesce(reasons, '') AS reasons, coalesce(checks, '') AS checks, have IS NOT NULL AND reasons IS NULL AS up_to_date
FROM e LEFT JOIN g USING (user_id)""")
def drift_context(spark, folder):
    """All contexts, missing and up-to-date ones too; ``checks`` has the order in which the reasons come."""
    place = lambda r: F.when(r == "description", "1").when(r == "parameter_count", "2").otherwise("3")
    return D.drift(contexts(spark, folder), "ParameterContext").select(
        "user_id", joined(F.array_sort("reasons")).alias("reasons"),
        F.array_join(F.transform("reasons", place), "").alias("checks"), "up_to_date",
    )


@query("build_context", f"""
WITH {PROPERTIES_SQL}
SELECT dp.user_id, 'user ' || dp.user_id AS name, want AS description, prop, val,
       CASE WHEN val IS NULL THEN '' ELSE event_type END AS text, event_type = 'error' AS sensitive,
       CASE WHEN want = 'view' THEN 'base,extra' END AS inherited
FROM dp JOIN du USING (user_id)""")
def build_context(spark, folder):
    c = "payload.component"
    built = build_payload(contexts(spark, folder), "ParameterContext")
    return built.select(
        "user_id",
        f"{c}.name",
        f"{c}.description",
        joined(F.transform(f"{c}.inheritedParameterContexts", lambda i: i["id"])).alias("inherited"),
        F.explode(f"{c}.parameters.parameter").alias("p"),
    ).select(
        "user_id", "name", "description", "inherited",
        F.col("p.name").alias("prop"), F.col("p.value").alias("val"),
        F.col("p.description").alias("text"), "p.sensitive",
    )


@query("named_list_diff", f"""
WITH {PROPERTIES_SQL},
n AS (SELECT user_id, sum(s) AS diff FROM (SELECT user_id, 1 AS s FROM dp UNION ALL SELECT user_id, -1 FROM op) GROUP BY 1)
SELECT user_id, 'parameter_count' AS reason FROM n WHERE diff <> 0
UNION ALL
SELECT d.user_id, CASE WHEN o.user_id IS NULL THEN 'parameter:' ELSE 'parameter_value:' END || d.prop
FROM dp d LEFT JOIN op o ON o.user_id = d.user_id AND o.prop = d.prop
WHERE o.user_id IS NULL OR d.val <> o.val""")
def named_list_diff(spark, folder):
    """Lists kept as rows, where one owner may have any number of entries."""

    def rows(early: bool, null_every: int):
        half = user_properties(spark, folder, early, null_every)
        return half.select("user_id", F.posexplode("entries").alias("position", "e")).select(
            "user_id", "position", "e.name", "e.value",
            F.when(F.col("e.value").isNotNull(), F.col("e.description")).alias("description"),
        )

    return D.diff_named_rows(
        rows(True, 10), rows(False, 7).withColumn("has_body", F.lit(True)), "user_id"
    )


@query("mask_sensitive", f"""
WITH {PROPERTIES_SQL}
SELECT user_id, prop, CASE WHEN event_type = 'error' AND val IS NOT NULL THEN '***' ELSE val END AS shown FROM wl""")
def mask_sensitive(spark, folder):
    from driftline.operators.extensions import mask_sensitive as mask

    whole = user_properties(spark, folder, early=None, null_every=10)
    entry = whole.select("user_id", F.explode("entries").alias("e"))
    return entry.select(
        "user_id", F.col("e.name").alias("prop"),
        mask(F.col("e.value"), F.col("e.description") == "error").alias("shown"),
    )


# Connections: the first event of a user against the last.

CONNECTION_SQL = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
a AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
b AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
cn AS (SELECT a.user_id, a.k AS ak, b.k AS bk,
  CASE WHEN a.k % 3 <> 0 AND a.event_type <> b.event_type THEN 'name' END AS r1,
  CASE WHEN a.k % 5 <> 0 AND a.k % 4 <> b.k % 4 THEN 'flowFileExpiration' END AS r2,
  CASE WHEN a.k % 10 <> 0 AND a.k % 10 <> b.k % 10 THEN 'backPressureObjectThreshold' END AS r3,
  CASE WHEN a.k % 2 <> 0 AND a.k % 7 <> b.k % 7 THEN 'backPressureDataSizeThreshold' END AS r4
  FROM a JOIN b USING (user_id))
"""


def connections(spark, folder):
    ev = events(spark, folder)
    ends = ev.groupBy("user_id").agg(
        F.min(F.struct("ts", "event_id", "event_type", "k")).alias("a"),
        F.max(F.struct("ts", "event_id", "event_type", "k")).alias("b"),
    )
    a, b = F.col("a.k"), F.col("b.k")
    seconds = lambda k: F.concat((k % 4).cast("string"), F.lit(" sec"))
    gigabytes = lambda k: F.concat((k % 7).cast("string"), F.lit(" GB"))
    return ends.select(
        "user_id",
        a.alias("ak"),
        F.struct(
            F.when(a % 3 != 0, F.col("a.event_type")).otherwise("").alias("name"),
            F.when(a % 5 != 0, seconds(a)).otherwise("").alias("flowFileExpiration"),
            (a % 10).alias("backPressureObjectThreshold"),
            F.when(a % 2 != 0, gigabytes(a)).otherwise("").alias("backPressureDataSizeThreshold"),
        ).alias("desired"),
        F.struct(
            F.struct(
                F.col("b.event_type").alias("name"),
                seconds(b).alias("flowFileExpiration"),
                (b % 10).alias("backPressureObjectThreshold"),
                gigabytes(b).alias("backPressureDataSizeThreshold"),
            ).alias("component"),
        ).alias("observed"),
    )


@query("drift_connection", f"WITH {CONNECTION_SQL} SELECT user_id, concat_ws(',', r1, r2, r3, r4) AS reasons FROM cn")
def drift_connection(spark, folder):
    return D.drift(connections(spark, folder), "Connection").select(
        "user_id", joined(F.col("reasons")).alias("reasons")
    )


@query("sparse_diff", f"WITH {CONNECTION_SQL} SELECT user_id, concat_ws(',', r1, r3) AS reasons FROM cn")
def sparse_diff(spark, folder):
    d, o = F.col("desired"), F.col("observed.component")
    field = "backPressureObjectThreshold"
    found = F.concat(
        C.sparse_diff(d["name"], o["name"], "name"), C.sparse_diff(d[field], o[field], field, unset=0)
    )
    return connections(spark, folder).select("user_id", joined(found).alias("reasons"))


@query("steps_simple", f"""
WITH {CONNECTION_SQL}
SELECT user_id, action, CASE action WHEN 'DELETE' THEN 'DELETE' WHEN 'CREATE' THEN 'POST' WHEN 'UPDATE' THEN 'PUT'
       ELSE '' END AS steps
FROM (SELECT user_id, CASE WHEN ak % 5 = 1 THEN 'DELETE' WHEN ak % 5 = 2 THEN 'CREATE'
             WHEN coalesce(r1, r2, r3, r4) IS NOT NULL THEN 'UPDATE' ELSE 'NOOP' END AS action FROM cn)""")
def steps_simple(spark, folder):
    drifted = D.drift(connections(spark, folder), "Connection")
    marked = drifted.withColumn("exists", F.col("ak") % 5 != 2).withColumn(
        "deletion_requested", F.col("ak") % 5 == 1
    )
    plan = planning.plan_steps(planning.plan_action(marked), "Connection")
    return plan.select("user_id", "action", joined(F.col("steps")).alias("steps"))
