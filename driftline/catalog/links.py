"""Queries on graphs of records: routing, composites, dangling ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog import example
from driftline.catalog.common import EVENTS_SQL, events, pick, query, table, tag
from driftline.operators import dataflow, extensions, metrics
from driftline.plans import composite

SELECTED = {
    "BUILDING": "view,click",
    "MACHINERY": "purchase",
    "FURNITURE": "error,signup,error",
    "HOUSEHOLD": "view,click,purchase,error,signup",
}


def selected():
    """Relationships per market segment; one segment selects none."""
    return F.split(pick(F.col("c_mktsegment"), SELECTED), ",")


SELECTED_SQL = """
se AS (SELECT c_custkey, c_nationkey, c_mktsegment, unnest(CASE c_mktsegment WHEN 'BUILDING' THEN ['view', 'click']
    WHEN 'MACHINERY' THEN ['purchase'] WHEN 'FURNITURE' THEN ['error', 'signup']
    WHEN 'HOUSEHOLD' THEN ['view', 'click', 'purchase', 'error', 'signup'] ELSE [] END) AS relationship FROM customer)
"""


def event_records(spark, folder):
    return events(spark, folder).select(
        "event_id", F.col("user_id").alias("source_id"), F.col("event_type").alias("relationship"), "ts", "k"
    )


@query("route", f"""
WITH {SELECTED_SQL}
SELECT event_id, relationship, c_custkey AS connection_id, c_nationkey AS destination_id
FROM events JOIN se ON event_type = relationship AND c_custkey // 10 = user_id""")
def route(spark, folder):
    edges = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("connection_id"),
        F.floor(F.col("c_custkey") / 10).alias("source_id"),
        F.col("c_nationkey").alias("destination_id"),
        selected().alias("selectedRelationships"),
    )
    return dataflow.route(event_records(spark, folder), edges).select(
        "event_id", "relationship", "connection_id", "destination_id"
    )


@query("auto_terminate", f"""
WITH {SELECTED_SQL}
SELECT event_id, user_id AS source_id, event_type AS relationship FROM events
WHERE NOT EXISTS (SELECT 1 FROM se WHERE c_custkey = user_id AND relationship = event_type)""")
def auto_terminate(spark, folder):
    vertices = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("source_id"), selected().alias("autoTerminatedRelationships")
    )
    return dataflow.auto_terminate(event_records(spark, folder), vertices).select(
        "event_id", "source_id", "relationship"
    )


@query("expire", """
SELECT event_id, user_id AS connection_id FROM events LEFT JOIN customer ON c_custkey = user_id
WHERE CASE c_nationkey % 4 WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 864000000000
           WHEN 2 THEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 129600000000 ELSE true END""")
def expire(spark, folder):
    limits = {0: "0 sec", 1: "10 days", 2: "36 hours", 3: ""}
    edges = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("connection_id"),
        pick(F.col("c_nationkey") % 4, limits).alias("flowFileExpiration"),
    )
    queued = events(spark, folder).select(
        "event_id", F.col("user_id").alias("connection_id"), F.col("ts").alias("entered")
    )
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return dataflow.expire(queued, edges, as_of).select("event_id", "connection_id")


@query("back_pressure", f"""
WITH {EVENTS_SQL},
q AS (SELECT user_id, count(*) AS n, sum(k * 1024) AS b FROM ev GROUP BY 1)
SELECT c_custkey AS connection_id, coalesce(n, 0) AS objects, CAST(coalesce(b, 0) AS BIGINT) AS bytes,
       c_nationkey > 0 AND coalesce(n, 0) >= c_nationkey * 5 AS objects_full,
       c_nationkey % 4 > 0 AND coalesce(b, 0) >= (c_nationkey % 4) * 1048576 AS size_full
FROM customer LEFT JOIN q ON user_id = c_custkey""")
def back_pressure(spark, folder):
    queue = events(spark, folder).select(
        F.col("user_id").alias("connection_id"), (F.col("k") * 1024).alias("bytes")
    )
    edges = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("connection_id"),
        (F.col("c_nationkey") * 5).cast("bigint").alias("backPressureObjectThreshold"),
        F.concat((F.col("c_nationkey") % 4).cast("string"), F.lit(" MB")).alias("backPressureDataSizeThreshold"),
    )
    return dataflow.back_pressure(queue, edges)


@query("load_balance", """
SELECT 'ROUND_ROBIN' AS strategy, event_type, count(*) AS n, count(DISTINCT event_id % 4) AS nodes FROM events GROUP BY 2
UNION ALL SELECT 'PARTITION_BY_ATTRIBUTE', event_type, count(*), 1 FROM events GROUP BY 2
UNION ALL SELECT 'SINGLE_NODE', event_type, count(*), 1 FROM events GROUP BY 2
UNION ALL SELECT 'DO_NOT_LOAD_BALANCE', event_type, count(*), count(DISTINCT user_id % 3) FROM events GROUP BY 2""")
def load_balance(spark, folder):
    """Records and nodes per strategy and attribute; equal attributes share a node."""
    rows = events(spark, folder).withColumn("home", F.col("user_id") % 3)
    placed = None
    for strategy in ("ROUND_ROBIN", "PARTITION_BY_ATTRIBUTE", "SINGLE_NODE", "DO_NOT_LOAD_BALANCE"):
        dealt = dataflow.load_balance(rows, strategy, 4, "event_id", "event_type", "home").select(
            F.lit(strategy).alias("strategy"), "event_type", "node"
        )
        placed = dealt if placed is None else placed.unionByName(dealt)
    per_node = placed.groupBy("strategy", "event_type", "node").agg(F.count(F.lit(1)).alias("n"))
    return per_node.groupBy("strategy", "event_type").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes")
    )


@query("source_rates", """
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS w, count(*) AS n, min(ts) AS f, max(ts) AS l FROM events GROUP BY ALL)
SELECT user_id AS source, CAST(sum(n) AS BIGINT) AS records, min(f) AS "first", max(l) AS "last",
       count(w) AS windows, max(n) FILTER (w IS NOT NULL) AS busiest FROM h GROUP BY 1""")
def source_rates(spark, folder):
    """How many records each user sent, and in how many hours."""
    return metrics.source_rates(table(spark, folder, "events"), "user_id", "ts")


@query("attribute_skew", """
WITH v AS (SELECT 'event_type' AS attribute, CAST(event_type AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY ALL
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL
  UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY ALL),
t AS (SELECT attribute, value FROM v QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value NULLS FIRST) = 1)
SELECT attribute, CAST(sum(n) AS BIGINT) AS records, count(*) AS "values", any_value(t.value) AS commonest, max(n) AS most,
       CAST(max(n) * count(*) * 100 // CAST(sum(n) AS BIGINT) AS BIGINT) AS of_mean
FROM v JOIN t USING (attribute) GROUP BY attribute""")
def attribute_skew(spark, folder):
    """Which attribute of the events could deal them evenly."""
    return metrics.attribute_skew(table(spark, folder, "events"), ["event_type", "user_id", "props"])


def claims(spark, folder):
    """Customers as claims of the example composite; some state no config name, some no namespace."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("claim"),
        # Not a literal, so that the plan is that of claims of many templates.
        F.when(F.col("c_custkey").isNotNull(), F.lit(example.NAME)).alias("template"),
        F.create_map(
            F.lit("spec.parentGroupId"), F.lit("root"),
            F.lit("spec.providerConfigRefName"),
            F.when(F.col("c_nationkey") % 2 == 0, tag("cfg-", "c_nationkey")),
            F.lit('metadata.labels["claim-namespace"]'),
            F.when(F.col("c_nationkey") % 3 != 0, tag("ns-", "c_nationkey")),
        ).alias("spec"),
    )


def outputs(spark, folder):
    """What the resources of a claim have reported, now and earlier: the group, and some processors."""
    paths = example.OUTPUTS
    nation = F.col("c_nationkey")
    rows = F.array(
        *[
            F.when(
                nation % 5 > i,
                F.struct(F.lit(p).alias("path"), value.alias("value"), F.lit(at).alias("at")),
            )
            for i, p in enumerate(paths)
            # The older report sorts after the newer one as text.
            for at, value in ((1, F.lit("zz-old")), (2, tag(f"id{i}-", "c_custkey")))
        ]
    )
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("claim"), F.explode(F.array_compact(rows)).alias("o")
    ).select("claim", "o.*")


STEP_SQL = """
sp(step, needs, kind) AS (VALUES ('process-group', [], 'ProcessGroup'), ('generate-flowfile', [0], 'Processor'),
  ('replace-text', [0], 'Processor'), ('log-attribute', [0], 'Processor'),
  ('conn-generate-to-replace', [0, 1, 2], 'Connection'), ('conn-replace-to-log', [0, 2, 3], 'Connection')),
cs AS (SELECT c_custkey AS claim, c_nationkey, c_nationkey % 5 AS have, step, kind, needs FROM customer, sp)
"""


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


@query("resolve_patches", f"""
WITH base(step, path, value) AS (VALUES {sql_rows(example.BASE_ROWS)}),
patch(step, source, path, required) AS (VALUES {sql_rows((s, *p) for s, _, *p in example.PATCH_ROWS)}),
kinds(step, kind) AS (VALUES {sql_rows((s, k) for s, k, _ in example.KINDS)}),
out(i, source) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(example.OUTPUTS))}),
known AS (SELECT c_custkey AS claim, 'spec.parentGroupId' AS source, 'root' AS value FROM customer
  UNION ALL SELECT c_custkey, 'spec.providerConfigRefName', 'cfg-' || c_nationkey FROM customer WHERE c_nationkey % 2 = 0
  UNION ALL SELECT c_custkey, 'metadata.labels["claim-namespace"]', 'ns-' || c_nationkey FROM customer WHERE c_nationkey % 3 <> 0
  UNION ALL SELECT c_custkey, source, 'id' || i || '-' || c_custkey FROM customer, out WHERE c_nationkey % 5 > i),
put AS (SELECT claim, step, path, value FROM patch JOIN known USING (source)),
field AS (SELECT * FROM put UNION ALL SELECT c_custkey, step, path, value FROM customer, base
  WHERE NOT EXISTS (SELECT 1 FROM put WHERE put.claim = c_custkey AND put.step = base.step AND put.path = base.path)),
texts AS (SELECT claim, step, string_agg(path || '=' || value, ';' ORDER BY path) AS fields FROM field GROUP BY ALL),
lack AS (SELECT DISTINCT c_custkey AS claim, step FROM customer, patch WHERE required = 'True'
  AND NOT EXISTS (SELECT 1 FROM known WHERE known.claim = c_custkey AND known.source = patch.source))
SELECT c_custkey AS claim, k.step, k.kind, lack.claim IS NOT NULL AS blocked, coalesce(fields, '') AS fields
FROM customer CROSS JOIN kinds k LEFT JOIN texts t ON t.claim = c_custkey AND t.step = k.step
LEFT JOIN lack ON lack.claim = c_custkey AND lack.step = k.step""")
def resolve_patches(spark, folder):
    resolved = composite.resolve_patches(claims(spark, folder), example.templates(spark), outputs(spark, folder))
    field = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return resolved.select(
        "claim", "step", "kind", "blocked",
        F.array_join(F.transform(F.array_sort(F.map_entries("fields")), field), ";").alias("fields"),
    )


@query("creation_rounds", f"""
WITH {STEP_SQL}
SELECT claim, step, CAST(CASE WHEN coalesce(list_max(needs), -1) < have THEN 1
   WHEN kind = 'Processor' THEN 2 WHEN have = 0 THEN 3 ELSE 2 END AS INTEGER) AS round FROM cs""")
def creation_rounds(spark, folder):
    return composite.creation_rounds(claims(spark, folder), example.templates(spark), outputs(spark, folder))


#: Lines as steps of their order's template: a line needs the outputs of up to two lines, itself perhaps, by part and supplier.
_WALKS = """
s AS (SELECT l_orderkey AS t, l_linenumber AS n, min(l_partkey) % 7 + 1 AS a, min(l_suppkey) % 9 + 1 AS b FROM lineitem GROUP BY ALL),
e AS (SELECT DISTINCT s.t, s.n, m.n AS needs FROM s JOIN s m ON m.t = s.t AND (m.n = s.a OR m.n = s.b)),
up AS (SELECT t, n, n AS at, 1 AS depth FROM s UNION SELECT up.t, up.n, e.needs, depth + 1 FROM up JOIN e ON e.t = up.t AND e.n = up.at WHERE depth < 9),
down AS (SELECT t, n, n AS at, 1 AS depth FROM s UNION SELECT down.t, down.n, e.n, depth + 1 FROM down JOIN e ON e.t = down.t AND e.needs = down.at WHERE depth < 9)
"""


def line_templates(spark, folder):
    """Every order as a template of its lines, one for each line number."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    name = lambda n: F.concat(F.lit("line-"), n.cast("string"))
    steps = lines.select(
        F.col("l_orderkey").alias("template"), name(F.col("l_linenumber")).alias("step"), F.col("l_linenumber").alias("position"),
        F.lit("Processor").alias("kind"), name(F.col("l_linenumber")).alias("output"),
    )
    sources = F.array(F.col("l_partkey") % 7 + 1, F.col("l_suppkey") % 9 + 1)
    patches = lines.select("l_orderkey", "l_linenumber", F.posexplode(sources).alias("position", "of")).select(
        F.col("l_orderkey").alias("template"), name(F.col("l_linenumber")).alias("step"), "position", name(F.col("of")).alias("source"),
        tag("spec.input", "position").alias("target"), F.lit(True).alias("required"),
    )
    bases = lines.select(F.col("l_orderkey").alias("template"), name(F.col("l_linenumber")).alias("step"), F.lit("spec.part").alias("path"), F.col("l_partkey").cast("string").alias("value"))
    return composite.Templates(steps, patches, bases)


@query("template_levels", f"""
WITH RECURSIVE {_WALKS}
SELECT t AS template, 'line-' || n AS step, CASE WHEN max(up.depth) < 9 THEN max(up.depth) END AS level,
       max(up.depth) >= 9 AND (SELECT max(depth) FROM down WHERE down.t = up.t AND down.n = up.n) >= 9 AS in_cycle FROM up GROUP BY t, n""")
def template_levels(spark, folder):
    """All orders as templates, their levels and cycles found together."""
    return composite.template_levels(line_templates(spark, folder))


@query("template_rounds", f"""
WITH RECURSIVE s AS (SELECT l_orderkey AS t, l_linenumber AS n, [min(l_partkey) % 7 + 1, min(l_suppkey) % 9 + 1] AS needs, max(l_quantity) > 30 AS done FROM lineitem GROUP BY ALL),
p AS (SELECT t, n, unnest(needs) AS m FROM s),
e AS (SELECT p.t, p.n, m.n AS maker, m.n IS NULL AS none FROM p LEFT JOIN s m ON m.t = p.t AND m.n = p.m WHERE m.done IS NOT TRUE),
up AS (SELECT t, n, n AS at, 1 AS depth, false AS none FROM s
  UNION SELECT up.t, up.n, e.maker, depth + 1, e.none FROM up JOIN e ON e.t = up.t AND e.n = up.at WHERE depth < 9 AND NOT up.none)
SELECT t AS claim, 'line-' || n AS step, CASE WHEN max(depth) < 9 AND NOT bool_or(none) THEN max(depth) END::INT AS round FROM up GROUP BY t, n""")
def template_rounds(spark, folder):
    """An order as a claim of its own template; lines of more than 30 pieces have reported."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderkey").alias("template"), F.lit(None).cast("map<string,string>").alias("spec"))
    reported = table(spark, folder, "lineitem").where("l_quantity > 30").select(
        F.col("l_orderkey").alias("claim"), tag("line-", "l_linenumber").alias("path"), F.col("l_quantity").cast("string").alias("value")
    )
    return composite.creation_rounds(orders, line_templates(spark, folder), reported)


@query("dangling_edges", """
SELECT l_orderkey * 10 + l_linenumber AS connection_id, 'destination' AS role, CAST(l_suppkey + l_linenumber AS VARCHAR) AS id
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey + l_linenumber)
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'source', CAST(l_partkey + l_linenumber AS VARCHAR)
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey + l_linenumber)
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'group', CAST(l_orderkey + l_linenumber AS VARCHAR)
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey + l_linenumber)""")
def dangling_edges(spark, folder):
    """Lines as connections from part to supplier in an order, each id moved up a little."""
    shift = F.col("l_linenumber")
    edges = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + shift).alias("connection_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") + shift).cast("string")).alias("source_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") + shift).cast("string")).alias("destination_id"),
        (F.col("l_orderkey") + shift).alias("group_id"),
    )
    parts = table(spark, folder, "part").select(tag("p", "p_partkey").alias("id"))
    suppliers = table(spark, folder, "supplier").select(tag("s", "s_suppkey").alias("id"))
    homes = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    lost = extensions.dangling_edges(edges, parts.unionByName(suppliers), homes)
    return lost.withColumn("id", F.regexp_replace("id", "^[ps]", ""))
