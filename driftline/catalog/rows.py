"""Queries on single rows: validation, error classification, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import EVENTS_SQL, events, joined, pick, query, table, tag
from driftline.functions import scalars as X
from driftline.operators import validation as V
from driftline.operators.extensions import flow_limits
from driftline.operators.payloads import build_payload
from driftline.operators.drift import drift


@query("validate_required", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey % 5 = 0 THEN 'parentGroupId required' END,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'type required' END, CASE WHEN c_acctbal < 0 THEN 'name required' END) AS violations
FROM customer""")
def validate_required(spark, folder):
    """Customers as services; an empty type is present, a null one is not."""
    desired = F.struct(
        F.when(F.col("c_nationkey") % 5 != 0, F.lit("g")).alias("parentGroupId"),
        pick(F.col("c_mktsegment"), {"HOUSEHOLD": "", "FURNITURE": None}, "t").alias("type"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.lit(None).cast("string").alias("desiredState"),
    )
    rows = table(spark, folder, "customer").select("c_custkey", desired.alias("desired"))
    return V.validate(rows, "ControllerService").select(
        "c_custkey", joined(F.col("violations")).alias("violations")
    )


@query("validate_enum", """
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN 'config.schedulingStrategy unsupported' END,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'config.bulletinLevel unsupported' END,
  CASE WHEN o_orderstatus = 'O' THEN 'desiredState unsupported' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'managementPolicies unsupported' END) AS violations FROM orders""")
def validate_enum(spark, folder):
    """Orders as processors; priorities and lower-case states are no valid values."""
    priority = F.col("o_orderpriority")
    odd = F.when(priority == "1-URGENT", priority)
    desired = F.struct(
        F.lit("g").alias("parentGroupId"),
        F.lit("t").alias("type"),
        F.lit("n").alias("name"),
        F.struct(
            F.coalesce(odd, F.lit("CRON_DRIVEN")).alias("schedulingStrategy"),
            pick(priority, {"1-URGENT": "", "2-HIGH": "TRACE", "3-MEDIUM": "INFO"}).alias("bulletinLevel"),
        ).alias("config"),
        pick(F.col("o_orderstatus"), {"F": "RUNNING", "O": "stopped"}).alias("desiredState"),
    )
    policies = F.array(F.lit("*"), F.when(priority == "5-LOW", "Pause").otherwise("Delete"))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", desired.alias("desired"), policies.alias("managementPolicies")
    )
    return V.validate(rows, "Processor").select(
        "o_orderkey", joined(F.col("violations")).alias("violations")
    )


@query("validate_endpoints", """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',',
  CASE WHEN l_returnflag = 'N' THEN 'source required' END,
  CASE WHEN l_linestatus = 'F' THEN 'destination.type required' END,
  CASE WHEN l_returnflag = 'R' THEN 'source.type unsupported' END) AS violations FROM lineitem""")
def validate_endpoints(spark, folder):
    """Lines as connections: an absent end is one violation, its fields are not asked for."""
    flag = F.col("l_returnflag")
    end = lambda kind: F.struct(
        F.lit("i").alias("id"), kind.alias("type"), F.lit("g").alias("groupId")
    )
    kind = F.when(flag == "R", "DISK").otherwise("FUNNEL")
    desired = F.struct(
        F.lit("g").alias("parentGroupId"),
        F.when(flag != "N", end(kind)).alias("source"),
        end(F.when(F.col("l_linestatus") != "F", "INPUT_PORT")).alias("destination"),
        F.lit(None).cast("string").alias("loadBalanceStrategy"),
        F.lit("DO_NOT_COMPRESS").alias("loadBalanceCompression"),
    )
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", desired.alias("desired")
    )
    return V.validate(rows, "Connection").select(
        "l_orderkey", "l_linenumber", "l_partkey", joined(F.col("violations")).alias("violations")
    )


@query("validate_typed", f"""
WITH {EVENTS_SQL}
SELECT event_id, CASE event_type WHEN 'signup' THEN 'not JSON' WHEN 'error' THEN 'k not integer'
   WHEN 'purchase' THEN 'properties not string_map,on not boolean' WHEN 'click' THEN 'k not integer' ELSE '' END AS violations
FROM ev""")
def validate_typed(spark, folder):
    """Event texts, some turned into text for a number, a fraction, or no JSON at all."""
    props, kind = F.col("props"), F.col("event_type")
    document = (
        F.when(kind == "signup", F.substring(props, 1, 4))
        .when(kind == "error", F.regexp_replace(props, "([0-9]+)", '"$1"'))
        .when(kind == "click", F.regexp_replace(props, "([0-9]+)", "$1.5"))
        .when(kind == "purchase", F.regexp_replace(props, "[}]", ', "properties": {"a": "b", "c": 1}, "on": "yes"}'))
        .otherwise(F.regexp_replace(props, "[}]", ', "properties": {"a": "b", "c": null}, "on": true}'))
    )
    types = {"k": "integer", "properties": "string_map", "on": "boolean"}
    rows = events(spark, folder).select("event_id", document.alias("document"))
    return V.validate_typed(rows, "document", types).select(
        "event_id", joined(F.col("violations")).alias("violations")
    )


ERROR_SQL = f"""
{EVENTS_SQL},
er AS (SELECT event_id, CASE k % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 END AS status,
              CASE k % 5 WHEN 2 THEN '404 Not Found' WHEN 3 THEN '409 Conflict' END AS status_text,
              'cannot reach processor ' || event_id AS text FROM ev),
ec AS (SELECT *, coalesce(status, 0) = 404 OR contains(coalesce(status_text, text), '404') AS lost FROM er)
"""


def failures(spark, folder):
    """Failed lookups; the raw text holds an id, and ids can contain 404."""
    k = F.col("k") % 5
    return events(spark, folder).select(
        "event_id",
        F.when(k == 0, 404).when(k == 1, 500).alias("status"),
        F.when(k == 2, "404 Not Found").when(k == 3, "409 Conflict").alias("status_text"),
        tag("cannot reach processor ", "event_id").alias("text"),
    )


@query("not_found", f"""
WITH {ERROR_SQL} SELECT event_id, CASE WHEN lost THEN 'NOT_FOUND' ELSE 'API_ERROR' END AS class FROM ec""")
def not_found(spark, folder):
    found = X.classify_error(F.col("status"), F.col("text"), F.col("status_text"))
    return failures(spark, folder).select("event_id", found.alias("class"))


@query("error_context", f"""
WITH {ERROR_SQL}
SELECT event_id, CASE WHEN lost THEN 'resource not found: get processor ' || event_id
   ELSE 'API error: get processor ' || event_id || CASE WHEN status_text IS NOT NULL THEN ' (body: ' || text || ')' ELSE '' END
        || ': ' || coalesce(status_text, text) END AS message FROM ec""")
def error_context(spark, folder):
    message = X.error_context(
        F.lit("get processor"), F.col("event_id"), F.col("status"), F.col("text"),
        F.col("status_text"), F.col("text"),
    )
    return failures(spark, folder).select("event_id", message.alias("message"))


@query("token_url", """
SELECT page_id, (CASE WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url END) || '/access/token' AS token_url
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE url END AS url FROM pages)""")
def token_url(spark, folder):
    base = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", X.token_url(base).alias("token_url"))


@query("token_text", r"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE role || CAST(turn AS VARCHAR) END AS token FROM conversations""")
def token_text(spark, folder):
    """Token bodies with white space of several kinds around them; blank ones are no token."""
    body = F.when(F.col("role") == "system", F.lit(" \t\n")).otherwise(
        F.concat(F.lit("\n\t  "), "role", F.col("turn").cast("string"), F.lit(" \r\n "))
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.token_text(body).alias("token")
    )


@query("int_text", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey AS VARCHAR) AS version FROM lineitem")
def int_text(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.int_text(F.col("l_orderkey")).alias("version")
    )


@query("duration_size", f"""
WITH {EVENTS_SQL}
SELECT event_id, CASE event_type WHEN 'view' THEN k * 1000 WHEN 'click' THEN k * 60000 WHEN 'purchase' THEN k * 86400000
     WHEN 'error' THEN k END AS duration_ms,
   CASE event_type WHEN 'view' THEN k WHEN 'click' THEN k * 1024 WHEN 'purchase' THEN k * 1073741824
     WHEN 'error' THEN k * 1048576 END AS size_bytes FROM ev""")
def duration_size(spark, folder):
    """Texts with units as numbers; a cron text and a bare word have none."""
    kind = F.col("event_type")
    unit = pick(kind, {"view": " sec", "click": " mins", "purchase": "days", "error": " MS"})
    bytes_unit = pick(kind, {"view": " B", "click": "KB", "purchase": " gb", "error": " MB"})
    k = F.col("k").cast("string")
    rows = events(spark, folder).select(
        "event_id",
        F.coalesce(F.concat(k, unit), F.lit("0 0 * * * ?")).alias("duration"),
        F.coalesce(F.concat(k, bytes_unit), F.lit("large")).alias("size"),
    )
    return flow_limits(rows, "duration", "size").drop("duration", "size")


@query("build_connection", """
SELECT l_orderkey, l_linenumber, l_partkey, 'line ' || l_linenumber AS name, CAST(l_partkey AS VARCHAR) AS source_id,
   CAST(l_suppkey AS VARCHAR) AS destination_id, 'FUNNEL' AS destination_type, l_returnflag || ',' || l_linestatus AS selected,
   CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(1 AS INTEGER) END AS bends,
   CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS bend_x, CAST(l_quantity AS BIGINT) AS threshold,
   CAST(0 AS BIGINT) AS revision FROM lineitem""")
def build_connection(spark, folder):
    end = lambda c, kind: F.struct(
        F.col(c).cast("string").alias("id"), F.lit(kind).alias("type"),
        F.col("l_orderkey").cast("string").alias("groupId"),
    )
    nothing = F.lit(None).cast("string")
    point = F.array(F.struct(F.col("l_quantity").alias("x"), F.lit(0.0).alias("y")))
    desired = F.struct(
        F.col("l_orderkey").cast("string").alias("parentGroupId"),
        end("l_partkey", "PROCESSOR").alias("source"),
        end("l_suppkey", "FUNNEL").alias("destination"),
        F.array("l_returnflag", "l_linestatus").alias("selectedRelationships"),
        tag("line ", "l_linenumber").alias("name"),
        F.lit("0 sec").alias("flowFileExpiration"),
        F.col("l_quantity").cast("bigint").alias("backPressureObjectThreshold"),
        F.lit("1 GB").alias("backPressureDataSizeThreshold"),
        F.when(F.col("l_returnflag") == "N", F.slice(point, 1, 0)).otherwise(point).alias("bends"),
        F.lit(0).alias("labelIndex"),
        F.lit(None).cast("array<string>").alias("prioritizers"),
        nothing.alias("loadBalanceStrategy"),
        nothing.alias("loadBalancePartitionAttribute"),
        nothing.alias("loadBalanceCompression"),
    )
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", desired.alias("desired")
    )
    c = "payload.component"
    return build_payload(rows, "Connection").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        f"{c}.name",
        F.col(f"{c}.source.id").alias("source_id"),
        F.col(f"{c}.destination.id").alias("destination_id"),
        F.col(f"{c}.destination.type").alias("destination_type"),
        joined(F.col(f"{c}.selectedRelationships")).alias("selected"),
        F.when(F.col(f"{c}.bends").isNotNull(), F.size(f"{c}.bends")).alias("bends"),
        F.col(f"{c}.bends")[0]["x"].alias("bend_x"),
        F.col(f"{c}.backPressureObjectThreshold").alias("threshold"),
        F.col("payload.revision.version").alias("revision"),
    )


@query("drift_lines", """
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',',
   CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'name' END,
   CASE WHEN l_linestatus = 'O' THEN 'backPressureDataSizeThreshold' END) AS reasons FROM lineitem""")
def drift_lines(spark, folder):
    """Lines as connections: sizes are compared as text, so 1 GB is not 1024 MB."""
    is_open = F.col("l_linestatus") == "O"
    desired = F.struct(
        F.when(F.col("l_returnflag") == "A", F.lit("F-A")).otherwise("").alias("name"),
        F.lit("").alias("flowFileExpiration"),
        F.lit(0).cast("bigint").alias("backPressureObjectThreshold"),
        F.lit("1 GB").alias("backPressureDataSizeThreshold"),
    )
    observed = F.struct(
        F.struct(
            F.when(is_open, "F-A").otherwise("other").alias("name"),
            F.lit("9 sec").alias("flowFileExpiration"),
            F.lit(10000).cast("bigint").alias("backPressureObjectThreshold"),
            F.when(is_open, "1024 MB").otherwise("1 GB").alias("backPressureDataSizeThreshold"),
        ).alias("component")
    )
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", desired.alias("desired"), observed.alias("observed")
    )
    return drift(rows, "Connection").select(
        "l_orderkey", "l_linenumber", "l_partkey", joined(F.col("reasons")).alias("reasons")
    )
