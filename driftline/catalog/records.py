"""Queries on texts and documents: manifests, lists, entities, hashing, logging."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import EVENTS_SQL, events, query, table, tag
from driftline.operators import dataflow
from driftline.session import scratch_path
from driftline.sources import generate, readers, sinks


@query("src_list_items", """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, s[i] AS name, 'id-' || doc_id AS id,
       CASE WHEN length(s[i]) % 3 <> 0 THEN CAST(length(s[i]) AS BIGINT) END AS revision
FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def src_list_items(spark, folder):
    """Each document as a list dump whose items are named after its lines."""
    item = lambda line: F.struct(
        F.lit("Processor").alias("kind"), F.struct(line.alias("name")).alias("metadata"),
        F.struct(F.struct(
            tag("id-", "doc_id").alias("id"), F.when(F.length(line) % 3 != 0, F.length(line).cast("bigint")).alias("version")
        ).alias("atProvider")).alias("status"),
    )
    dumps = table(spark, folder, "documents").select(
        "doc_id",
        F.to_json(
            F.struct(
                F.lit("ProcessorList").alias("kind"),
                F.transform(F.split("text", "\n"), item).alias("items"),
            )
        ).alias("dump"),
    )
    items = readers.list_items(readers.parse_lists(dumps, "dump", "Processor"))
    status = "resource.status.atProvider"
    return items.select(
        "doc_id", "position", F.col("resource.metadata.name").alias("name"), F.col(f"{status}.id").alias("id"), F.col(f"{status}.version").alias("revision")
    )


@query("src_manifests", """
SELECT CAST(c_custkey AS VARCHAR) AS source, CAST(0 AS INTEGER) AS position, c_name AS name,
       'group ' || c_nationkey AS parent, c_mktsegment AS comments, c_acctbal AS x FROM customer""")
def src_manifests(spark, folder):
    """Customers as manifests of two documents each, read back as groups."""
    text = F.format_string(
        "apiVersion: v1alpha1\nkind: ProcessGroup\nmetadata:\n  name: \"%s\"\nspec:\n  forProvider:\n"
        "    parentGroupId: group %d\n    name: \"%s\"\n    comments: %s\n    position:\n"
        "      \"x\": %s\n      \"y\": 0.5\n---\napiVersion: v1alpha1\nkind: Processor\nmetadata:\n  name: p\n",
        "c_name", "c_nationkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string"),
    )
    texts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), text.alias("text")
    )
    documents = readers.parse_manifests(texts, "id", "text")
    found = readers.manifest_resources(documents, "ProcessGroup")
    spec = "resource.spec.forProvider"
    return found.select(
        "source",
        "position",
        F.col("resource.metadata.name").alias("name"),
        F.col(f"{spec}.parentGroupId").alias("parent"),
        F.col(f"{spec}.comments").alias("comments"),
        F.col(f"{spec}.position.x").alias("x"),
    )


_MANIFESTS_SQL = """
WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS source, 'ns' || c_nationkey % 5 AS ns FROM customer),
d AS (SELECT source, 0 AS position, 'ProcessGroup' AS kind, ns AS namespace, c_mktsegment AS name, 'ProviderConfig' AS rk, 'c' || c_custkey % 50 AS rn FROM c
  UNION ALL SELECT source, 1, 'ProviderConfig', ns, 'c' || c_custkey % 45, NULL, NULL FROM c
  UNION ALL SELECT source, 2, 'Processor', '', 'p' || c_custkey % 1000, 'ClusterProviderConfig', 'default' FROM c)
"""


def customer_documents(spark, folder):
    """Every customer as the decoded documents of a group, a config and a processor, many of them named alike."""
    key, space = F.col("c_custkey"), tag("ns", F.col("c_nationkey") % 5)

    def document(kind, name, namespace, config=None):
        spec = F.struct(F.struct(F.lit("ProviderConfig").alias("kind"), config.alias("name")).alias("providerConfigRef")) if config is not None else F.lit(None)
        return F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(name.alias("name"), namespace.alias("namespace")).alias("metadata"), spec.alias("spec")))

    documents = F.array(
        document("ProcessGroup", F.col("c_mktsegment"), space, tag("c", key % 50)),
        document("ProviderConfig", tag("c", key % 45), space),
        document("Processor", tag("p", key % 1000), F.lit(None).cast("string")),
    )
    return table(spark, folder, "customer").select(key.cast("string").alias("source"), F.posexplode(documents).alias("position", "document"))


@query("manifest_duplicates", f"""{_MANIFESTS_SQL}
SELECT kind, namespace, name, count(*) AS documents, min(source) AS source, CAST(min(position) AS INTEGER) AS position
FROM d GROUP BY kind, namespace, name HAVING count(*) > 1""")
def manifest_duplicates(spark, folder):
    return readers.manifest_duplicates(customer_documents(spark, folder))


@query("lost_configs", f"""{_MANIFESTS_SQL},
u AS (SELECT rk AS kind, CASE WHEN rk = 'ProviderConfig' THEN namespace ELSE '' END AS namespace, rn AS name, source, position FROM d WHERE rk IS NOT NULL)
SELECT kind, namespace, name, count(*) AS documents, min(source) AS source, CAST(arg_min(position, source) AS INTEGER) AS position
FROM u WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.kind = u.kind AND d.namespace = u.namespace AND d.name = u.name) GROUP BY kind, namespace, name""")
def lost_configs(spark, folder):
    return readers.lost_configs(customer_documents(spark, folder))


@query("src_observed", f"""
WITH {EVENTS_SQL}
SELECT event_id, CASE WHEN k % 10 NOT IN (1, 2) THEN 'u' || user_id END AS id,
       CASE WHEN k % 10 NOT IN (1, 2) AND k % 4 <> 0 THEN k ELSE event_id END AS revision,
       CASE WHEN k % 10 NOT IN (1, 2) THEN event_type END AS run_state,
       CASE WHEN k % 10 NOT IN (1, 2) THEN 'VALID' END AS validation_status,
       CASE k % 10 WHEN 1 THEN 'cannot decode entity' WHEN 2 THEN 'entity has no status' END AS error
FROM ev""")
def src_observed(spark, folder):
    """Entity documents, some without a revision, without a status, or cut short."""
    k = F.col("k")
    entity = F.to_json(
        F.struct(
            tag("u", "user_id").alias("id"),
            F.when(k % 4 != 0, F.struct(k.alias("version"))).alias("revision"),
            F.when(k % 10 != 2, F.struct(F.col("event_type").alias("runStatus"))).alias("status"),
            F.struct(F.lit("n").alias("name"), F.lit("VALID").alias("validationStatus")).alias("component"),
        )
    )
    text = F.when(k % 10 == 1, F.substring(entity, 1, 12)).otherwise(entity)
    rows = events(spark, folder).select(
        "event_id", text.alias("entity"), F.col("event_id").alias("prior_revision")
    )
    return readers.project_observed(rows, "Processor").select(
        "event_id", "id", "revision", "run_state", "validation_status", "error"
    )


@query("src_observed_flow", f"""
WITH {EVENTS_SQL}
SELECT event_id, CAST(CASE WHEN k % 4 = 0 THEN k ELSE -1 END AS INTEGER) AS current_version,
       CASE k % 4 WHEN 3 THEN true ELSE event_type = 'error' END AS stale FROM ev""")
def src_observed_flow(spark, folder):
    """Flow entities: version as number, as text, or no version information at all."""
    k = F.col("k")
    state = F.when(F.col("event_type") == "error", "STALE").otherwise("UP_TO_DATE")
    version = (
        F.when(k % 4 == 0, k.cast("string"))
        .when(k % 4 == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
        .otherwise("null")
    )
    info = F.concat(
        F.lit('{"id":"f","versionControlInformation":{"version":'), version, F.lit(',"state":"'), state, F.lit('"}}')
    )
    rows = events(spark, folder).select(
        "event_id",
        F.when(k % 4 == 3, F.lit('{"id":"f"}')).otherwise(info).alias("entity"),
        F.lit(-1).alias("prior_current_version"),
        F.lit(True).alias("prior_stale"),
    )
    return readers.project_observed(rows, "RegistryFlow").select("event_id", "current_version", "stale")


@query("src_generate", """
WITH g AS (SELECT c_custkey, 1 + c_nationkey % 5 AS p, 1 + c_nationkey % 3 AS b FROM customer),
n AS (SELECT *, unnest(range(CAST(ceil(20.0 / p) * b AS BIGINT))) AS s FROM g)
SELECT c_custkey AS generator_id, s AS sequence, (s // b) * p * 1000 AS offset_ms, CAST(1024 AS INTEGER) AS size FROM n""")
def src_generate(spark, folder):
    """Every customer as a generator with its own period and batch size, for 20 seconds."""
    nation = F.col("c_nationkey")
    generators = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("generator_id"),
        F.concat((1 + nation % 5).cast("string"), F.lit(" sec")).alias("period"),
        (1 + nation % 3).alias("batch_size"),
        F.lit("1 KB").alias("record_size"),
    )
    made = generate.generate_records(generators, 20_000)
    return made.select("generator_id", "sequence", "offset_ms", F.length("content").alias("size"))


@query("hash_flow", """
SELECT doc_id, sha256(text) AS content_hash, 'hash-to-log' AS connection_id, 'log' AS destination_id FROM documents""")
def hash_flow(spark, folder):
    """The example flow over all documents: hash the content, log on success."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return dataflow.hash_flow(texts, "text").select(
        "doc_id", "content_hash", "connection_id", "destination_id"
    )


@query("sink_log", """
SELECT doc_id, 'info' AS level, '{"content.hash":"' || sha256(text) || '"}' AS attributes, text AS payload FROM documents""")
def sink_log(spark, folder):
    path = scratch_path(spark, "log")
    texts = table(spark, folder, "documents").select("doc_id", "text")
    hashed = dataflow.hash_content(texts, "text").drop("relationship")
    sinks.write_log(hashed, path, "info", payload="text")
    return spark.read.parquet(path)


@query("sink_log_no_payload", """
SELECT event_id, 'warn' AS level, '{"type":"' || event_type || '"}' AS attributes, CAST(NULL AS VARCHAR) AS payload FROM events""")
def sink_log_no_payload(spark, folder):
    path = scratch_path(spark, "log")
    rows = events(spark, folder).select(
        "event_id", F.create_map(F.lit("type"), F.col("event_type")).alias("attributes")
    )
    sinks.write_log(rows, path, "warn")
    return spark.read.parquet(path)


@query("log_levels", f"""
WITH {EVENTS_SQL}
SELECT level, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'debug' END AS level FROM ev) GROUP BY 1""")
def log_levels(spark, folder):
    """Log lines of two levels out of one table, counted."""
    rows = events(spark, folder).withColumn("attributes", F.create_map(F.lit("t"), "event_type"))
    bad = F.col("event_type") == "error"
    lines = dataflow.log_lines(rows.where(bad), "error").unionByName(
        dataflow.log_lines(rows.where(~bad), "debug")
    )
    return lines.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
