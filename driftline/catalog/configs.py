"""Queries on configuration records: nations and regions are the two scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import ORACLE, events, joined, pick, query, table, tag
from driftline.functions import scalars as X
from driftline.operators import configs as K
from driftline.operators import extensions, observe as O, subtrees
from driftline.operators.payloads import bound_groups as take_bound
from driftline.operators.payloads import default_refs as fill_refs
from driftline.operators.validation import config_violations

REF_SQL = """
rf AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey,
  'region-' || ((c_nationkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) % 5) AS namespace,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ProviderConfig' WHEN 'HOUSEHOLD' THEN 'SecretStore'
       ELSE 'ClusterProviderConfig' END AS ref_kind,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'NATION_' || c_nationkey WHEN 'AUTOMOBILE' THEN 'default'
       ELSE 'region-' || (c_nationkey % 7) END AS ref_name
  FROM customer)
"""


def referring(spark, folder):
    """Customers as resources; those of one segment state no config reference."""
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    kind = pick(segment, {"BUILDING": "ProviderConfig", "HOUSEHOLD": "SecretStore"}, "ClusterProviderConfig")
    name = F.when(segment == "BUILDING", tag("NATION_", nation)).otherwise(
        tag("region-", nation % 7)
    )
    shift = F.when(F.col("c_acctbal") < 0, 1).otherwise(0)
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey"),
        tag("region-", (nation + shift) % 5).alias("namespace"),
        F.lit("v1").alias("apiVersion"),
        F.lit("Processor").alias("kind"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").cast("string").alias("uid"),
        F.when(
            segment != "AUTOMOBILE", F.struct(kind.alias("kind"), name.alias("name"))
        ).alias("providerConfigRef"),
        F.when(nation % 2 == 0, F.array(F.lit("Observe"))).alias("managementPolicies"),
        F.when(nation % 3 == 0, F.lit(1)).alias("systemVersion"),
        F.when(nation % 4 == 0, F.lit("group")).alias("parentGroupId"),
    )
    return fill_refs(rows)


def scoped_configs(spark, folder):
    return table(spark, folder, "nation").select(
        tag("region-", "n_regionkey").alias("namespace"),
        F.col("n_name").alias("name"),
        tag("https://nation-", "n_nationkey").alias("config"),
    )


def cluster_configs(spark, folder):
    return table(spark, folder, "region").select(
        tag("region-", "r_regionkey").alias("name"),
        tag("https://", "r_name").alias("config"),
    )


@query("default_refs", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ProviderConfig' WHEN 'HOUSEHOLD' THEN 'SecretStore'
         ELSE 'ClusterProviderConfig' END AS ref_kind,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'NATION_' || c_nationkey WHEN 'AUTOMOBILE' THEN 'default'
         ELSE 'region-' || (c_nationkey % 7) END AS ref_name,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Observe' ELSE '*' END AS policies,
       CAST(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS system_version,
       CASE WHEN c_nationkey % 4 = 0 THEN 'group' ELSE 'root' END AS parent
FROM customer""")
def default_refs(spark, folder):
    return referring(spark, folder).select(
        "c_custkey",
        F.col("providerConfigRef.kind").alias("ref_kind"),
        F.col("providerConfigRef.name").alias("ref_name"),
        joined(F.col("managementPolicies")).alias("policies"),
        F.col("systemVersion").alias("system_version"),
        F.col("parentGroupId").alias("parent"),
    )


@query("resolve_config", f"""
WITH {REF_SQL}
SELECT c_custkey,
  CASE ref_kind WHEN 'ProviderConfig' THEN 'https://nation-' || n_nationkey
       WHEN 'ClusterProviderConfig' THEN 'https://' || r_name END AS config,
  CASE WHEN ref_kind = 'SecretStore' THEN 'unsupported provider config kind: SecretStore'
       WHEN ref_kind = 'ProviderConfig' AND n_nationkey IS NULL THEN 'cannot get ProviderConfig'
       WHEN ref_kind = 'ClusterProviderConfig' AND r_name IS NULL THEN 'cannot get ClusterProviderConfig' END AS config_error
FROM rf LEFT JOIN nation ON n_name = ref_name AND 'region-' || n_regionkey = namespace
LEFT JOIN region ON 'region-' || r_regionkey = ref_name""")
def resolve_config(spark, folder):
    return K.resolve_config(
        referring(spark, folder), scoped_configs(spark, folder), cluster_configs(spark, folder)
    ).select("c_custkey", "config", "config_error")


@query("usage_edges", f"""
WITH {REF_SQL}
SELECT namespace, ref_kind, ref_name, 'Processor' AS kind, c_name AS name, CAST(c_custkey AS VARCHAR) AS uid
FROM rf JOIN customer USING (c_custkey)""")
def usage_edges(spark, folder):
    """Edges recorded at two connects of every resource; each resource has one."""
    twice = referring(spark, folder).unionByName(referring(spark, folder))
    return K.usage_edges(twice).select(
        "namespace",
        F.col("providerConfigRef.kind").alias("ref_kind"),
        F.col("providerConfigRef.name").alias("ref_name"),
        "resourceRef.kind",
        "resourceRef.name",
        "resourceRef.uid",
    )


@query("config_users", f"""
WITH {REF_SQL},
cf AS (SELECT 'ProviderConfig' AS kind, 'region-' || n_regionkey AS namespace, n_name AS name FROM nation
       UNION ALL SELECT 'ClusterProviderConfig', NULL, 'region-' || r_regionkey FROM region)
SELECT cf.kind, cf.namespace, cf.name, count(rf.c_custkey) AS users, count(rf.c_custkey) > 0 AS in_use
FROM cf LEFT JOIN rf ON rf.ref_kind = cf.kind AND rf.ref_name = cf.name
     AND (cf.kind <> 'ProviderConfig' OR rf.namespace = cf.namespace)
GROUP BY ALL""")
def config_users(spark, folder):
    configs = (
        scoped_configs(spark, folder)
        .select(F.lit("ProviderConfig").alias("kind"), "namespace", "name")
        .unionByName(
            cluster_configs(spark, folder).select(
                F.lit("ClusterProviderConfig").alias("kind"),
                F.lit(None).cast("string").alias("namespace"),
                "name",
            )
        )
    )
    return K.config_users(configs, K.usage_edges(referring(spark, folder)))


@query("config_columns", """
SELECT CAST(o_orderkey AS VARCHAR) AS name,
       CAST(floor((epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(o_orderdate)) / 1000000) AS BIGINT) AS age_seconds,
       CASE WHEN o_orderstatus <> 'P' THEN 'secret-' || o_custkey END AS secret_name
FROM orders""")
def config_columns(spark, folder):
    """Orders as config records, those of one status without a secret."""
    secret = F.when(
        F.col("o_orderstatus") != "P",
        F.struct(tag("secret-", "o_custkey").alias("name")),
    )
    rows = table(spark, folder, "orders").select(
        F.struct(
            F.col("o_orderkey").cast("string").alias("name"),
            F.col("o_orderdate").alias("creationTimestamp"),
        ).alias("metadata"),
        F.struct(secret.alias("secretRef")).alias("credentials"),
    )
    return K.config_columns(rows, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))


@query("usage_columns", f"""
WITH {REF_SQL}
SELECT ref_name AS config_name, 'Processor' AS resource_kind, c_name AS resource_name
FROM rf JOIN customer USING (c_custkey)""")
def usage_columns(spark, folder):
    return K.usage_columns(K.usage_edges(referring(spark, folder)))


@query("policy_allows", """
SELECT c_custkey, c_nationkey % 2 = 1 OR c_mktsegment = 'BUILDING' AS allowed FROM customer""")
def policy_allows(spark, folder):
    """Even nations permit one action only, odd ones state no policies."""
    policies = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("Observe"), F.lit("Update")))
    action = pick(F.col("c_mktsegment"), {"BUILDING": "Update", "MACHINERY": "Delete"}, "Create")
    return table(spark, folder, "customer").select(
        "c_custkey", X.policy_allows(policies, action).alias("allowed")
    )


@query("auth_mode", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'TOKEN'
   WHEN c_mktsegment <> 'BUILDING' AND c_nationkey % 2 = 0 THEN 'TOKEN_EXCHANGE' ELSE 'NONE' END AS mode
FROM customer""")
def auth_mode(spark, folder):
    mode = X.auth_mode(
        F.col("c_acctbal") < 0, F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey") % 2 == 0
    )
    return table(spark, folder, "customer").select("c_custkey", mode.alias("mode"))


@query("config_valid", """
SELECT event_id, CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 6
   WHEN 0 THEN NULL WHEN 1 THEN 'url is required' WHEN 2 THEN 'cannot parse credentials'
   WHEN 3 THEN 'cannot parse credentials' WHEN 4 THEN 'url is required' ELSE NULL END AS problem
FROM events""")
def config_valid(spark, folder):
    """Credential documents, some without a URL, cut short or of the wrong type."""
    text = F.concat(F.lit('{"url":"https://host/'), "event_type", F.lit('","username":"u"'))
    document = (
        F.when(F.col("k") % 6 == 0, F.concat(text, F.lit("}")))
        .when(F.col("k") % 6 == 1, F.col("props"))
        .when(F.col("k") % 6 == 2, text)
        .when(F.col("k") % 6 == 3, F.concat(F.lit('{"url":'), F.col("k").cast("string"), F.lit("}")))
        .when(F.col("k") % 6 == 4, F.lit('{"url":"","token":null}'))
        .otherwise(F.concat(text, F.lit(',"tlsSkipVerify":true,"more":[1]}')))
    )
    return events(spark, folder).select("event_id", X.config_problem(document).alias("problem"))


@query("validate_config", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_mktsegment = 'BUILDING' THEN 'credentials.source required' END,
   CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'credentials.source unsupported' END,
   CASE WHEN c_nationkey NOT IN (1, 2) THEN 'systemVersion unsupported' END) AS violations FROM customer""")
def validate_config(spark, folder):
    source = pick(
        F.col("c_mktsegment"),
        {"HOUSEHOLD": "Secret", "AUTOMOBILE": "Environment", "MACHINERY": "Vault", "FURNITURE": "secret"},
    )
    found = config_violations(source, F.col("c_nationkey"))
    return table(spark, folder, "customer").select("c_custkey", joined(found).alias("violations"))


@query("bound_groups", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'prior-' || p_brand
   WHEN p_size % 5 = 1 THEN '' ELSE p_partkey || ',' || (p_partkey + p_size) END AS bound FROM part""")
def bound_groups(spark, folder):
    """Parts as contexts; those without a list keep their prior ids."""
    size = F.col("p_size")
    group = lambda c: F.struct(c.cast("string").alias("id"))
    both = F.array(group(F.col("p_partkey")), group(F.col("p_partkey") + size))
    listed = F.when(size % 5 == 1, F.slice(both, 1, 0)).when(size % 5 != 0, both)
    rows = table(spark, folder, "part").select(
        "p_partkey",
        F.struct(F.struct(listed.alias("boundProcessGroups")).alias("component")).alias("observed"),
        F.array(F.concat(F.lit("prior-"), "p_brand")).alias("prior_bound"),
    )
    return take_bound(rows).select("p_partkey", joined(F.col("bound_groups")).alias("bound"))


@query("context_binding", """
WITH d AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS group_id, CAST(c_custkey - c_nationkey AS VARCHAR) AS context_id
           FROM customer WHERE c_custkey >= c_nationkey),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS group_id, CAST(p_partkey AS VARCHAR) AS context_id FROM part
      UNION SELECT CAST(p_partkey + p_size AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM part)
SELECT coalesce(d.group_id, b.group_id) AS group_id, coalesce(d.context_id, b.context_id) AS context_id,
       d.group_id IS NOT NULL AS declared, b.group_id IS NOT NULL AS bound
FROM d FULL OUTER JOIN b ON d.group_id = b.group_id AND d.context_id = b.context_id""")
def context_binding(spark, folder):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    groups = table(spark, folder, "customer").select(
        key.cast("string").alias("group_id"),
        F.when(key >= nation, (key - nation).cast("string")).otherwise("").alias("context_id"),
    )
    contexts = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("context_id"),
        F.array(
            F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string")
        ).alias("bound_groups"),
    )
    return O.context_binding(groups, contexts)


@query("inherited_params", """
WITH s AS (SELECT 's' || s_suppkey AS context_id, s_nationkey, s_name, CAST(s_acctbal AS VARCHAR) AS bal FROM supplier),
n AS (SELECT n_nationkey, 'n' || n_nationkey AS context_id, n_name, n_regionkey FROM nation),
r AS (SELECT r_regionkey, 'r' || r_regionkey AS context_id, r_name FROM region)
SELECT context_id, 'own' AS name, s_name AS value, false AS inherited FROM s
UNION ALL SELECT s.context_id, 'name', n_name, true FROM s JOIN n ON n_nationkey = s_nationkey
UNION ALL SELECT s.context_id, 'scope', r_name, true FROM s JOIN n ON n_nationkey = s_nationkey JOIN r ON r_regionkey = n_regionkey
UNION ALL SELECT context_id, 'name', n_name, false FROM n
UNION ALL SELECT n.context_id, 'scope', r_name, true FROM n JOIN r ON r_regionkey = n_regionkey
UNION ALL SELECT context_id, 'name', r_name, false FROM r
UNION ALL SELECT context_id, 'scope', r_name, false FROM r""")
def inherited_params(spark, folder):
    """Suppliers inherit from their nation, nations from their region."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    supplier, nation, region = (
        tag(k[0], k) for k in ("s_suppkey", "n_nationkey", "r_regionkey")
    )

    def param(df, context, name, value):
        return df.select(
            context.alias("context_id"), F.lit(name).alias("name"), F.col(value).alias("value")
        )

    own = (
        param(s, supplier, "own", "s_name")
        .unionByName(param(n, nation, "name", "n_name"))
        .unionByName(param(r, region, "name", "r_name"))
        .unionByName(param(r, region, "scope", "r_name"))
    )
    links = s.select(
        supplier.alias("context_id"), tag("n", "s_nationkey").alias("parent_id")
    ).unionByName(
        n.select(nation.alias("context_id"), tag("r", "n_regionkey").alias("parent_id"))
    )
    return extensions.inherited_params(own, links.withColumn("position", F.lit(0)))


@query("group_tree", """
WITH o AS (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT c_custkey, c_nationkey, coalesce(sum(n), 0) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2),
na AS (SELECT n_nationkey, n_regionkey, coalesce(sum(n), 0) AS n FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY 1, 2),
re AS (SELECT r_regionkey, coalesce(sum(n), 0) AS n FROM region LEFT JOIN na ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'o' || o_orderkey AS id, CAST(n AS BIGINT) AS n FROM o UNION ALL SELECT 'c' || c_custkey, CAST(n AS BIGINT) FROM c
UNION ALL SELECT 'n' || n_nationkey, CAST(n AS BIGINT) FROM na UNION ALL SELECT 'r' || r_regionkey, CAST(n AS BIGINT) FROM re
UNION ALL SELECT 'root', CAST(sum(n) AS BIGINT) FROM re""")
def group_tree(spark, folder):
    """root, regions, nations, customers, orders: lines counted at every level."""
    return extensions.group_tree(tree(spark, folder), line_counts(spark, folder))


def tree(spark, folder):
    """root, regions, nations, customers, orders as groups."""

    def level(name, prefix, key, parent):
        return table(spark, folder, name).select(
            tag(prefix, key).alias("id"), parent.alias("parent_id")
        )

    return (
        level("orders", "o", "o_orderkey", tag("c", "o_custkey"))
        .unionByName(level("customer", "c", "c_custkey", tag("n", "c_nationkey")))
        .unionByName(level("nation", "n", "n_nationkey", tag("r", "n_regionkey")))
        .unionByName(level("region", "r", "r_regionkey", F.lit("root")))
        .unionByName(
            table(spark, folder, "region")
            .groupBy(F.lit("root").alias("id"))
            .agg(F.max(F.lit(None).cast("string")).alias("parent_id"))
        )
    )


def line_counts(spark, folder):
    """Lines of every order."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return lines.select(tag("o", "l_orderkey").alias("id"), "n")


@query("subtree_totals", ORACLE["group_tree"].replace("SELECT 'o' || o_orderkey AS id, CAST(n AS BIGINT) AS n", "SELECT 'o' || o_orderkey AS id, CAST(n AS BIGINT) AS total"))
def subtree_totals(spark, folder):
    """The same counts from the numbers of a walk through the tree, as differences of running sums."""
    index = subtrees.subtree_index(tree(spark, folder).withColumnRenamed("parent_id", "parent"))
    return subtrees.subtree_sums(index, line_counts(spark, folder).withColumnRenamed("n", "value"))


@query("subtree_members", """
WITH m AS (SELECT n_regionkey, n_nationkey, c_custkey, o_orderkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey),
i AS (SELECT n_regionkey, n_nationkey, 'o' || o_orderkey AS id FROM m WHERE o_orderkey IS NOT NULL UNION SELECT n_regionkey, n_nationkey, 'c' || c_custkey FROM m WHERE c_custkey IS NOT NULL
 UNION SELECT n_regionkey, n_nationkey, 'n' || n_nationkey FROM m)
SELECT 'n' || n_nationkey AS "group", id FROM i UNION ALL SELECT 'r' || n_regionkey, id FROM i
UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region""")
def subtree_members(spark, folder):
    """What lies below every nation and region."""
    index = subtrees.subtree_index(tree(spark, folder).withColumnRenamed("parent_id", "parent"))
    of = index.where(F.col("id").rlike("^[nr][0-9]"))
    return subtrees.below(index, of)
