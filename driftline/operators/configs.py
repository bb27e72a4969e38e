"""Configuration records, the references to them and their use counts.

Config tables are usually small but never assumed to be: no join here is forced to
broadcast. Spark broadcasts a side below its size threshold, measured again at run
time; beyond it the joins shuffle, and a config that a third of all resources use
is split by the adaptive skew join, since the resources are the outer side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.operators.changes import latest_revision

# Messages of a failed config lookup.
MISSING_SCOPED = "cannot get ProviderConfig"
MISSING_CLUSTER = "cannot get ClusterProviderConfig"
UNSUPPORTED_KIND = "unsupported provider config kind: "


def resolve_config(resources: DataFrame, scoped: DataFrame, cluster: DataFrame) -> DataFrame:
    """Add ``config`` and ``config_error`` to each resource.

    ``resources`` has ``namespace`` and ``providerConfigRef``; ``scoped`` has
    ``namespace``, ``name``, ``config``; ``cluster`` has ``name``, ``config``. The kind
    of the reference decides which table is asked.
    """
    kind = F.col("providerConfigRef.kind")
    is_scoped, is_cluster = kind == S.SCOPED_CONFIG_KIND, kind == S.DEFAULT_CONFIG_KIND
    # Both scopes as one table, so that one join asks it and no row waits with a null key.
    known = scoped.select(
        F.lit(S.SCOPED_CONFIG_KIND).alias("_kind"), F.col("namespace").alias("_ns"),
        F.col("name").alias("_name"), F.struct("config").alias("_found"),
    ).unionByName(
        cluster.select(
            F.lit(S.DEFAULT_CONFIG_KIND).alias("_kind"), F.lit("").alias("_ns"),
            F.col("name").alias("_name"), F.struct("config").alias("_found"),
        )
    )
    asked = resources.withColumns(
        {
            "_kind": kind,
            "_ns": F.when(is_scoped, F.col("namespace")).otherwise(""),
            "_name": F.col("providerConfigRef.name"),
        }
    )
    lost = F.col("_found").isNull()
    error = (
        F.when(is_scoped & lost, F.lit(MISSING_SCOPED))
        .when(is_cluster & lost, F.lit(MISSING_CLUSTER))
        .when(
            ~F.coalesce(is_scoped | is_cluster, F.lit(False)),
            F.concat(F.lit(UNSUPPORTED_KIND), F.coalesce(kind, F.lit(""))),
        )
    )
    return (
        asked.join(known, ["_kind", "_ns", "_name"], "left")
        .withColumn("config", F.col("_found.config"))
        .withColumn("config_error", error)
        .drop("_kind", "_ns", "_name", "_found")
    )


def usage_edges(resources: DataFrame, newest: str | None = None) -> DataFrame:
    """One usage record per resource: the config it refers to, found or not.

    ``resources`` has ``apiVersion``, ``kind``, ``name``, ``namespace``, ``uid`` and
    ``providerConfigRef``. Every usage is of the namespaced usage type, also of a
    cluster config. A resource is told by its uid, without one by type, kind, namespace and name. Of
    several rows the greatest by the column ``newest`` counts, then the greatest reference.
    """
    name = F.struct("apiVersion", "kind", "namespace", "name")
    rows = resources.select(
        F.struct("uid", F.when(F.col("uid").isNull(), name).alias("name")).alias("_who"),
        (F.lit(0) if newest is None else F.col(newest)).alias("_newest"),
        "providerConfigRef",
        "namespace",
        F.struct("apiVersion", "kind", "name", "uid").alias("resourceRef"),
    )
    ties = ["providerConfigRef", "namespace", "resourceRef"]
    return latest_revision(rows, ["_who"], "_newest", ties).select("namespace", "providerConfigRef", "resourceRef")


def config_users(configs: DataFrame, usages: DataFrame) -> DataFrame:
    """Users of each config of both scopes, 0 where nobody uses it.

    ``configs`` has ``kind``, ``name`` and, for the namespaced scope, ``namespace``.
    Usages are counted per config before the join, so the join sees one row per config.
    """
    config_ns = F.when(F.col("kind") == S.SCOPED_CONFIG_KIND, F.col("namespace"))
    used_kind = F.col("providerConfigRef.kind")
    counted = (
        usages.select(
            used_kind.alias("kind"),
            F.col("providerConfigRef.name").alias("name"),
            F.when(used_kind == S.SCOPED_CONFIG_KIND, F.col("namespace")).alias("_ns"),
        )
        .groupBy("kind", "name", "_ns")
        .agg(F.count(F.lit(1)).alias("_users"))
    )
    left = configs.withColumn("_cns", config_ns).alias("c")
    right = counted.alias("u")
    same = (
        (F.col("c.kind") == F.col("u.kind"))
        & (F.col("c.name") == F.col("u.name"))
        & F.col("c._cns").eqNullSafe(F.col("u._ns"))
    )
    return left.join(right, same, "left").select(
        "c.kind",
        "c.namespace",
        "c.name",
        F.coalesce("u._users", F.lit(0)).alias("users"),
        (F.coalesce("u._users", F.lit(0)) > 0).alias("in_use"),
    )


def config_columns(configs: DataFrame, as_of: Column) -> DataFrame:
    """List view of configs: name, age in seconds at ``as_of`` and secret name."""
    return configs.select(
        F.col("metadata.name").alias("name"),
        F.timestamp_diff("SECOND", F.col("metadata.creationTimestamp"), as_of).alias("age_seconds"),
        F.col("credentials.secretRef.name").alias("secret_name"),
    )


def usage_columns(usages: DataFrame) -> DataFrame:
    """List view of usages: config name, kind and name of the resource."""
    return usages.select(
        F.col("providerConfigRef.name").alias("config_name"),
        F.col("resourceRef.kind").alias("resource_kind"),
        F.col("resourceRef.name").alias("resource_name"),
    )
