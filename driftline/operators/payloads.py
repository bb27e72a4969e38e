"""Declared parameters as the record that is sent to the remote system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import scalars as X
from driftline.functions.compare import list_size


def _fields(record: Column, *names: str) -> list[Column]:
    return [record[n].alias(n) for n in names]


def _none_if_empty(items: Column, built: Column) -> Column:
    return F.when(list_size(items) > 0, built)


def _processor(d: Column) -> list[Column]:
    c = d["config"]
    config = F.struct(
        X.drop_null_props(c["properties"]).alias("properties"),
        *_fields(
            c, "autoTerminatedRelationships", "schedulingStrategy", "schedulingPeriod",
            "concurrentlySchedulableTaskCount", "penaltyDuration", "yieldDuration",
            "bulletinLevel", "comments",
        ),
    )
    return [
        *_fields(d, "type", "name", "parentGroupId", "position"),
        F.when(c.isNotNull(), config).alias("config"),
    ]


def _connection(d: Column) -> list[Column]:
    # Ends and bends have the fields of the wire record already.
    return [
        *_fields(
            d, "source", "destination", "parentGroupId", "selectedRelationships", "name", "flowFileExpiration",
            "backPressureObjectThreshold", "backPressureDataSizeThreshold", "loadBalanceStrategy",
            "loadBalancePartitionAttribute", "loadBalanceCompression", "labelIndex", "prioritizers",
        ),
        _none_if_empty(d["bends"], d["bends"]).alias("bends"),
    ]


def _service(d: Column) -> list[Column]:
    return [
        *_fields(d, "type", "name", "comments", "parentGroupId"),
        X.drop_null_props(d["properties"]).alias("properties"),
    ]


def _group(d: Column) -> list[Column]:
    context = F.nullif(d["parameterContextId"], F.lit(""))
    return [
        *_fields(d, "name", "comments", "position"),
        F.when(context.isNotNull(), F.struct(context.alias("id"))).alias("parameterContext"),
    ]


def _context(d: Column) -> list[Column]:
    entry = lambda p: F.struct(
        F.struct(
            p["name"].alias("name"),
            F.coalesce(p["description"], F.lit("")).alias("description"),
            F.coalesce(p["sensitive"], F.lit(False)).alias("sensitive"),
            p["value"].alias("value"),
        ).alias("parameter")
    )
    reference = lambda i: F.struct(i.alias("id"))
    parents = d["inheritedParameterContexts"]
    return [
        *_fields(d, "name", "description"),
        _none_if_empty(d["parameters"], F.transform(d["parameters"], entry)).alias("parameters"),
        _none_if_empty(parents, F.transform(parents, reference)).alias(
            "inheritedParameterContexts"
        ),
    ]


def _import(d: Column) -> list[Column]:
    version = F.coalesce(d["flowVersion"], F.lit(0))
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    control = F.struct(
        *_fields(d, "registryId", "bucketId", "flowId"),
        F.when(version <= 0, F.lit(-1)).otherwise(version).alias("version"),
    )
    return [
        F.coalesce(d["position"], origin).alias("position"),
        control.alias("versionControlInformation"),
    ]


_BUILDERS = {
    "Processor": _processor,
    "Connection": _connection,
    "ControllerService": _service,
    "ProcessGroup": _group,
    "ParameterContext": _context,
    "RegistryFlow": _import,
}


def build_payload(df: DataFrame, kind: str, desired: str = "desired") -> DataFrame:
    """Add ``payload``, the create record of ``kind`` at revision 0.

    Null fields are absent fields; ``to_json`` leaves them out.
    """
    component = F.struct(*_BUILDERS[kind](F.col(desired)))
    revision = F.struct(F.lit(0).cast("bigint").alias("version"))
    return df.withColumn(
        "payload", F.struct(component.alias("component"), revision.alias("revision"))
    )


def build_import(df: DataFrame, desired: str = "desired") -> DataFrame:
    """The import record of a versioned flow; a version of 0 or less asks for the latest."""
    return build_payload(df, "RegistryFlow", desired)


def update_payload(df: DataFrame, external_name: str, revision: str) -> DataFrame:
    """Turn the create record in ``payload`` into an update of an existing record."""
    key = F.col(external_name)
    return df.withColumn(
        "payload",
        F.col("payload")
        .withField("id", key)
        .withField("component.id", key)
        .withField("revision.version", F.col(revision)),
    )


def bound_groups(df: DataFrame, observed: str = "observed", prior: str = "prior_bound") -> DataFrame:
    """Add ``bound_groups``: ids of the bound groups; no list leaves the prior ids."""
    listed = F.col(observed)["component"]["boundProcessGroups"]
    return df.withColumn(
        "bound_groups", F.coalesce(F.transform(listed, lambda g: g["id"]), F.col(prior))
    )


def default_refs(df: DataFrame) -> DataFrame:
    """Fill config reference, management policies, system version and parent group.

    Works on whichever of ``providerConfigRef``, ``managementPolicies``,
    ``systemVersion``, ``parentGroupId`` and ``providerConfigRefName`` are columns.
    """
    defaults = {
        "providerConfigRef": F.struct(
            F.lit(S.DEFAULT_CONFIG_KIND).alias("kind"), F.lit(S.DEFAULT_CONFIG_NAME).alias("name")
        ),
        "managementPolicies": F.array(*[F.lit(p) for p in S.DEFAULT_POLICIES]),
        "systemVersion": F.lit(S.DEFAULT_SYSTEM_VERSION),
        "parentGroupId": F.lit(S.ROOT_GROUP),
        "providerConfigRefName": F.lit(S.DEFAULT_CONFIG_NAME),
    }
    return df.withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in df.columns}
    )
