"""Reading resource dumps, manifests and entities of the remote system."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import scalars as X
from driftline.functions.unnest import unnest
from driftline.kinds import KINDS


def list_schema(kind: str, version_field: str | None = None) -> str:
    return f"apiVersion STRING, kind STRING, items ARRAY<STRUCT<{S.resource_schema(kind, version_field)}>>"


def read_lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """List dumps below ``path``, one JSON document per file. A dump is not splittable:
    page it over many files."""
    return spark.read.schema(list_schema(kind)).json(path, multiLine=True)


def parse_lists(texts: DataFrame, column: str, kind: str) -> DataFrame:
    """List dumps held in a text column, one document per row."""
    keep = [c for c in texts.columns if c != column]
    parsed = texts.withColumn("_list", F.from_json(column, list_schema(kind)))
    return parsed.select(*keep, "_list.items")


def list_items(lists: DataFrame) -> DataFrame:
    """One row per resource of each list, with its position in the list."""
    keep = [c for c in lists.columns if c != "items"]
    return unnest(lists, keep, "items", "resource", "position")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """YAML texts of a batch as JSON documents, one row per document."""
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def plain(value):
        if isinstance(value, datetime.datetime | datetime.date):
            return value.isoformat()
        return str(value)

    for batch in batches:
        rows = []
        for source, text in zip(batch["source"], batch["text"], strict=True):
            position = 0
            if str(source).endswith(".json"):
                # One document as it is.
                rows.append((source, position, text, None))
                continue
            try:
                for document in yaml.load_all(text, Loader=loader):
                    if document is not None:
                        rows.append((source, position, json.dumps(document, default=plain), None))
                        position += 1
            except (yaml.YAMLError, TypeError, ValueError, RecursionError) as error:
                # Also what YAML can say and JSON cannot, such as a date as a key.
                rows.append((source, position, None, f"{error}".splitlines()[0] if f"{error}" else type(error).__name__))
        yield pd.DataFrame(rows, columns=["source", "position", "document", "error"])


def parse_manifests(texts: DataFrame, source: str, text: str) -> DataFrame:
    """Documents of multi-document YAML texts: source, position, JSON document, error.

    Decoding YAML is the only Python step; it runs per partition on Arrow batches. A
    text that breaks off, or that JSON cannot say, keeps its documents before the fault and adds
    an error row. A source that ends in ``.json`` is one document as it stands.
    """
    return texts.select(
        F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    ).mapInPandas(_documents, "source string, position int, document string, error string")


def manifest_resources(
    documents: DataFrame, kind: str, column: str = "document", version_field: str | None = None
) -> DataFrame:
    """Documents of one kind as rows with the schema of the kind.

    ``version_field`` is the name under which a config states the system version; for
    configs it has to be given.
    """
    is_kind = F.get_json_object(column, "$.kind") == kind
    keep = [c for c in documents.columns if c != column]
    read = F.from_json(column, S.resource_schema(kind, version_field))
    # The cast goes by position, so it only renames the version field.
    resource = read.cast(f"struct<{S.resource_schema(kind, version_field and S.VERSION_FIELD)}>")
    return documents.where(is_kind).select(*keep, resource.alias("resource"))


def manifest_heads(documents: DataFrame) -> DataFrame:
    """kind, namespace, name, source, position, config_kind, config_name of the documents that have a kind and a name.

    No namespace is the empty text, and so is that of a cluster's config. The config is what the document
    refers to, or the default where it names none; only the six kinds refer to one. Documents that could not be decoded have no row.
    """
    said = lambda path: F.get_json_object("document", f"$.{path}")
    heads = documents.select(
        said("kind").alias("kind"), F.coalesce(said("metadata.namespace"), F.lit("")).alias("namespace"), said("metadata.name").alias("name"), "source", "position",
        F.coalesce(said("spec.providerConfigRef.kind"), F.lit(S.DEFAULT_CONFIG_KIND)).alias("config_kind"),
        F.coalesce(said("spec.providerConfigRef.name"), F.lit(S.DEFAULT_CONFIG_NAME)).alias("config_name"),
    ).where("kind IS NOT NULL AND name IS NOT NULL")
    refers = F.col("kind").isin(*KINDS)
    return heads.withColumn("namespace", _scope(F.col("kind"))).withColumns(
        {c: F.when(refers, F.col(c)) for c in ("config_kind", "config_name")}
    )


def _scope(kind: Column) -> Column:
    return F.when(kind == "ClusterProviderConfig", F.lit("")).otherwise(F.col("namespace"))


def _first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``documents``, and source and position of the first; counted inside each task before the shuffle."""
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("source", "position")).alias("_first"))
    return grouped.select(*keys, "documents", "_first.source", "_first.position")


def manifest_duplicates(documents: DataFrame) -> DataFrame:
    """Resources that several documents declare: kind, namespace, name, ``documents``, source and position of the first."""
    return _first_of(manifest_heads(documents), ["kind", "namespace", "name"]).where("documents > 1")


def lost_configs(documents: DataFrame) -> DataFrame:
    """Configs that documents refer to and none declares: kind, namespace, name, ``documents``, source and position of the first.

    References are counted per config before they meet the declared ones, so a config that
    most documents use is one row by then.
    """
    heads = manifest_heads(documents)
    used = heads.where("config_kind IS NOT NULL").select(
        F.col("config_kind").alias("kind"), _scope(F.col("config_kind")).alias("namespace"), F.col("config_name").alias("name"), "source", "position"
    )
    keys = ["kind", "namespace", "name"]
    declared = heads.where(F.col("kind").isin(*S.CONFIG_KINDS)).select(*keys).distinct()
    return _first_of(used, keys).join(declared, keys, "left_anti")


def read_manifests(
    spark: SparkSession, path: str, kind: str, version_field: str | None = None
) -> DataFrame:
    """Desired resources of ``kind`` from the YAML or JSON files below ``path``.

    JSON files hold one document each. Every file is read once.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return manifest_resources(parse_manifests(files, "source", "text"), kind, version_field=version_field)


def _flow_fields(entity: Column, prior: dict[str, Column]) -> dict[str, Column]:
    control = entity["versionControlInformation"]
    return {
        "current_version": X.number_to_int(control["version"], prior["current_version"]),
        "stale": F.when(control.isNotNull(), X.is_stale(control["state"])).otherwise(prior["stale"]),
    }


def project_observed(entities: DataFrame, kind: str, column: str = "entity") -> DataFrame:
    """Status of each resource from its entity document.

    Adds the decoded ``observed`` struct, ``id``, ``revision`` and the state fields of
    the kind. A revision (and, for flows, a version) the entity does not state keeps
    the value of the ``prior_*`` column. Text that does not decode, and a processor
    without a status, give an ``error`` and no observed record.
    """
    schema = f"{S.ENTITY[kind]}, _undecoded STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_undecoded"}
    read = entities.withColumn("_read", F.from_json(column, schema, options))
    entity = F.col("_read")
    fault = F.when(
        F.col(column).isNotNull() & (entity.isNull() | entity["_undecoded"].isNotNull()),
        F.lit("cannot decode entity"),
    )
    if kind == "Processor":
        fault = F.coalesce(
            fault,
            F.when(entity.isNotNull() & entity["status"].isNull(), F.lit("entity has no status")),
        )
    read = read.withColumn("error", fault).withColumn(
        "observed", F.when(F.col("error").isNull(), entity.dropFields("_undecoded"))
    )
    o = F.col("observed")
    prior = {
        n: F.col(f"prior_{n}") if f"prior_{n}" in entities.columns else F.lit(None).cast(t)
        for n, t in (("revision", "bigint"), ("current_version", "int"), ("stale", "boolean"))
    }
    fields = {"id": o["id"], "revision": F.coalesce(o["revision"]["version"], prior["revision"])}
    if kind == "Processor":
        fields["run_state"] = o["status"]["runStatus"]
    if kind == "ControllerService":
        fields["run_state"] = o["component"]["state"]
    if kind in ("Processor", "ControllerService"):
        fields["validation_status"] = o["component"]["validationStatus"]
        fields["validation_errors"] = o["component"]["validationErrors"]
    if kind == "ProcessGroup":
        for n in ("running", "stopped", "disabled", "invalid"):
            fields[f"{n}_count"] = o[f"{n}Count"]
    if kind == "RegistryFlow":
        fields |= _flow_fields(o, prior)
    return read.withColumns(fields).drop("_read")
