"""Readers and writers on files."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from driftline.operators import dataflow
from driftline.operators.conditions import printer_columns
from driftline.operators.configs import config_columns
from driftline.sources import generate, readers, sinks

MANIFEST = """\
apiVersion: v1alpha1
kind: Processor
metadata:
  name: gen
  creationTimestamp: 2024-01-01T00:00:00Z
spec:
  forProvider:
    parentGroupId: "<group>"
    type: Generate
    name: "Generate"
    position: {"x": 100, "y": 200.5}
    config:
      schedulingPeriod: "5 sec"
      concurrentlySchedulableTaskCount: 1
      properties:
        File Size: "1 KB"
        Empty: null
    desiredState: STOPPED
  providerConfigRef: {name: default, kind: ProviderConfig}
---
---
apiVersion: v1
kind: Secret
metadata: {name: s}
---
apiVersion: v1alpha1
kind: ProviderConfig
metadata: {name: default}
spec:
  theVersion: 2
  credentials: {source: Secret, secretRef: {namespace: ns, name: creds, key: credentials}}
"""


@pytest.fixture
def manifests(tmp_path):
    (tmp_path / "a.yaml").write_text(MANIFEST)
    (tmp_path / "b.yaml").write_text("kind: Processor\nmetadata: {name: ok}\n---\nkind: [broken\n")
    (tmp_path / "c.json").write_text(json.dumps({"kind": "Processor", "metadata": {"name": "plain"}}))
    return str(tmp_path)


def test_manifests(spark, manifests):
    rows = {r["resource"]["metadata"]["name"]: r for r in readers.read_manifests(spark, manifests, "Processor").collect()}
    assert set(rows) == {"gen", "ok", "plain"}
    resource = rows["gen"]["resource"]
    wanted = resource["spec"]["forProvider"]
    assert wanted["config"]["properties"] == {"File Size": "1 KB", "Empty": None}
    assert (wanted["position"]["x"], wanted["position"]["y"]) == (100.0, 200.5)
    assert wanted["config"]["concurrentlySchedulableTaskCount"] == 1
    assert resource["metadata"]["creationTimestamp"].year == 2024
    configs = readers.read_manifests(spark, manifests, "ProviderConfig", version_field="theVersion")
    assert configs.first()["resource"]["spec"]["systemVersion"] == 2
    as_of = F.lit("2024-01-01").cast("timestamp")
    shown = config_columns(configs.select("resource.metadata", "resource.spec.credentials"), as_of).first()
    assert (shown["name"], shown["secret_name"]) == ("default", "creds")


def test_broken_manifest_is_reported(spark, manifests):
    texts = spark.read.text(manifests, wholetext=True).select(F.lit("x").alias("id"), "value")
    errors = readers.parse_manifests(texts, "id", "value").where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0]["document"] is None


def test_lists(spark, tmp_path):
    for n in range(3):
        items = [{"kind": "Processor", "metadata": {"name": f"p{n}-{i}"}} for i in range(n)]
        (tmp_path / f"{n}.json").write_text(json.dumps({"kind": "ProcessorList", "items": items}, indent=1))
    got = readers.list_items(readers.read_lists(spark, str(tmp_path), "Processor"))
    assert {(r["position"], r["resource"]["metadata"]["name"]) for r in got.collect()} == {
        (0, "p1-0"), (0, "p2-0"), (1, "p2-1")}
    usage = {"items": [{"providerConfigRef": {"kind": "ProviderConfig", "name": "d"}, "resourceRef": {"kind": "Processor", "name": "p", "uid": "1"}}]}
    (tmp_path / "usages").mkdir()
    (tmp_path / "usages" / "u.json").write_text(json.dumps(usage))
    row = readers.list_items(readers.read_lists(spark, str(tmp_path / "usages"), "ProviderConfigUsage")).first()
    assert row["resource"]["resourceRef"]["uid"] == "1"


def test_status_snapshots(spark, tmp_path):
    path = str(tmp_path / "status")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, rev bigint, t int")
    first = sinks.merge_status(None, rows(("a", 1, 0), ("a", 2, 1), ("b", 5, 0)), ["k"], "rev", ["t"])
    sinks.write_status(first, path, "2024-01-01")
    for _ in range(2):  # writing a day again replaces it
        prior = sinks.read_status(spark, path, "2024-01-01")
        sinks.write_status(sinks.merge_status(prior, rows(("a", 1, 9), ("c", 0, 0)), ["k"], "rev", ["t"]), path, "2024-01-02")
    got = {tuple(r) for r in sinks.read_status(spark, path, "2024-01-02").collect()}
    assert got == {("a", 2, 1), ("b", 5, 0), ("c", 0, 0)}


def test_bucketed_tables_join_without_shuffle(spark):
    from driftline.operators.observe import observe

    rows = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("name"), "id")
    sinks.write_keyed_table(rows, "keyed_desired", "name", 4)
    sinks.write_keyed_table(rows.select("name", F.struct("id").alias("observed")), "keyed_observed", "name", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = observe(spark.table("keyed_desired"), spark.table("keyed_observed"), "name", unique=True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.where("exists").count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE keyed_desired")
        spark.sql("DROP TABLE keyed_observed")


def test_changelog_appends_and_prunes(spark, tmp_path):
    path = str(tmp_path / "log")
    plan = spark.createDataFrame(
        [(1, "UPDATE", ["PUT"]), (2, "NOOP", []), (3, "ERROR", [])], "k int, action string, steps array<string>"
    ).withColumn("error", F.when(F.col("k") == 3, "boom"))
    at = F.lit("2024-01-01").cast("timestamp")
    for kind in ("Connection", "Processor"):
        sinks.write_changelog(sinks.changelog_rows(plan, kind, "k", at, "v1"), path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.where("kind = 'Processor' AND error = 'boom'").count() == 1
    physical = log.where("kind = 'Processor'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(kind", physical)


def test_generate_splits_one_busy_generator(spark):
    df = spark.createDataFrame([("hot", "1 ms", 50, "2 B"), ("cold", "1 sec", 1, "1 KB"), ("none", "5 sec", 0, "1 B")],
                               "generator_id string, period string, batch_size int, record_size string")
    made = generate.generate_records(df, 2001)
    got = {r["generator_id"]: r for r in made.groupBy("generator_id").agg(
        F.count("*").alias("n"), F.countDistinct("sequence").alias("d"), F.max("sequence").alias("m"),
        F.max("offset_ms").alias("o"), F.max(F.length("content")).alias("s")).collect()}
    assert (got["hot"]["n"], got["hot"]["d"], got["hot"]["m"], got["hot"]["o"], got["hot"]["s"]) == (100050, 100050, 100049, 2000, 2)
    assert (got["cold"]["n"], got["cold"]["o"], got["cold"]["s"]) == (3, 2000, 1024)
    assert set(got) == {"hot", "cold"}
    spread = made.where("generator_id = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert spread > 1


def test_log_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": "b"}, b"xyz")], "id int, attributes map<string,string>, content binary")
    sinks.write_log(df, str(tmp_path / "log"), "info", payload="content")
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert (row["level"], row["attributes"], row["payload"]) == ("info", '{"a":"b"}', "xyz")
    with pytest.raises(ValueError):
        dataflow.log_lines(df, "loud")


def test_printer_columns_without_conditions(spark):
    df = spark.sql("""SELECT named_struct('name', 'n', 'annotations', map('x/external-name', 'e'),
        'creationTimestamp', TIMESTAMP '2024-01-01 00:00:00') AS metadata,
        CAST(NULL AS ARRAY<STRUCT<type: STRING, status: STRING>>) AS conditions""")
    row = printer_columns(df, F.expr("TIMESTAMP '2024-01-01 00:01:30'")).first()
    assert tuple(row) == ("n", None, None, "e", 90)


def test_what_json_cannot_say_is_an_error_row(spark):
    texts = spark.createDataFrame([("a", "kind: X\n---\n2024-01-01: y\n"), ("b", "kind: Y\n")], "source string, text string")
    got = {(r["source"], r["position"]): (r["document"], r["error"]) for r in readers.parse_manifests(texts, "source", "text").collect()}
    assert got["a", 0] == ('{"kind": "X"}', None) and got["b", 0] == ('{"kind": "Y"}', None)
    assert got["a", 1][0] is None and got["a", 1][1]


def test_status_and_selectors_are_read(spark):
    import json

    doc = {"kind": "Processor", "metadata": {"name": "p"}, "status": {"atProvider": {"id": "i", "version": 4, "runStatus": "Running"}}}
    config = {"kind": "ProviderConfig", "spec": {"credentials": {"source": "Environment", "env": {"name": "E"}, "fs": {"path": "/p"}}, "theVersion": 1}}
    rows = spark.createDataFrame([(json.dumps(doc),), (json.dumps(config),)], "document string")
    status = readers.manifest_resources(rows, "Processor").select("resource.status.atProvider.*").collect()
    assert [(r["id"], r["version"], r["runStatus"]) for r in status] == [("i", 4, "Running")]
    found = readers.manifest_resources(rows, "ProviderConfig", version_field="theVersion").select("resource.spec.*").collect()
    assert [(r["credentials"]["env"]["name"], r["credentials"]["fs"]["path"], r["systemVersion"]) for r in found] == [("E", "/p", 1)]
    with pytest.raises(ValueError):
        readers.manifest_resources(rows, "ProviderConfig")
