"""Snapshot differences by digests, and status tables that are upserted bucket by bucket."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.sources import sinks, snapshots

SCHEMA = "k bigint, a string, b double"


def write(spark, path, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    snapshots.write_snapshot(df, path, ["k"], **options)
    return df.schema


def changes(df):
    return {(r["k"], r["a"], r["b"]): r["change"] for r in df.collect()}


def test_differences_with_multiplicities(spark, tmp_path):
    old = [(i, f"a{i}", float(i)) for i in range(300)] + [(7, "twice", 1.0)] * 2 + [(None, None, None), (None, "", None)]
    new = [r for r in old if r[0] not in (3, 150)] + [(3, "changed", 3.0), (400, "new", None)] + [(7, "twice", 1.0)] * 2 + [(None, "", None)]
    one, two = str(tmp_path / "old"), str(tmp_path / "new")
    schema = write(spark, one, old)
    write(spark, two, new)
    want = Counter(new)
    want.subtract(Counter(old))
    got = snapshots.snapshot_difference(spark, one, two, schema)
    assert changes(got) == {r: n for r, n in want.items() if n}
    assert changes(snapshots.snapshot_difference(spark, two, one, schema)) == {r: -n for r, n in want.items() if n}
    assert snapshots.read_snapshot(spark, one, schema).count() == len(old)
    # Only the buckets of the five keys that changed are opened.
    opened = {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}
    assert 1 <= len(opened) <= 5
    assert {int(b) for b in opened} == set(snapshots.differing_buckets(spark, one, two))


def test_equal_and_empty_snapshots(spark, tmp_path):
    rows = [(i, "x", None) for i in range(100)]
    paths = [str(tmp_path / n) for n in ("a", "b", "none")]
    schema = write(spark, paths[0], rows)
    write(spark, paths[1], rows[::-1])
    write(spark, paths[2], [])
    same = snapshots.snapshot_difference(spark, paths[0], paths[1], schema)
    assert same.collect() == [] and same.inputFiles() == []
    assert changes(snapshots.snapshot_difference(spark, paths[2], paths[0], schema)) == {r: 1 for r in rows}
    assert snapshots.snapshot_difference(spark, paths[2], paths[2], schema).collect() == []


def test_buckets_are_a_power(spark):
    assert [snapshots.levels(n) for n in (1, 16, 256, 4096)] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="power of 16"):
        snapshots.levels(100)


def test_clashing_names(spark, tmp_path):
    one, two = str(tmp_path / "1"), str(tmp_path / "2")
    df = spark.createDataFrame([(1, "x", 2)], "k int, `a.b` string, change int")
    snapshots.write_snapshot(df, one, ["k"], 16)
    snapshots.write_snapshot(df.withColumn("k", F.lit(2)), two, ["k"], 16)
    got = snapshots.snapshot_difference(spark, one, two, df.schema, 16)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 2, -1), (2, "x", 2, 1)]


STATUS = "k string, rev bigint, state string"


def test_status_upserts_touch_their_buckets(spark, tmp_path):
    path = str(tmp_path / "status")
    table = sinks.StatusTable(spark, path, spark.createDataFrame([], STATUS).schema, ["k"], "rev", [], buckets=16)
    assert table.rows().collect() == []
    first = [(f"k{i}", 1, "a") for i in range(200)]
    assert table.upsert(spark.createDataFrame(first, STATUS), 0)
    before = set(table.rows().inputFiles())
    held = table.rows()
    assert table.upsert(spark.createDataFrame([("k3", 2, "b"), ("k3", 1, "old"), ("new", 1, "c"), ("k4", 0, "late"), (None, 1, "n")], STATUS), 1)
    after = set(table.rows().inputFiles())
    assert 12 <= len(before & after) < 16 and len(after) <= 16
    want = {**{k: "a" for k, _, _ in first}, "k3": "b", "new": "c", None: "n"}
    assert {r["k"]: r["state"] for r in table.rows().collect()} == want
    # Who began to read before goes on with what they began with.
    assert {r["state"] for r in held.collect()} == {"a"}
    # A batch that comes again changes nothing, not even a file.
    times = {f: os.path.getmtime(f.removeprefix("file://")) for f in after}
    assert not table.upsert(spark.createDataFrame([("k3", 9, "again")], STATUS), 1)
    assert {r["k"]: r["state"] for r in table.rows().collect()} == want
    assert {f: os.path.getmtime(f.removeprefix("file://")) for f in table.rows().inputFiles()} == times


def test_a_status_batch_that_breaks_off_is_not_seen(spark, tmp_path, monkeypatch):
    table = sinks.StatusTable(spark, str(tmp_path / "s"), spark.createDataFrame([], STATUS).schema, ["k"], "rev", [], buckets=4)
    table.upsert(spark.createDataFrame([("a", 1, "x")], STATUS), 0)
    monkeypatch.setattr(type(table.state), "_write_manifest", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(spark.createDataFrame([("a", 2, "y")], STATUS), 1)
    assert [r["state"] for r in table.rows().collect()] == ["x"]
    monkeypatch.undo()
    assert table.upsert(spark.createDataFrame([("a", 2, "y")], STATUS), 1)
    assert [r["state"] for r in table.rows().collect()] == ["y"]
    with pytest.raises(ValueError, match="batch 5"):
        table.upsert(spark.createDataFrame([("a", 3, "z")], STATUS), 5)
