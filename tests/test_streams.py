"""Streams over several micro-batches, restarts, late rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from driftline.operators.changes import desired_changed, latest_revision
from driftline.sources import generate
from driftline.streaming import streams
from driftline.streaming.state import KeyedState, due

ALL = {"availableNow": True}
SCHEMA = "user_id bigint, ts timestamp, event_id bigint, event_type string"


@pytest.fixture
def feed(spark, folder, tmp_path):
    """The events in order of time, cut into files that arrive one after the other."""
    path = str(tmp_path / "feed")
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type"
    )
    cuts = [0, 0.2, 0.5, 1]
    n = events.count()

    def write(part):
        low, high = int(cuts[part] * n), int(cuts[part + 1] * n)
        events.where(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(path)

    return path, write, events


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_desired_changed_over_restarts(spark, feed, tmp_path):
    path, write, events = feed
    out = str(tmp_path / "out")
    for part in range(3):
        write(part)
        streams.stream_desired_changed(
            source(spark, path), ["user_id"], ["ts", "event_id"], ["event_type"], out, ALL
        ).awaitTermination()
    got = {r["event_id"] for r in streams.read_rows(spark, out).collect()}
    batch = desired_changed(events, ["user_id"], ["ts", "event_id"], ["event_type"])
    assert got == {r["event_id"] for r in batch.collect()}
    assert streams.read_rows(spark, out).count() == len(got)


def test_a_deleted_key_starts_anew(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, seq bigint, state string"
    turns = [[("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x")], [("a", 4, "gone"), ("b", 5, "x")], [("a", 6, "gone"), ("a", 7, "x"), (None, 8, "x")], [(None, 9, "x"), ("a", 10, "x")]]
    for rows in turns:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        streams.stream_desired_changed(stream, ["k"], ["seq"], ["state"], out, ALL, deleted="state = 'gone'").awaitTermination()
    assert sorted(r["seq"] for r in streams.read_rows(spark, out).collect()) == [1, 3, 4, 6, 7, 8]


@pytest.mark.parametrize("fanout, buckets", [(1, 3), (2, 1), (2, 64), (3, 2), (50, 4)])
def test_state_is_the_same_however_it_is_merged(spark, tmp_path, fanout, buckets):
    schema = spark.createDataFrame([], "k string, rev bigint, gone boolean").schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["k"], ["rev"], "gone", buckets=buckets, fanout=fanout)
    want = {}
    for epoch in range(9):
        rows = [(f"k{epoch % 3}", epoch, False), (f"d{epoch % 2}", epoch, epoch % 4 == 3), ("late", 100 - epoch, False)]
        for _ in range(2):  # a batch that is run again changes nothing
            assert {r["k"]: r["rev"] for r in state.rows(epoch).collect()} == {k: v for k, (v, gone) in want.items() if not gone}
            state.write(spark.createDataFrame(rows, schema), epoch)
        for k, rev, gone in rows:
            if k not in want or want[k][0] < rev:
                want[k] = (rev, gone)
    assert {r["k"]: r["rev"] for r in state.rows(9).collect()} == {k: v for k, (v, gone) in want.items() if not gone}


def test_levels_of_a_bucket():
    """A full level becomes one run of the next; runs stay logarithmic in number."""
    runs, most = [], 0
    for epoch in range(300):
        runs.append((0, epoch))
        if found := due(runs, 4):
            keep, level = found
            runs = [*runs[:keep], (level, epoch)]
        most = max(most, len(runs))
        levels = [level for level, _ in runs]
        assert levels == sorted(levels, reverse=True) and all(levels.count(x) < 4 for x in levels)
    assert most <= 3 * 5


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, rev bigint, text string").schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["k"], ["rev"], buckets=64, fanout=3)
    for epoch in range(7):
        state.write(spark.range(20_000).select(F.col("id").alias("k"), F.lit(epoch).cast("bigint").alias("rev"), F.sha2(F.col("id").cast("string"), 256).alias("text")), epoch)
    one = spark.createDataFrame([(17, 9, "x")], schema)
    found = state.lookup(one, 7)
    everything = state.rows(7).inputFiles()
    (bucket,) = state.buckets_of(one, 7)
    assert found.where("k = 17").first()["rev"] == 6 and 100 < found.count() < 700
    assert 0 < len(found.inputFiles()) * 40 < len(everything) and all(f"_bucket={bucket}/" in f for f in found.inputFiles())
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    assert size(found.inputFiles()) * 40 < size(everything)
    # What a batch of one key writes, a merge included, is of its bucket.
    for epoch in (7, 8, 9):
        state.write(one, epoch)
    folders = [f for f in os.listdir(tmp_path / "s") if f.split("=")[0] in ("changes", "merged") and int(f.split("=")[1]) >= 7]
    assert "merged=8" in folders or "merged=9" in folders or "merged=7" in folders
    assert {b for f in folders for b in os.listdir(tmp_path / "s" / f) if b.startswith("_bucket")} == {f"_bucket={bucket}"}
    assert state.rows(10).count() == 20_000


def test_a_late_row_does_not_revive_a_deleted_key(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, rev bigint, gone boolean").schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["k"], ["rev"], "gone", buckets=2, fanout=2)
    turns = [[("a", 9, False), ("b", 1, False)], [("a", 10, True)], [("b", 2, False)], [("b", 3, False)], [("b", 4, False)], [("a", 9, False)], [("a", 8, False), ("c", 1, True)]]
    for epoch, rows in enumerate(turns):
        state.write(spark.createDataFrame(rows, schema), epoch)
    assert [tuple(r) for r in state.rows(len(turns)).collect()] == [("b", 4, False)]
    assert {r["k"] for r in state.rows(len(turns), ended=True).collect()} == {"a", "b", "c"}
    # A newer row does, and a row after the stated lateness may.
    state.write(spark.createDataFrame([("a", 11, False)], schema), len(turns))
    assert {r["k"] for r in state.rows(len(turns) + 1).collect()} == {"a", "b"}


def test_ended_keys_go_after_the_lateness(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, rev bigint, gone boolean").schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, ["k"], ["rev"], "gone", lateness=2, buckets=1, fanout=2)
    state.write(spark.createDataFrame([("a", 1, True), ("b", 1, False)], schema), 0)
    state.write(spark.createDataFrame([("b", 2, False)], schema), 1)
    assert state.rows(2, ended=True).count() == 2
    for epoch in range(2, 8):
        state.write(spark.createDataFrame([("b", epoch + 1, False)], schema), epoch)
    assert [r["k"] for r in state.rows(8, ended=True).collect()] == ["b"]


def test_gauges_follow_deletes_late_rows_and_changes_of_kind(spark, tmp_path):
    """Every tick equals a recount of all rows so far."""
    import random

    path, out, rng = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(4)
    schema = "name string, rev int, kind string, ready string, gone boolean"
    everything = []
    for _ in range(6):
        rows = [(f"n{rng.randrange(12)}", rng.randrange(100), rng.choice("PCS"), rng.choice(["True", "False"]), rng.random() < 0.2) for _ in range(8)]
        everything.append(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withColumn(
            "conditions", F.array(F.struct(F.lit("Ready").alias("type"), F.col("ready").alias("status"))))
        streams.stream_state_metrics(stream, ["name"], "rev", ["kind", "ready", "gone"], out, ALL, deleted="gone").awaitTermination()
    for tick in range(6):
        newest = {}
        for row in (r for rows in everything[: tick + 1] for r in rows):
            if row[0] not in newest or row[1:] > newest[row[0]][1:]:
                newest[row[0]] = row
        want = {}
        for _, _, kind, ready, gone in newest.values():
            if not gone:
                n, r = want.get(kind, (0, 0))
                want[kind] = (n + 1, r + (ready == "True"))
        got = {r["kind"]: (r["total"], r["ready"]) for r in streams.read_rows(spark, out).where(F.col("epoch") == tick).collect()}
        assert got == want


def test_latest_status_ignores_late_revisions(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, rev bigint, seq bigint, state string"
    parts = [[("a", 5, 1, "x"), ("b", 1, 2, "x")], [("a", 4, 3, "late"), ("b", 2, 4, "y"), ("c", 0, 5, "z")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        streams.stream_latest_status(stream, ["k"], "rev", ["seq"], out, ALL).awaitTermination()
    flat = spark.createDataFrame([r for p in parts for r in p], schema)
    got = streams.read_status_rows(flat, out, ["k"], "rev", ["seq"]).collect()
    assert {(r["k"], r["state"]) for r in got} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert {tuple(r) for r in latest_revision(flat, ["k"], "rev", ["seq"]).collect()} == {tuple(r) for r in got}


def test_metrics_of_every_tick(spark, tmp_path):
    """Each tick counts all resources as they are then; what comes late is counted, not dropped."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "name string, rev int, kind string, ready string"
    for rows in ([("a", 1, "P", "True"), ("b", 1, "P", "False"), ("c", 1, "C", "True")], [("b", 2, "P", "True"), ("a", 0, "P", "False")], [("c", 9, "C", "False")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withColumn(
            "conditions", F.array(F.struct(F.lit("Ready").alias("type"), F.col("ready").alias("status"))))
        streams.stream_state_metrics(stream, ["name"], "rev", [], out, ALL).awaitTermination()
    got = {(r["epoch"], r["kind"], r["total"], r["ready"]) for r in streams.read_rows(spark, out).collect()}
    assert got == {(0, "P", 2, 1), (0, "C", 1, 1), (1, "P", 2, 2), (1, "C", 1, 1), (2, "P", 2, 2), (2, "C", 1, 0)}


def group(revision, running):
    return {"id": "g", "revision": {"version": revision}, "component": {"name": "g", "comments": ""}, "runningCount": running, "stoppedCount": 0}


GROUP = ("id string, revision struct<version:bigint>, component struct<name:string,comments:string>, runningCount int, "
         "stoppedCount int, disabledCount int, invalidCount int")
WANT = "parentGroupId string, name string, position struct<x:double,y:double>, comments string, parameterContextId string, desiredState string"


def test_one_check_per_resource_and_batch(spark, tmp_path):
    path, out, whole = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "all")
    declared = spark.createDataFrame([(k, {"name": "g", "comments": "", "desiredState": "STOPPED"}) for k in ("a", "b")], f"key string, desired struct<{WANT}>")
    seen = spark.createDataFrame([("a", group(1, 5)), ("a", group(2, 0)), ("x", group(1, 0)), (None, group(1, 1))], f"key string, observed struct<{GROUP}>")
    seen.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(seen.schema).parquet(path)
    streams.stream_observe(stream, declared, "ProcessGroup", "key", out, ALL).awaitTermination()
    assert [(r["key"], r["action"]) for r in streams.read_rows(spark, out).collect()] == [("a", "NOOP")]
    # What is declared and gone only shows in the pass over everything.
    streams.stream_check_all(stream, lambda: declared, lambda: spark.read.parquet(path).where("observed.revision.version = 2"), "ProcessGroup", "key", whole, ALL).awaitTermination()
    assert {(r["key"], r["action"]) for r in streams.read_rows(spark, whole).collect()} == {("a", "NOOP"), ("b", "CREATE")}


def test_flow_operators_on_a_stream(spark, feed, tmp_path):
    """Routing, termination and hashing are the same functions on a stream."""
    from driftline.operators import dataflow

    path, write, events = feed
    write(0)
    edges = spark.createDataFrame([("c1", 1, "x", ["view"]), ("c2", 1, "y", ["view", "click"])],
                                  "connection_id string, source_id bigint, destination_id string, selectedRelationships array<string>")
    ended = spark.createDataFrame([(1, ["click"])], "source_id bigint, autoTerminatedRelationships array<string>")

    def flow(records):
        named = records.withColumnsRenamed({"user_id": "source_id", "event_type": "relationship"})
        kept = dataflow.auto_terminate(named, ended)
        routed = dataflow.route(kept, edges).drop("relationship")
        return dataflow.log_lines(dataflow.hash_content(routed, "destination_id"), "info")

    out = str(tmp_path / "out")
    streams.stream_rows(flow(source(spark, path)), out, ALL).awaitTermination()
    got = spark.read.parquet(f"{out}/rows").select("event_id", "connection_id", "attributes").collect()
    want = flow(spark.read.parquet(path)).select("event_id", "connection_id", "attributes").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_generator_stream(spark, tmp_path):
    df = generate.generate_stream(spark, batch_size=3, record_bytes=4)
    assert df.isStreaming
    seen = []

    def keep(batch, _):
        seen.extend(batch.collect())

    query = df.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(300):
            if len(seen) >= 6 or not query.isActive:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert [r["sequence"] for r in seen[:6]] == [0, 1, 2, 3, 4, 5] and seen[0]["content"] == "xxxx"


@pytest.mark.parametrize("name", ["stream_desired_changed", "stream_state_metrics", "stream_observe", "stream_check_all"])
def test_plans_inside_micro_batches(spark, folder, monkeypatch, name):
    """What a micro-batch writes has no cross join, no shuffle into one task and no Python."""
    import __spark_entry__ as contract
    from test_scale import BAD

    plans, write = [], streams._replace

    def keep(rows, out, epoch, *more):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, out, epoch, *more)

    monkeypatch.setattr(streams, "_replace", keep)
    contract.queries()[name](spark, folder)
    assert plans and not [p for p in plans if BAD.search(p)]
