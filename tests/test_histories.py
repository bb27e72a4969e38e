"""States in force, episodes, overlaps and ranks against plain loops, with hot keys, ties and nulls."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof, episodes, overlaps, ranks

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + datetime.timedelta(minutes=minutes)


# States in force.

OBS = "k string, t timestamp, id bigint"
DECL = "k string, since timestamp, seq bigint, state string"


def in_force(obs, decl):
    out = {}
    for k, t, i in obs:
        fits = [(s, q, v) for dk, s, q, v in decl if k is not None and t is not None and dk == k and s is not None and s <= t]
        out[i] = max(fits)[2] if fits else None
    return out


@pytest.mark.parametrize("slices", [1, 3, 40, None])
def test_state_in_force(spark, slices):
    rng = random.Random(7)
    keys = ["hot"] * 8 + ["a", "b", None]
    obs = [(rng.choice(keys), at(rng.choice([None] + list(range(200)))), i) for i in range(400)]
    decl = [(rng.choice(keys), at(rng.choice([None] + list(range(0, 200, 7)))), i, f"s{i}") for i in range(60)]
    got = asof.in_force(spark.createDataFrame(obs, OBS).repartition(5), spark.createDataFrame(decl, DECL), ["k"], "t", "since", ["seq"], slices=slices)
    assert got.columns == ["k", "t", "id", "declared"]
    assert {r["id"]: r["declared"] and r["declared"]["state"] for r in got.collect()} == in_force(obs, decl)


def test_in_force_of_nothing(spark):
    obs, decl = spark.createDataFrame([("a", at(1), 1)], OBS), spark.createDataFrame([], DECL)
    assert [r["declared"] for r in asof.in_force(obs, decl, ["k"], "t", "since").collect()] == [None]
    assert asof.in_force(obs.limit(0), decl, ["k"], "t", "since").collect() == []


def test_odd_columns_in_force(spark):
    obs = spark.createDataFrame([("a", at(5), 1)], OBS).select("*", F.lit("x").alias("a.b"), F.lit("y").alias("_side"), F.lit("z").alias("_found"))
    decl = spark.createDataFrame([("a", at(2), 1, "s")], DECL).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("_slice"))
    row = asof.in_force(obs, decl, ["k"], "t", "since").first()
    assert (row["a.b"], row["_side"], row["_found"], row["declared"]["state"], row["declared"]["_slice"]) == ("x", "y", "z", "s", 2)


def test_a_hot_key_is_many_tasks_in_force(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        obs = spark.range(8000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id")).alias("t"), "id")
        decl = spark.range(0, 8000, 100).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id")).alias("since"), F.col("id").alias("seq"), F.col("id").cast("string").alias("state"))
        got = asof.in_force(obs, decl, ["k"], "t", "since", slices=32)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 8000 and max(sizes) < 3500
        assert got.where("declared.seq <> floor(id / 100) * 100 OR declared IS NULL").count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# Episodes.


def islands(rows, gap):
    out = []
    for k in {r[0] for r in rows}:
        mine = sorted(((t, why) for kk, t, why in rows if kk == k and t is not None), key=lambda r: r[0])
        for t, why in mine:
            if out and out[-1][0] == k and t <= out[-1][2] + datetime.timedelta(minutes=gap):
                out[-1][2] = t
                out[-1][3] += 1
                out[-1][4] |= {why} - {None}
            else:
                out.append([k, t, t, 1, {why} - {None}])
    return {(k, s, e, (e - s).total_seconds(), n, tuple(sorted(why))) for k, s, e, n, why in out}


def told(df):
    return {(r["k"], r["start"], r["end"], r["length"], r["observations"], tuple(r["reasons"])) for r in df.collect()}


EPISODE = "k string, t timestamp, why string"


@pytest.mark.parametrize("slices", [1, 2, 16, 100])
def test_episodes(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), at(rng.choice([None] + list(range(0, 3000, rng.choice([1, 5]))))), rng.choice(["x", "y", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, EPISODE).repartition(4)
    assert told(episodes.drift_episodes(df, ["k"], "t", "why", "10 minutes", slices)) == islands(rows, 10)
    assert episodes.drift_episodes(df.limit(0), ["k"], "t", "why", "10 minutes").collect() == []


def test_episodes_of_a_stream_with_late_rows(spark, tmp_path):
    """Late rows within the watermark join their episode; one behind it is dropped; the stream stops in between."""
    from driftline.streaming import streams

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    turns = [
        [("a", 0, "x"), ("a", 10, "y"), ("b", 5, "x"), ("b", 100, None)],
        [("a", 20, "x"), ("b", 95, "x"), ("b", 90, "z"), ("c", 130, "x")],
        [("c", 400, None)],
        [("a", 30, "late"), ("c", 401, "x"), ("c", 391, "y"), ("c", 1000, None)],
        [("c", 1001, None)],
    ]
    for rows in turns:
        spark.createDataFrame([(k, at(t), w) for k, t, w in rows], EPISODE).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(spark.createDataFrame([], EPISODE).schema).parquet(path)
        found = episodes.session_episodes(source, ["k"], "t", "why", "10 minutes", "2 hours")
        streams.stream_rows(found, out, {"availableNow": True}).awaitTermination()
    on_time = [(k, at(t), w) for rows in turns for k, t, w in rows if w not in (None, "late")]
    assert told(spark.read.schema(found.schema).parquet(f"{out}/rows")) == islands(on_time, 10)


# Overlaps.

SPAN = "k string, since bigint, until bigint, id bigint"


def brute(a, b):
    return sorted((x[3], y[3]) for x in a for y in b if None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2])


def test_overlaps(spark):
    rng = random.Random(9)

    def spans(n):
        out = []
        for i in range(n):
            start = rng.randrange(-500, 3000)
            length = rng.choice([0, 1, 1, 2, 5, 30, 400, 2500, -3])
            out.append((rng.choice(["hot"] * 4 + ["a", None]), rng.choice([start] * 20 + [None]), start + length, i))
        return out

    a, b = spans(250), spans(250)
    got = overlaps.overlaps(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"], "since", "until")
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == brute(a, b)


def test_overlaps_without_a_key_and_of_nothing(spark):
    a = [("x", 0, 10, 1), ("y", 10, 20, 2), (None, 5, 6, 3)]
    df = spark.createDataFrame(a, SPAN)
    got = overlaps.overlaps(df, df, [], "since", "until")
    assert sorted((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]
    assert overlaps.overlaps(df.limit(0), df, ["k"], "since", "until").collect() == []


def test_long_intervals_have_few_rows(spark):
    """A long interval has two bins at its level; a short one two bins per level, however many short bins the long one covers."""
    long = spark.createDataFrame([("a", 0, 1_000_000_000, 1)], SPAN)
    widths = overlaps._widths(1, 1_000_000_000)
    assert overlaps._binned(long, ["k"], "since", "until", "_l", widths).count() <= 2
    short = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("since"), (F.col("id") + 1).alias("until"), "id")
    assert overlaps._binned(short, ["k"], "since", "until", "_l", widths).count() <= 1000 * 2 * len(widths)
    pairs = overlaps.overlaps(long, short, ["k"], "since", "until")
    assert pairs.count() == 1000
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_overlaps_of_times(spark, kind):
    one = spark.sql(f"SELECT 'a' AS k, {kind} '2024-01-01' AS since, {kind} '2024-01-05' AS until")
    two = spark.sql(f"SELECT 'a' AS k, {kind} '2024-01-05' AS since, {kind} '2024-01-06' AS until")
    assert overlaps.overlaps(one, one, ["k"], "since", "until").count() == 1
    assert overlaps.overlaps(one, two, ["k"], "since", "until").count() == 0


# Ranks.


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, 1, 1, 1, 2, 5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    got = ranks.global_ranks(df, [F.col("v").desc_nulls_last()]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    values = [r["v"] for r in sorted(got, key=lambda r: r["rank"])]
    assert values == sorted(values, key=lambda v: (v is None, -(v or 0)))
    keyed = ranks.keyed_ranks(df, ["k"], [F.col("id")]).collect()
    want = {}
    for k, _, i in rows:
        want[i] = sum(1 for kk, _, j in rows if kk == k and j <= i)
    assert {r["id"]: r["rank"] for r in keyed} == want


def test_equal_rows_are_ranked_by_many_tasks(spark):
    same = spark.range(0, 8000, 1, 8).select(F.lit(1).alias("v"))
    got = ranks.global_ranks(same, [F.col("v")])
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 8001))
    sizes = [r["count"] for r in got.groupBy(F.col("rank") % 1, F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 4000
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_shares_of_nothing(spark):
    none = spark.createDataFrame([], "v int")
    assert ranks.numbered(none).collect() == []
    assert ranks.top_share(none, [F.col("v")], F.col("v") > 0, 1, 2).collect() == []
    some = spark.createDataFrame([(v, f"x{v}") for v in range(10)], "v int, `a.b` string")
    assert sorted(r["number"] for r in ranks.numbered(some.repartition(3)).collect()) == list(range(1, 11))
    top = ranks.top_share(some, [F.col("v").desc()], F.col("v") < 9, 1, 3).collect()
    assert {r["v"]: r["rank"] for r in top if r["rank"]} == {8: 1, 7: 2, 6: 3}
