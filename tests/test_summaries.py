"""Sketches of cells against exact counts, and the numbers of a tree against plain walks."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import extensions, subtrees, summaries

DIMS = ["kind", "zone"]


def rows(spark, n, seed):
    return spark.range(n).select(
        F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("kind"), (F.col("id") % 2).alias("zone"),
        F.floor(F.rand(seed) * 60_000).alias("who"), (F.rand(seed + 1) * 1000).alias("value"))


def test_sketches_are_within_their_bounds(spark, tmp_path):
    path = str(tmp_path / "cells")
    days = [rows(spark, 150_000, 10 * d) for d in range(2)]
    for d, df in enumerate(days):
        summaries.add_day(df, path, f"{d}", DIMS, "who", "value")
    both = days[0].unionByName(days[1])
    got = {(r["grouped"], r["kind"], r["zone"]): r for r in summaries.united(summaries.read_days(spark, path), DIMS, [0.1, 0.5, 0.99]).collect()}
    assert len(got) == 8 + 4 + 2 + 1
    exact = both.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("who").alias("d")).collect()
    exact += both.agg(F.count("*").alias("n"), F.count_distinct("who").alias("d")).select(F.lit("all").alias("kind"), "n", "d").collect()
    for r in exact:
        mine = got[("", None, None) if r["kind"] == "all" else ("kind", r["kind"], None)]
        assert mine["n"] == r["n"]
        # Three standard errors of 1.04 / sqrt(2^LG).
        assert abs(mine["distinct"] - r["d"]) <= 3 * 1.04 / 2 ** (summaries.LG / 2) * r["d"]
        below = both if r["kind"] == "all" else both.where(F.col("kind").eqNullSafe(F.lit(r["kind"])))
        for share, q in zip([0.1, 0.5, 0.99], mine["quantiles"], strict=True):
            assert abs(below.where(F.col("value") <= q).count() / r["n"] - share) < 0.02
    # Some days, some sets.
    one = summaries.united(summaries.read_days(spark, path, ["1"]), DIMS, [0.5], [("zone",)]).collect()
    assert sorted((r["zone"], r["n"]) for r in one) == [(0, 75_000), (1, 75_000)]


def test_a_new_day_leaves_the_others_alone(spark, tmp_path):
    path = str(tmp_path / "cells")
    summaries.add_day(rows(spark, 100, 1), path, "a", DIMS, "who", "value")
    old = {f: os.path.getmtime(tmp_path / "cells" / "day=a" / f) for f in os.listdir(tmp_path / "cells" / "day=a")}
    for _ in range(2):
        summaries.add_day(rows(spark, 50, 2), path, "b", DIMS, "who", "value")
    assert old == {f: os.path.getmtime(tmp_path / "cells" / "day=a" / f) for f in os.listdir(tmp_path / "cells" / "day=a")}
    total = summaries.united(summaries.read_days(spark, path), DIMS, [0.5], [()]).first()
    assert total["n"] == 150


def test_cells_of_nulls_and_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([("a", None, None)], "kind string, who bigint, value double")
    row = summaries.united(summaries.cells(none, ["kind"], "who", "value"), ["kind"], [0.5], [("kind",)]).first()
    assert (row["n"], row["distinct"], row["quantiles"]) == (1, 0, None)
    assert summaries.united(summaries.cells(none.limit(0), ["kind"], "who", "value"), ["kind"], [0.5]).collect() == []


# Trees.

TREE = "id string, parent string"


def walk(rows):
    children, ids = {}, {i for i, _ in rows}
    for i, p in rows:
        children.setdefault(p if p in ids else None, []).append(i)
    out, at = {}, 0

    def visit(i, depth):
        nonlocal at
        at += 1
        first = at
        for c in sorted(children.get(i, [])):
            visit(c, depth + 1)
        out[i] = (first, at, depth)

    for root in sorted(children.get(None, [])):
        visit(root, 1)
    return out


def forest(n, seed):
    rng = random.Random(seed)
    out = [("r0", None), ("r1", None), ("lost", "nowhere")]
    for i in range(n):
        out.append((f"g{i:03}", rng.choice(["r0"] * 3 + [out[-1][0]] * 3 + [x for x, _ in out])))
    return out


def test_numbers_of_a_forest(spark):
    groups = forest(120, 5)
    index = subtrees.subtree_index(spark.createDataFrame(groups, TREE))
    found = {r["id"]: (r["first"], r["last"], r["depth"]) for r in index.collect()}
    assert found == walk(groups)
    of = ["r0", "g005", "lost", "g119"]
    pairs = subtrees.below(index, spark.createDataFrame([(i,) for i in of], "id string"))
    assert sorted(map(tuple, pairs.collect())) == sorted((g, i) for g in of for i, (a, _, _) in found.items() if found[g][0] <= a <= found[g][1])
    values = spark.createDataFrame([(i, n % 5) for n, (i, _) in enumerate(groups)] + [("g000", 7)], "id string, value bigint")
    sums = {r["id"]: r["total"] for r in subtrees.subtree_sums(index, values).collect()}
    counts = values.groupBy("id").agg(F.sum("value").alias("n"))
    linked = spark.createDataFrame([(i, None if p == "nowhere" else p) for i, p in groups], "id string, parent_id string")
    assert sums == {r["id"]: r["n"] for r in extensions.group_tree(linked, counts).collect()}


def test_members_are_as_many_as_spark_takes_them_for(spark):
    """Members that were exploded into a row per level were estimated as one, and broadcast through the driver."""
    n = 200_000
    index = spark.range(1, n + 1).select(F.col("id").cast("string").alias("id"), F.col("id").alias("first"), F.when(F.col("id") == 1, n).when(F.col("id") == 70_000, 70_019).otherwise(F.col("id")).alias("last"))
    pairs = subtrees.below(index, spark.createDataFrame([("1",), ("70000",), ("70003",), ("none",), (None,)], "id string"))
    counts = {r["group"]: (r["n"], r["low"], r["high"]) for r in pairs.groupBy("group").agg(F.countDistinct("id").alias("n"), F.min(F.col("id").cast("int")).alias("low"), F.max(F.col("id").cast("int")).alias("high")).collect()}
    assert counts == {"1": (n, 1, n), "70000": (20, 70_000, 70_019), "70003": (1, 70_003, 70_003)} and pairs.count() == n + 21
    assert "Generate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert subtrees.below(index, spark.createDataFrame([], "id string")).collect() == []


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    made = []
    write = subtrees._Rounds.write
    monkeypatch.setattr(subtrees._Rounds, "write", lambda self, df, name: made.append(name) or write(self, df, name))
    chain = [(f"{i:04}", f"{i - 1:04}" if i else None) for i in range(100)]
    index = subtrees.subtree_index(spark.createDataFrame(chain, TREE))
    assert {(r["id"], r["first"], r["last"], r["depth"]) for r in index.collect()} == {(f"{i:04}", i + 1, 100, i + 1) for i in range(100)}
    assert len(made) <= 2 * 9 + 1


def test_cycles_and_empty_trees(spark):
    with pytest.raises(ValueError, match="cycle"):
        subtrees.subtree_index(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], TREE))
    assert subtrees.subtree_index(spark.createDataFrame([], TREE)).collect() == []
