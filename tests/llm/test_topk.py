"""Exact top-k against brute force: ties, copies, signs, odd vectors and blocks of every size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def ints(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(64 * x) for x in v]


def brute(rows, k, every):
    out = []
    vectors = [(i, ints(v)) for i, v in rows if ints(v) is not None]
    for q, qv in vectors:
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, cv, strict=False)), c is None, c or 0, c) for c, cv in vectors if c != q]
        out += [(q, n, c, -s) for n, (s, _, _, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=20, every=20, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    got = topk.top_scores(df, F.col("vec_id") % every == 0, k, **options)
    return sorted((tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def clustered(n, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centres[rng.randrange(6)]]) for i in range(n)]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", 5)
    monkeypatch.setattr(topk, "TILE_GROUPS", 2)
    rows = clustered(300)
    assert run(spark, rows) == brute(rows, 20, 20)


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(3)] if i % 3 else [1.0, 1.0, 1.0]) for i in range(200)]
    assert run(spark, rows, every=10) == brute(rows, 20, 10)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, -2.0]), (20, [0.5]), (40, []), (60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf")]),
        (None, [3.0, 0.1]), (3, [1.0, -2.0, 7.0]), (4, [0.0, 0.0]), (-20, [-1.0, -1.0]),
    ]
    assert run(spark, rows) == brute(rows, 20, 20)


def test_ids_that_repeat(spark):
    rows = [(20, [1.0]), (20, [1.0]), (20, [2.0]), (1, [1.0]), (1, [1.0]), (2, [3.0])]
    assert run(spark, rows) == brute(rows, 20, 20)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_every_number_type(spark, scale):
    rows = [(i, [x * scale for x in v]) for i, v in clustered(60)]
    assert run(spark, rows, k=5) == brute(rows, 5, 20)


def test_no_rows_and_no_queries(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []


def test_clashing_columns(spark):
    rows = clustered(45)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    odd = df.select("*", *[F.lit("x").alias(c) for c in "id v q place number tile first score rank query_id ids weights _place a.b".split()])
    got = topk.top_scores(odd, F.col("vec_id") % 20 == 0, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 3, 20)


def test_blocks_are_left_out(spark):
    """In clustered data most blocks' bounds fall below the k-th score."""
    rng = random.Random(2)
    vectors = []
    for c in range(16):
        v = [0] * 16
        v[c] = 40
        vectors += [(c * 64 + i, [x + rng.randrange(-2, 3) for x in v]) for i in range(64)]
    blocks, scored = [], 0
    import numpy as np

    for at in range(0, len(vectors), 64):
        part = vectors[at : at + 64]
        m = np.array([v for _, v in part])
        blocks.append({"ids": np.array([i for i, _ in part]), "least_id": part[0][0], "weights": m, "most": m.max(0)[None], "least": m.min(0)[None]})
    ids, width, size, weights, _, _ = topk._packed([i for i, _ in vectors[:50]], [np.array(v) for _, v in vectors[:50]])
    group = topk.Group({"ids": ids, "width": width, "size": size, "weights": weights, "first": 0}, 20, np.dtype(np.float32))
    add = group.best.add

    def counted(rows, scores, ids, valid):
        nonlocal scored
        scored += scores.size
        add(rows, scores, ids, valid)

    group.best.add = counted
    group.search(blocks, np.dtype(np.float32))
    assert scored <= 50 * 64 * 2
    q, qv = vectors[7]
    want = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in vectors if i != q)[:20]
    assert [(-s, c) for n, _, s, c in group.rows() if n == 7] == want
