"""CRC-32 over spans against zlib, and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import crc, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, least=1, most=1, buckets=10_000):
    ws = words(text)
    return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(ws) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.data())
def test_spans_equal_zlib(data, draw):
    n = draw.draw(st.integers(1, 20))
    starts = [draw.draw(st.integers(0, len(data) - 1)) for _ in range(n)]
    lengths = [draw.draw(st.integers(1, len(data) - s)) for s in starts]
    got = crc.span_crcs(np.frombuffer(data, np.uint8), np.array(starts), np.array(lengths))
    assert got.tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lengths, strict=True)]


def test_long_spans_and_chunks(monkeypatch):
    data = np.random.default_rng(0).integers(0, 256, 50_000).astype(np.uint8)
    starts, lengths = np.array([0, 5, 100, 7, 9]), np.array([50_000, 64, 65, 128, 20_001])
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)]
    for chunk in (1 << 20, 640):
        monkeypatch.setattr(crc, "CHUNK", chunk)
        assert crc.span_crcs(data, starts, lengths).tolist() == want


@pytest.mark.parametrize("piece", [1 << 20, 100])
@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (2, 2)])
def test_features_over_pieces(texts, piece, least, most, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", piece)
    monkeypatch.setattr(resample.pieces, "__defaults__", (piece,))
    some = [texts[i] or "" for i in sorted(texts)[:60]] + ["", " .. ", "É日本 Ab_c-9 " * 50, "x" * 1000]
    n_words, owner, bucket = resample.Runs(least, most, 10_000).of([t.encode() for t in some])
    for i, t in enumerate(some):
        assert n_words[i] == len(words(t))
        assert Counter(bucket[owner == i].tolist()) == Counter(features(t, least, most))


def brute(docs, target, least=1, most=1, buckets=10_000, seed=2024, least_words=20, share=(10, 100)):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, least, most, buckets))
    for text in target:
        t.update(features(text, least, most, buckets))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        fs = features(text, least, most, buckets)
        weight = sum(map(gain, fs))
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: len(able) * share[0] // share[1]], 1):
        r[5] = n
    return Counter(map(tuple, rows))


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("options", [{}, {"least": 1, "most": 2, "buckets": 97, "least_words": 3, "share": (1, 3), "seed": 5}])
def test_equals_brute_force(spark, texts, options):
    docs = [(i, texts[i]) for i in sorted(texts)[:150]]
    target = [texts[i] for i in sorted(texts)[150:170]]
    assert got(resample.resample(*frames(spark, docs, target), **options)) == brute(docs, target, **options)


def test_nulls_ties_and_repeats(spark):
    long = "one two three four five six seven eight nine ten " * 3
    docs = [(1, long), (1, long), (2, long.upper()), (None, long), (3, None), (4, ""), (5, ".. ,,"), (6, "few words"), (7, "w" * 200_000), *[(i, long) for i in range(10, 40)]]
    assert got(resample.resample(*frames(spark, docs, ["one two", None]), share=(1, 2))) == brute(docs, ["one two", None], share=(1, 2))
    assert got(resample.resample(*frames(spark, docs, []))) == brute(docs, [])
    assert got(resample.resample(*frames(spark, [], ["one"]))) == Counter()


def test_odd_columns(spark, odd_docs):
    target = spark.createDataFrame([("one text",)], "text string").select("*", *[F.lit(0).alias(c) for c in ("bucket", "n", "a.b")])
    rows = resample.resample(odd_docs.select("*", *[F.lit("x").alias(c) for c in ("weight", "_place", "_tie", "bucket", "n_words")]), target)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(rows) == brute(docs, ["one text"])
