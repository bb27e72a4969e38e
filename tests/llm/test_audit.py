"""The filter audit against a walk through every order, document by document."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from driftline.llm import audit

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f
        for f, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", re.search(r"[#$%&*|]", text)),
        )
        if bad
    }


def brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        key = float("inf") if i is None else i
        first[text or ""] = min(first.get(text or "", key), key)
    marks = defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    rows = []
    for i, text, part in docs:
        bad = failures(text or "")
        if (float("inf") if i is None else i) > first[text or ""]:
            bad.add("E")
        rows.append((part or "", bad, *(marks[i] if i is not None else (False, False))))
    out, shapley = defaultdict(Counter), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, bad, good, toxic in rows:
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, order, step]
                hit = f in bad
                c["removed"] += hit and not gone
                c["redundant"] += hit and gone
                c["unique_fails"] += bad == {f}
                c["good_lost"] += hit and not gone and good
                c["toxic_lost"] += hit and not gone and toxic
                shapley[part, f] += hit and not gone
                gone |= hit
                c["kept"] += not gone
    return {(p, o, s, *[c[m] for m in MEASURES], shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def got(df):
    rows = [tuple(r) for r in df.select("part", "filter_order", "step", *MEASURES, "shapley").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got(audit.audit(docs, labels)) == brute(rows, [tuple(r) for r in labels.collect()])


LABELS = "doc_id bigint, quality int, toxic int"


def test_odd_documents(spark, odd_docs):
    marks = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame(marks, LABELS).select("*", *[F.lit("x").alias(c) for c in ("part", "mask", "good", "a.b")])
    odd = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("part", "mask", "digest", "good", "toxic", "_spread", "first_id", "cells", "orders")])
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert got(audit.audit(odd, labels)) == brute(rows, marks)


def test_copies_and_null_ids(spark):
    rows = [(5, "a", "x"), (3, "a", "y"), (3, "a", "x"), (None, "a", "x"), (None, "b", None), (None, "b", ""), (1, None, "x"), (2, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert got(audit.audit(df, spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_no_documents(spark, no_docs):
    assert audit.audit(no_docs, spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0
