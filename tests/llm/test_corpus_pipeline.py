"""The pipeline's stages, each on what the one before kept, against brute force."""

import re
from collections import Counter

import public_tokenizers as P
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from driftline.llm import bpe, simhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def run_stages(spark, docs, folder):
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], folder), name))
    return kept


@pytest.fixture(scope="module")
def kept(spark, docs, folder):
    return run_stages(spark, docs, folder)


def test_columns(kept, docs):
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "mix_sources", "bpe"]


def test_languages_keep_what_has_letters(kept):
    want = Counter(r.doc_id for r in kept[0].collect() if re.search(r"[^\W\d_]", r.text or ""))
    assert Counter(r.doc_id for r in kept[1].collect()) == want


def test_exact_keeps_the_greatest(kept):
    best = {}
    for r in kept[1].collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(best.values())


def test_near_keeps_the_least(kept):
    rows = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in kept[2].collect())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted({find(i) for i in parent})


def test_mixture_repeats_whole_rows(kept):
    before = {tuple(r) for r in kept[3].collect()}
    assert {tuple(r) for r in kept[4].collect()} <= before


def test_tokens_of_every_row(kept):
    coder = bpe.WordBpe(open(P.path("word_bpe_49k.json"), "rb").read())
    want = Counter((r.doc_id, coder.encode(r.text)) for r in kept[4].collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in kept[5].collect()) == want


def test_run_is_registered(spark, folder, kept):
    got = contract.queries()["pipeline"](spark, folder)
    assert Counter((r.doc_id, r.ids_sha256) for r in got.collect()) == Counter((r.doc_id, r.ids_sha256) for r in kept[5].collect())


def test_odd_and_empty(spark, odd_docs, no_docs, folder):
    stages = run_stages(spark, odd_docs, folder)
    assert all(k.columns == odd_docs.columns for k in stages[:-1])
    assert Counter(r.doc_id for r in stages[3].collect()) == Counter([2, 6, 8, None])
    assert all(r[c] == "x" for r in stages[4].collect() for c in ("_mix_table", "_mix_copies", "_near_id", "_exact_id", "_node"))
    # Columns that are named like the operators' own keep their values.
    assert all(r["copy"] == "x" and r["mix_key"] == "x" and r["a.b"] == 1 for r in stages[4].collect())
    assert [k.count() for k in run_stages(spark, no_docs, folder)] == [0] * 6
