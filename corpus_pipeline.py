"""A training corpus from ``documents``: five stages, each written and read again.

Each stage works on all rows that the one before has kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, exact, language, mixing, simhash
from driftline.llm.components import written
from driftline.llm.queries import vocabulary

#: Below this score a text shares next to nothing with any language learned.
LEAST_SCORE = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and scores below LEAST_SCORE."""
    return language.keep_identified(docs, language.fit(docs), LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in any case) the document with the greatest id stays."""
    return exact.drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints that differ in four bits at most the one with the least id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share of rows: documents repeat, or are left out, as drawn; in random order."""
    return mixing.mix_sources(docs, copy_col=None, key_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and digests of them and of what they decode to."""
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), digests=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: Kernels, fingerprints and merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
