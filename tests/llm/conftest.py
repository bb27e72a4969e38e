import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Long words and many of them. " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "One plain text of some words, here.", "en", "a", 35),
        (1, "One plain text of some words, here.", "en", "a", 35),
        (2, "ONE plain text of some words, here.", "en", "a", 35),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n", "en", None, 3),
        (6, LONG, "en", "a", len(LONG)),
        (None, "A text without an id, and so on.", "en", "b", 10),
        (None, None, None, None, None),
        (7, "12345 67890 !!!", "en", "b", 15),
        (8, "É à ü ß Σ İ 日本 \U0001f600 <|endoftext|> x\u0000y", "fr", "b", 9),
    ]
    extra = (
        "kept keep_id group_size text_sha256 row pos h n chunk recipe best fp text_key fingerprint component_id root least copy mix_key rate "
        "words lines lang_pred score held_out ids n_tokens decoded id url digest bytes first shard place record number "
        "_mix_table _mix_copies _mix_row _near_id _near_key _exact_id _exact_sha _node"
    ).split()
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in extra], F.lit(1).alias("a.b"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
