"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so, each distinct chunk's bytes move once and
become a verified identifier, and documents are compared by their ordered lists of
identifiers. Long texts never move as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.text import all_columns, ascii_lower
from driftline.session import scratch_path

#: A chunk ends at the first sentence end past the least length, or at the greatest length.
LEAST_CHUNK, MOST_CHUNK = 1024, 16384


def chunk_pattern(least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> str:
    return rf"(?s).{{{least},{most - 1}}}?[.!?]\s|.{{1,{most}}}"


def chunk_table(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column], pattern: str) -> DataFrame:
    """A row per chunk: row, doc_id, sha (on the first chunk), pos, h, n, chunk. No text gives one row with a null chunk."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
    )
    return texts.select(
        "row", "doc_id", F.sha2("norm", 256).alias("sha"), F.posexplode_outer(F.regexp_extract_all("norm", F.lit(pattern), F.lit(0))).alias("pos", "chunk")
    ).select(
        "row", "doc_id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("sha")).alias("sha"), "pos",
        hashed(F.col("chunk")).alias("h"), F.octet_length("chunk").alias("n"), "chunk",
    )


def chunk_variants(chunks: DataFrame) -> DataFrame | None:
    """For chunks whose (h, n) stands for several contents: row, pos and the content's number; None if there are none.

    The distinct contents pass one shuffle, combined in each task before it; grouping on
    the content itself compares bytes. An (h, n) with one content is a verified identifier.
    """
    store = chunks.where("chunk IS NOT NULL").select("h", "n", "chunk").distinct()
    unclear = store.groupBy("h", "n").agg(F.count("*").alias("contents")).where("contents > 1").select("h", "n")
    written = scratch_path(chunks.sparkSession, "unclear-chunks")
    unclear.write.parquet(written)
    unclear = chunks.sparkSession.read.schema(unclear.schema).parquet(written)
    if unclear.isEmpty():
        return None
    contents = chunks.join(unclear, ["h", "n"], "left_semi")
    number = F.sha2("chunk", 256)
    return contents.select("row", "pos", number.alias("variant"))


def recipes(chunks: DataFrame) -> DataFrame:
    """A row per document: row, doc_id, sha, recipe (its ordered list of verified identifiers)."""
    variants = chunk_variants(chunks)
    parts = chunks.select("row", "doc_id", "sha", "pos", "h", "n")
    if variants is None:
        parts = parts.withColumn("variant", F.lit(None).cast("string"))
    else:
        parts = parts.join(variants, ["row", "pos"], "left")
    piece = F.when(F.col("pos").isNotNull(), F.struct("pos", "h", "n", F.coalesce("variant", F.lit("")).alias("variant")))
    return parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.sort_array(F.collect_list(piece)).alias("parts")
    ).select("row", "doc_id", "sha", F.transform("parts", lambda p: F.struct(p.h.alias("h"), p.n.alias("n"), p.variant.alias("v"))).alias("recipe"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    hashed: Callable[[Column], Column] = F.xxhash64, pattern: str | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``.

    Texts are equal when they are after lower-casing A-Z only; null and empty are the same
    text. Of equal texts the row with the greatest id stays, one of them where that id
    repeats; null ids are the smallest. Other columns of ``docs`` play no part and may have any name.
    No rows give no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "chunks")
    chunk_table(docs, id_col, text_col, hashed, pattern or chunk_pattern()).write.parquet(path)
    lists = recipes(spark.read.parquet(path))
    written = scratch_path(spark, "recipes")
    lists.write.parquet(written)
    lists = spark.read.parquet(written)
    # Written, so that the join has plain shuffles on both sides and Spark can split a hot recipe.
    grouped = lists.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    written = scratch_path(spark, "recipe-groups")
    grouped.write.parquet(written)
    groups = spark.read.parquet(written)
    return lists.join(groups, "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, all columns as they are; see exact_duplicates."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.col("text_sha256").alias("sha")
    )
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    # The documents' columns travel as one, so that none of them can be taken for one of the join's.
    keyed = docs.select(F.struct(*all_columns(docs)).alias("doc"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), sha.alias("sha"))
    # Only rows that repeat both id and text meet in a window; it uses the join's own order.
    same = Window.partitionBy("id", "sha").orderBy("id")
    rows = keyed.join(kept, ["id", "sha"], "left_semi").withColumn("number", F.row_number().over(same))
    return rows.where("number = 1").select("doc.*")
