"""Queries on whole pages: their text as record content."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.common import query, table
from driftline.operators import dataflow


@query("hash_content", """
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE sha256(html) END AS content_hash, 'page' AS kind,
       CASE WHEN page_id % 7 = 0 THEN 'failure' ELSE 'success' END AS relationship FROM pages""")
def hash_content(spark, folder):
    """Pages as records with attributes; those without content leave on failure."""
    content = F.when(F.col("page_id") % 7 != 0, F.col("html"))
    rows = table(spark, folder, "pages").select(
        "page_id",
        content.alias("content"),
        F.create_map(F.lit("kind"), F.lit("page"), F.lit("content.hash"), F.lit("old")).alias("attributes"),
    )
    return dataflow.hash_content(rows, "content").select(
        "page_id",
        F.element_at("attributes", "content.hash").alias("content_hash"),
        F.element_at("attributes", "kind").alias("kind"),
        "relationship",
    )
