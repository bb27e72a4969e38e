"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.text import all_columns
from driftline.session import scratch_path

#: The table of a Poisson distribution reaches so many standard deviations, and so many
#: steps more, to either side of its mean; what lies beyond is below a double's resolution.
DEVIATIONS, STEPS = 12, 30


def hash_bits(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts joined by ':', as a long; SQL elsewhere can say the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """source, n, rate: how often each of a source's n documents is to appear on average.

    The rows of a source sum to total * weight / sum of weights, over sources present.
    ``weights`` None weighs all sources alike; a source not in ``weights`` weighs 0.
    ``total`` None is the number of documents.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(known, F.coalesce("source", F.lit(""))), F.lit(0.0))
    weighed = counts.withColumn("weight", weight)
    weight_sum, rows = weighed.agg(F.sum("weight"), F.sum("n")).first()
    wanted = float((rows or 0) if total is None else total)
    share = F.lit(wanted) * F.col("weight") / F.lit(weight_sum) / F.col("n") if weight_sum else F.lit(0.0)
    return weighed.select("source", "n", share.alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """source, n, rate, first, table: table[i] is the chance of at most first + i copies.

    The terms are products of rate / k from the first k on, in logarithms about the
    largest and divided by their sum, so that no rate under- or overflows.
    """
    reach = DEVIATIONS * F.sqrt("rate") + STEPS
    spans = rates.select(
        "source", "n", "rate",
        F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long").alias("first"),
        F.ceil(F.col("rate") + reach).cast("long").alias("last"),
    )
    terms = spans.withColumn("k", F.explode(F.sequence("first", "last")))
    by_source = Window.partitionBy("source")
    running = by_source.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") > F.col("first"), F.log(F.col("rate") / F.col("k"))).otherwise(0.0)
    terms = terms.withColumn("logs", F.sum(step).over(running))
    terms = terms.withColumn("term", F.exp(F.col("logs") - F.max("logs").over(by_source)))
    terms = terms.withColumn("chance", F.sum("term").over(running) / F.sum("term").over(by_source))
    cells = F.sort_array(F.collect_list(F.struct("k", "chance")))
    tables = terms.where("rate > 0").groupBy("source", "n", "rate", "first").agg(cells.alias("cells"))
    return tables.select("source", "n", "rate", "first", F.col("cells.chance").alias("table"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 7,
    id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = "copy", key_col: str | None = "mix_key",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in a random order, with the number of the copy and the key of the order.

    The number of copies inverts the Poisson distribution of the source's rate at a point
    that is a hash of seed and id, so runs and retries agree; rows that share an id are
    drawn alike, and null is an id of its own. A null source is a source of its own. Sources of weight 0
    do not appear. Tasks get rows by a hash of (seed, id, copy) and sort them by it, which
    is the global shuffle. Columns of ``docs`` named as ``copy_col`` or ``key_col`` give way to them; where they are
    None the columns of ``docs`` come alone.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "mix")
    poisson_tables(source_rates(docs, source_col, weights, total)).write.parquet(path)
    # Written, so that the planner knows its size and broadcasts it only if it is small.
    tables = spark.read.parquet(path).select(
        F.col("source").alias("_mix_source"), F.col("first").alias("_mix_first"), F.col("table").alias("_mix_table")
    )
    kept = F.struct(*all_columns(docs, tuple(c for c in (copy_col, key_col) if c)))
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    point = hash_bits(F.lit(str(seed)), id_text) / F.lit(float(2**52))
    # The documents' columns travel as one, so that none of them can be taken for one of the join's.
    rows = docs.select(kept.alias("_mix_row"), F.col(source_col).alias("_mix_of"), id_text.alias("_mix_id"), point.alias("_mix_point"))
    # The point is bound once by the outer transform; a plain reference would be hashed for every cell.
    copies = F.element_at(F.transform(F.array("_mix_point"), lambda u: F.size(F.filter("_mix_table", lambda c: c <= u))), 1)
    drawn = rows.join(tables, F.col("_mix_of").eqNullSafe(F.col("_mix_source"))).select(
        "_mix_row", "_mix_id", (F.col("_mix_first") + copies).cast("int").alias("_mix_copies")
    )
    several = drawn.where("_mix_copies > 0").select("_mix_row", "_mix_id", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy"))
    keyed = several.select("_mix_row", "_mix_copy", hash_bits(F.lit(str(seed + 1)), F.col("_mix_id"), F.col("_mix_copy").cast("string")).alias("_mix_key"))
    dealt = keyed.repartition("_mix_key").sortWithinPartitions("_mix_key")
    added = [F.col(c).alias(name) for c, name in (("_mix_copy", copy_col), ("_mix_key", key_col)) if name is not None]
    return dealt.select("_mix_row.*", *added)
