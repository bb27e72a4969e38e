"""Connected components by contraction, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of ``links`` (a, b: bigint), the same root as all it is connected with.

    In each round every node points to that neighbour, or itself, with the least hash under
    the round's seed, and links move to the ends' targets; a constant share of the nodes goes
    each time, also on chains, so rounds are logarithmic. It goes on until no link is left. Hubs are
    aggregated in part before each shuffle, and joined as the side that Spark can split.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        seed = F.lit(len(rounds))
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
        ranked = ends.select(F.col("e.a").alias("node"), F.struct(F.xxhash64(seed, "e.b").alias("rank"), F.col("e.b").alias("to")).alias("next"))
        targets = written(ranked.groupBy("node").agg(F.min("next")["to"].alias("to")), "targets")
        rounds.append(targets)
        moved = edges
        for end in ("a", "b"):
            to = targets.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
            moved = moved.join(to, end).drop(end).withColumnRenamed(f"{end}_to", end)
        edges = written(
            moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].select("node", F.col("to").alias("root"))
    for targets in rounds[1:]:
        further = targets.select(F.col("node").alias("root"), F.col("to").alias("next"))
        roots = roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
