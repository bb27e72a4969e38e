"""Numbers for a tree, so that "all below X" is a range: each group's place in a walk that visits a group before those below it.

Sizes of subtrees and places are found by pointer doubling: after k rounds each group knows its 2^k-th ancestor and
what lies between, so a chain as long as the table takes logarithmically many rounds. Siblings
follow one another in the order of their ids, which ranges of (parent, id) number without a window over a whole parent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ranks import prefix_sums
from driftline.session import drop_path, scratch_path, written

#: Widths of blocks of the walk, as powers of two. The widest bounds how many members meet in one place.
BLOCK_BITS = (0, 4, 8, 12, 16)


class _Rounds:
    """Tables of the rounds, written one after the other; only the newest of a name is kept."""

    def __init__(self, spark):
        self.spark, self.path, self.count = spark, scratch_path(spark, "subtrees"), 0
        self.last: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{name}-{self.count}"
        df.write.parquet(path)
        if name in self.last:
            drop_path(self.spark, self.last[name])
        self.last[name] = path
        return self.spark.read.schema(df.schema).parquet(path)


def subtree_index(groups: DataFrame) -> DataFrame:
    """id, first, last, depth: the groups of ``groups`` (id, parent) below a group, itself included, are those with first between its first and last.

    A group whose parent is null or not in the table is a root; roots follow one another by id, as do siblings.
    Numbers start at 1 and have no gaps. Ids are unique; a cycle of parents is an error.
    """
    rounds = _Rounds(groups.sparkSession)
    known = groups.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    placed = groups.select("id", "parent").join(known, "parent", "left")
    nodes = rounds.write(placed.select("id", F.when(F.col("_known"), F.col("parent")).alias("parent")), "nodes")
    sizes = _sizes(nodes, rounds)
    return _places(nodes, sizes, rounds)


def _most_rounds(nodes: DataFrame) -> int:
    """Rounds after which every pointer has come to an end, unless there is a cycle."""
    return max(1, nodes.count()).bit_length() + 1


def _sizes(nodes: DataFrame, rounds: _Rounds) -> DataFrame:
    """id, size: how many groups are in each subtree."""
    state = rounds.write(nodes.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), "sizes")
    for _ in range(_most_rounds(nodes) + 1):
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("id", "size")
        # What hangs 2^k below comes up by one sum per ancestor; many children combine inside their tasks.
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        pointers = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        grown = state.join(below, "id", "left").join(pointers, "up", "left")
        state = rounds.write(grown.select("id", F.col("next").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    raise ValueError("the parents of some groups form a cycle")


def _places(nodes: DataFrame, sizes: DataFrame, rounds: _Rounds) -> DataFrame:
    """id, first, last, depth, from the sizes: what comes before a group among its siblings, added up along its ancestors."""
    sized = nodes.join(sizes, "id")
    sums = prefix_sums(sized, [F.col("parent"), F.col("id")], "size", "_upto")
    before = F.col("_upto") - F.col("size")
    starts = sums.groupBy(F.col("parent").alias("_of")).agg(F.min(before).alias("_start"))
    offsets = sums.join(starts, F.col("parent").eqNullSafe(F.col("_of"))).select("id", F.col("parent").alias("up"), "size", (before - F.col("_start") + 1).alias("first"), F.lit(1).alias("depth"))
    state = rounds.write(offsets, "places")
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("first").alias("more"), F.col("depth").alias("deeper"))
        moved = state.join(above, "up", "left")
        state = rounds.write(moved.select(
            "id", F.col("next").alias("up"), "size", (F.col("first") + F.coalesce("more", F.lit(0))).alias("first"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")
        ), "places")
    return state.select("id", "first", (F.col("first") + F.col("size") - 1).alias("last"), "depth")


def below(index: DataFrame, of: DataFrame) -> DataFrame:
    """group, id: everything below each group of ``of`` (id), itself included, by the numbers alone.

    A group's range is cut into blocks no wider than itself, so that a member meets it in the one block that it is in;
    the blocks at both ends reach beyond the range, by twice its length at most. Members take one row per
    width that some group has. Blocks are written, so that their size is known to the join.
    """
    wanted = index.join(of.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("group"), F.col("first").alias("_from"), F.col("last").alias("_to"))
    bits = F.lit(BLOCK_BITS[0])
    for n in BLOCK_BITS[1:]:
        bits = F.when(F.col("_to") - F.col("_from") + 1 >= 1 << n, n).otherwise(bits)
    block = F.explode(F.sequence(F.expr("shiftright(_from, bits)"), F.expr("shiftright(_to, bits)")))
    blocks = written(wanted.withColumn("bits", bits).select("*", block.alias("block")), "blocks")
    # A branch per width, not one row made into several: Spark would take these to be as large as the one.
    widths = sorted(r["bits"] for r in blocks.select("bits").distinct().collect()) or BLOCK_BITS[:1]
    members = [index.select("id", "first", F.lit(n).alias("bits"), F.shiftright("first", n).alias("block")) for n in widths]
    met = reduce(DataFrame.unionByName, members).join(blocks, ["bits", "block"])
    return met.where(F.col("first").between(F.col("_from"), F.col("_to"))).select("group", "id")


def subtree_sums(index: DataFrame, values: DataFrame) -> DataFrame:
    """id, total: the sum of ``value`` of ``values`` (id, value) over each group's subtree, as the difference of two running sums."""
    valued = index.join(values.groupBy("id").agg(F.sum("value").alias("value")), "id", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    sums = prefix_sums(valued, [F.col("first")], "value", "_upto")
    ends = sums.select(F.col("first").alias("last"), F.col("_upto").alias("_end"))
    return sums.join(ends, "last").select("id", (F.col("_end") - F.col("_upto") + F.col("value")).alias("total"))
