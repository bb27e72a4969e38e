"""Extensions that the record model suggests; no parity is claimed for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.session import drop_path, scratch_path


def dangling_edges(edges: DataFrame, vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """Connections whose endpoint or group does not exist, one row per missing end.

    ``edges`` has ``connection_id``, ``source_id``, ``destination_id``, ``group_id``;
    ``vertices`` has ``id``; ``groups`` has ``id``. One pass over the edges and one join:
    groups and vertices are asked as one table.
    """
    roles = (("source", "source_id", "vertex"), ("destination", "destination_id", "vertex"), ("group", "group_id", "group"))
    ends = edges.select(
        "connection_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
                    for role, c, kind in roles
                ]
            )
        ).alias("end"),
    ).select("connection_id", "end.*")
    known = vertices.select(F.lit("vertex").alias("kind"), F.col("id").cast("string")).unionByName(
        groups.select(F.lit("group").alias("kind"), F.col("id").cast("string"))
    )
    return ends.join(known, ["kind", "id"], "left_anti").select("connection_id", "role", "id")


def group_tree(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Component counts of every group with those of all groups below it.

    ``groups`` has ``id`` and ``parent_id`` (null: a root); ``counts`` has ``id`` and
    ``n``. After round k every group has the sum of what is less than 2^k levels below it
    and a pointer 2^k levels up, so a tree takes as many rounds as its depth has binary digits.
    Sums per parent are taken inside each task first, and pointers are followed by a join on the
    unique ``id``. Rounds are written to the shared folder. A pointer
    that is left when no tree of so many groups could have one is on a cycle.
    """
    spark = groups.sparkSession
    path = scratch_path(spark, "tree")
    start = groups.select("id", F.col("parent_id").alias("up")).join(counts.select("id", "n"), "id", "left")
    start.select("id", "up", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).write.parquet(f"{path}/0")
    now = spark.read.parquet(f"{path}/0")
    rounds, last = 0, now.count().bit_length() + 1
    while not (going := now.where("up IS NOT NULL")).isEmpty():
        if rounds == last:
            found = ", ".join(sorted(str(r["id"]) for r in going.select("id").limit(3).collect()))
            raise ValueError(f"groups are on or below a cycle, such as {found}")
        rounds += 1
        lifted = going.groupBy(F.col("up").alias("id")).agg(F.sum("n").alias("more"))
        further = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = now.join(lifted, "id", "left").join(further, "up", "left")
        step.select(
            "id", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")
        ).write.parquet(f"{path}/{rounds}")
        now = spark.read.parquet(f"{path}/{rounds}")
        drop_path(spark, f"{path}/{rounds - 1}")
    return now.select("id", "n")


def state_conflicts(groups: DataFrame, children: DataFrame) -> DataFrame:
    """Children whose desired state contradicts the desired state of their group.

    Both sides have ``group_id`` and ``desired_state``. A group that wants RUNNING
    conflicts with a child that wants another state, and the same for STOPPED; a
    group that wants DISABLED never acts on its children.
    """
    wanted = groups.select("group_id", F.col("desired_state").alias("group_state")).where(
        F.col("group_state").isin("RUNNING", "STOPPED")
    )
    return children.join(wanted, "group_id").where(F.col("desired_state") != F.col("group_state"))


#: Levels that ``inherited_params`` works on between two written tables.
LEVELS_AT_ONCE = 4


def inherited_params(own: DataFrame, parents: DataFrame) -> DataFrame:
    """Effective parameters of each context: its own first, then inherited in order.

    ``own`` has ``context_id``, ``name``, ``value``; ``parents`` has ``context_id``,
    ``parent_id``, ``position``. The nearest definition on the earliest parent wins; of parents
    at one position, and of own values of one name, the least value. Links from or to null give nothing.

    Each level joins the few parent links with the parameters and keeps one row of fixed width per
    (context, name) at once. Beside it goes the set of open contexts, those with an ancestor
    further away than the levels taken: it shrinks with each level, and when it is empty all parameters
    are final. A set that no longer shrinks lies on or below a cycle, which is an error, whether or not a parameter reaches it.
    """
    spark = own.sparkSession
    path = scratch_path(spark, "inherited")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def nearest(choices: DataFrame) -> DataFrame:
        picked = choices.groupBy("context_id", "name").agg(F.min(F.struct("inherited", "position", "value")).alias("_pick"))
        return picked.select("context_id", "name", "_pick.inherited", "_pick.position", "_pick.value")

    place = dict(parents.dtypes)["position"]
    links = table(parents.select("context_id", "parent_id", "position").distinct(), "links")
    mine = table(nearest(own.select("context_id", "name", F.lit(False).alias("inherited"), F.lit(None).cast(place).alias("position"), "value")), "own")

    def level(best: DataFrame) -> DataFrame:
        lifted = best.select(F.col("context_id").alias("parent_id"), "name", "value").join(links, "parent_id")
        return nearest(mine.unionByName(lifted.select("context_id", "name", F.lit(True).alias("inherited"), "position", "value")))

    def below(contexts: DataFrame) -> DataFrame:
        return links.join(contexts.select(F.col("context_id").alias("parent_id")), "parent_id", "left_semi").select("context_id").distinct()

    best, rounds = mine, 0
    still = table(links.where("parent_id IS NOT NULL").select("context_id").distinct(), "open-0")
    left = still.count()
    while left:
        rounds += 1
        for _ in range(LEVELS_AT_ONCE):
            best, still = level(best), below(still)
        still, before = table(still, f"open-{rounds}"), left
        left = still.count()
        if left == before:
            found = ", ".join(sorted(str(r["context_id"]) for r in still.limit(3).collect()))
            raise ValueError(f"contexts inherit from each other, or from such, as {found}")
        best = table(best, f"best-{rounds}")
        for name in (f"open-{rounds - 1}", f"best-{rounds - 1}"):
            drop_path(spark, f"{path}/{name}")
    return best.select("context_id", "name", "value", "inherited")


def latest_available(flows: DataFrame, versions: DataFrame) -> DataFrame:
    """Fill ``latest_version`` of each flow from a table of registered versions."""
    newest = versions.groupBy("flow_id").agg(F.max("version").alias("latest_version"))
    return flows.join(newest, "flow_id", "left")


def mask_sensitive(value: Column, sensitive: Column) -> Column:
    """``***`` for a stated value flagged sensitive."""
    return F.when(sensitive & value.isNotNull(), F.lit("***")).otherwise(value)


def flow_limits(df: DataFrame, duration: str, size: str) -> DataFrame:
    """Duration and size texts as numbers beside the texts."""
    return df.withColumn("duration_ms", X.duration_ms(F.col(duration))).withColumn(
        "size_bytes", X.size_bytes(F.col(size))
    )
