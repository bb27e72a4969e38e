"""What a flow of connected processors does to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.functions.unnest import unnest


def route(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Each record once per connection that takes its relationship.

    ``records`` has ``source_id`` and ``relationship``; ``edges`` has
    ``connection_id``, ``source_id``, ``destination_id`` and ``selectedRelationships``.
    Selections become rows first, so the join is an equality on (source, relationship)
    that Spark can broadcast, or shuffle and split where one source is hot.
    """
    taken = edges.select(
        "connection_id",
        "source_id",
        "destination_id",
        F.explode(F.array_distinct("selectedRelationships")).alias("relationship"),
    )
    return records.join(taken, ["source_id", "relationship"])


def auto_terminate(records: DataFrame, vertices: DataFrame) -> DataFrame:
    """Drop records on a relationship that their source terminates itself.

    ``vertices`` has ``source_id`` and ``autoTerminatedRelationships``.
    """
    ended = vertices.select(
        "source_id", F.explode("autoTerminatedRelationships").alias("relationship")
    ).distinct()
    return records.join(ended, ["source_id", "relationship"], "left_anti")


def expire(records: DataFrame, edges: DataFrame, as_of: Column, entered: str = "entered") -> DataFrame:
    """Drop records that waited in their connection longer than its expiration at ``as_of``.

    ``edges`` has ``connection_id`` and ``flowFileExpiration``. ``"0 sec"``, an empty
    text and none at all mean never; so does a connection that is not listed. Limits are
    taken in nanoseconds, ages in the microseconds that a timestamp has; texts that are no duration
    are listed by ``unreadable_limits``.
    """
    limits = edges.select(
        "connection_id", X.duration_ns(F.col("flowFileExpiration")).alias("_limit_ns")
    ).where("_limit_ns > 0")
    age_us = F.timestamp_diff("MICROSECOND", F.col(entered), as_of)
    return (
        records.join(limits, "connection_id", "left")
        .where(F.col("_limit_ns").isNull() | (age_us.cast("decimal(38,0)") * 1000 <= F.col("_limit_ns")))
        .drop("_limit_ns")
    )


def unreadable_limits(edges: DataFrame) -> DataFrame:
    """Connections whose expiration states something that is no duration, so that it never applies."""
    text = F.coalesce("flowFileExpiration", F.lit(""))
    return edges.where((F.trim(text) != "") & X.duration_ns(text).isNull()).select("connection_id", "flowFileExpiration")


def back_pressure(queue: DataFrame, edges: DataFrame) -> DataFrame:
    """Per connection: queued objects and bytes and whether a threshold is reached.

    ``queue`` has ``connection_id`` and ``bytes`` per record; ``edges`` has the two
    thresholds, where 0 and ``''`` set no limit. Counted before the join, so a queue
    with most of the records is one row by then.
    """
    depth = queue.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("_objects"), F.sum("bytes").alias("_bytes")
    )
    objects, size = F.coalesce("_objects", F.lit(0)), F.coalesce("_bytes", F.lit(0))
    most = F.coalesce("backPressureObjectThreshold", F.lit(0))
    most_bytes = F.coalesce(X.size_bytes(F.col("backPressureDataSizeThreshold")), F.lit(0))
    return edges.join(depth, "connection_id", "left").select(
        "connection_id",
        objects.alias("objects"),
        size.alias("bytes"),
        ((most > 0) & (objects >= most)).alias("objects_full"),
        ((most_bytes > 0) & (size >= most_bytes)).alias("size_full"),
    )


def load_balance(
    df: DataFrame, strategy: str, nodes: int, sequence: str | None = None,
    attribute: str | None = None, home: str | None = None,
) -> DataFrame:
    """Add ``node``, the cluster node each record goes to.

    ``ROUND_ROBIN`` deals by the record's ``sequence``, ``PARTITION_BY_ATTRIBUTE``
    keeps equal attributes together, ``SINGLE_NODE`` sends all to node 0 and
    ``DO_NOT_LOAD_BALANCE`` keeps the ``home`` node. The node is a column and not a
    Spark partition: all records of one node, or of one attribute value, may be far
    too many for one task, and choosing a node needs no shuffle.
    """
    if strategy == "ROUND_ROBIN":
        node = F.pmod(F.col(sequence), F.lit(nodes))
    elif strategy == "PARTITION_BY_ATTRIBUTE":
        node = F.pmod(F.xxhash64(F.col(attribute)), F.lit(nodes))
    elif strategy == "SINGLE_NODE":
        node = F.lit(0)
    elif strategy == "DO_NOT_LOAD_BALANCE":
        node = F.col(home)
    else:
        raise ValueError(f"unsupported load balance strategy: {strategy}")
    return df.withColumn("node", node.cast("int"))


def hash_content(records: DataFrame, content: str, attribute: str = "content.hash") -> DataFrame:
    """Add the SHA-256 of the content as an attribute and the relationship taken.

    Records without content cannot be hashed and leave on ``failure``.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    named = F.create_map(F.lit(attribute), digest)
    if "attributes" in records.columns:
        kept = F.map_filter("attributes", lambda k, v: k != attribute)
        named = F.map_concat(kept, named)
    return records.withColumn("attributes", named).withColumn(
        "relationship", F.when(F.col(content).isNull(), "failure").otherwise("success")
    )


# The example flow as relationships its vertices end, and its connections
# (name, source, destination, selected relationships).
HASH_FLOW_ENDED = {"generate": (), "hash": ("failure",), "log": ("success",)}
HASH_FLOW_EDGES = (
    ("generate-to-hash", "generate", "hash", ("success",)),
    ("hash-to-log", "hash", "log", ("success",)),
)


def route_from(records: DataFrame, source: str, edges: tuple, ended: tuple = ()) -> DataFrame:
    """``route`` out of one vertex of a flow that is fixed while the plan is built.

    The connections of a fixed flow are literals, so a record finds its own without a
    join: nothing is shuffled, however large the records are. Records whose
    ``relationship`` is ended or taken by no connection are dropped.
    """
    taken = [
        F.when(
            F.col("relationship").isin(*selected) & ~F.col("relationship").isin(*ended),
            F.struct(F.lit(name).alias("connection_id"), F.lit(to).alias("destination_id")),
        )
        for name, start, to, selected in edges
        if start == source
    ]
    kept = [c for c in records.columns if c not in ("connection_id", "destination_id")]
    found = F.array_compact(F.array(*taken))
    return unnest(records, kept, found, "_edge").select(*kept, "_edge.*")


def hash_flow(records: DataFrame, content: str) -> DataFrame:
    """The example flow end to end: records in, hashed, routed on success to the log.

    Returns the records that reach the log with their hash in ``content_hash`` and the
    connection they came by.
    """
    emitted = records.withColumn("relationship", F.lit("success"))
    queued = route_from(emitted, "generate", HASH_FLOW_EDGES, HASH_FLOW_ENDED["generate"])
    hashed = hash_content(queued, content)
    return route_from(hashed, "hash", HASH_FLOW_EDGES, HASH_FLOW_ENDED["hash"]).withColumn(
        "content_hash", F.element_at("attributes", "content.hash")
    )


LOG_LEVELS = ("trace", "debug", "info", "warn", "error")


def log_lines(records: DataFrame, level: str, payload: str | None = None) -> DataFrame:
    """Log records: level, attributes as JSON and, if a column is named, the payload."""
    if level not in LOG_LEVELS:
        raise ValueError(f"unsupported log level: {level}")
    rest = [c for c in records.columns if c not in ("attributes", payload)]
    content = F.col(payload).cast("string") if payload else F.lit(None).cast("string")
    return records.select(
        *rest,
        F.lit(level).alias("level"),
        F.to_json("attributes").alias("attributes"),
        content.alias("payload"),
    )
