"""Bringing desired and observed records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.operators.changes import latest_revision


def _named(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key can be looked up: not null and not the empty text."""
    is_text = dict(df.dtypes)[key] == "string"
    return df.where(F.col(key) != "") if is_text else df.where(F.col(key).isNotNull())


def _lookup(
    desired: DataFrame, found: DataFrame, key: str, row_id: str | None, how: str
) -> DataFrame:
    """Join on the key; see ``observe`` for ``row_id``."""
    if row_id is None:
        return desired.join(found, key, how)
    nameless = F.col(key).isNull() | (F.col(key).cast("string") == "")
    spread = F.when(nameless, F.xxhash64(row_id)).otherwise(F.lit(0).cast("bigint"))
    # One struct, because a constant column of its own would be optimised out of the join.
    left = desired.withColumn("_at", F.struct(F.col(key).alias("key"), spread.alias("spread")))
    right = found.withColumn("_at", F.struct(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("spread")))
    return left.join(right.drop(key), "_at", how).drop("_at")


def newest_per_key(observed: DataFrame, key: str) -> DataFrame:
    """One row per key: the highest revision, then the greatest text of the row.

    Grouped by the key in a struct, so that a join by the key itself still has a plain
    shuffle of its own on this side, without which Spark could not split the other.
    """
    field = dict(observed.dtypes).get("observed", "")
    revision = F.col("observed.revision.version") if "revision:struct<version:" in field else F.lit(None).cast("bigint")
    text = F.to_json(F.struct(*[c for c in observed.columns if c != key]))
    marked = observed.withColumns({"_key": F.struct(key), "_revision": revision, "_text": text})
    return latest_revision(marked, ["_key"], "_revision", ["_text"]).drop("_key", "_revision", "_text")


def observe(
    desired: DataFrame, observed: DataFrame, key: str, row_id: str | None = None,
    only_fetched: bool = False, unique: bool = False,
) -> DataFrame:
    """``desired`` left-joined to ``observed`` on the external name ``key``.

    ``observed`` has an ``observed`` struct and, where a lookup failed, ``http_status``
    (outside 200 to 299) and ``error_text`` instead. Of several rows per key the one with the highest
    revision counts, and of equal ones a fixed one; ``unique`` promises that there is one. Adds ``exists`` and
    ``error``: an empty name, no row and a not-found failure all mean that the
    resource does not exist; any other failure is an error.

    The join is on the plain key, so ``unique`` tables bucketed by it meet without a shuffle.
    Rows without a name match nothing. Where they may be many, name a column in
    ``row_id``: they are then spread by it instead of meeting in one task.
    ``only_fetched`` keeps just the rows that ``observed`` speaks about.
    """
    found = _named(observed, key)
    found = (found if unique else newest_per_key(found, key)).withColumn("_fetched", F.lit(True))
    joined = _lookup(desired, found, key, row_id, "inner" if only_fetched else "left")
    fetched = F.coalesce("_fetched", F.lit(False))
    if "error_text" not in observed.columns:
        return (
            joined.withColumn("exists", fetched)
            .withColumn("error", F.lit(None).cast("string"))
            .drop("_fetched")
        )
    status = F.col("http_status")
    failed = F.col("error_text").isNotNull() | (status.isNotNull() & ~status.between(200, 299))
    lost = X.classify_error(F.col("http_status"), F.col("error_text")) == X.NOT_FOUND
    return (
        joined.withColumn("exists", fetched & ~failed)
        .withColumn("error", F.when(fetched & failed & ~lost, F.coalesce("error_text", F.lit(""))))
        .withColumn("observed", F.when(F.col("exists"), F.col("observed")))
        .drop("_fetched", "http_status", "error_text")
    )


def missing(desired: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Desired rows without an observed row: the candidates to create.

    Observed keys are made distinct first, so copies of one key collapse inside each
    task; the join then reuses that partitioning.
    """
    return desired.join(observed.select(key).distinct(), key, "left_anti")


def present(desired: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Desired rows that have an observed row; keys as in ``missing``."""
    return desired.join(observed.select(key).distinct(), key, "left_semi")


def flow_current(flows: DataFrame, info: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Current version and staleness of each flow.

    ``info`` holds ``version`` (variant), ``state`` and ``failed``. A failed or absent
    lookup, and an answer with neither version nor state, keep both prior values; a version
    that is no number keeps the prior one.
    """
    stated = F.col("version").isNotNull() | F.col("state").isNotNull()
    known = info.where(~F.col("failed") & stated).select(
        key, "version", "state", F.lit(True).alias("_known")
    )
    joined = flows.join(known, key, "left").join(
        prior.select(
            key,
            F.col("current_version").alias("_prior_version"),
            F.col("stale").alias("_prior_stale"),
        ),
        key,
        "left",
    )
    return (
        joined.withColumn(
            "current_version", X.number_to_int(F.col("version"), F.col("_prior_version"))
        )
        .withColumn(
            "stale",
            F.when(F.col("_known"), X.is_stale(F.col("state"))).otherwise(F.col("_prior_stale")),
        )
        .drop("version", "state", "_known", "_prior_version", "_prior_stale")
    )


def context_binding(groups: DataFrame, contexts: DataFrame) -> DataFrame:
    """Both directions of the group-to-context link, with a flag per side.

    ``groups`` has ``group_id`` and ``context_id`` (empty: none), ``contexts`` has
    ``context_id`` and ``bound_groups``. Keys are pairs and pairs are unique per
    side, so no pair can be hot.
    """
    declared = (
        _named(groups, "context_id")
        .select("group_id", "context_id")
        .distinct()
        .withColumn("declared", F.lit(True))
    )
    bound = (
        contexts.select("context_id", F.explode("bound_groups").alias("group_id"))
        .distinct()
        .withColumn("bound", F.lit(True))
    )
    return declared.join(bound, ["group_id", "context_id"], "full_outer").select(
        "group_id",
        "context_id",
        F.coalesce("declared", F.lit(False)).alias("declared"),
        F.coalesce("bound", F.lit(False)).alias("bound"),
    )
