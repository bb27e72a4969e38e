"""The whole reconcile as one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.drift import drift
from driftline.operators.observe import observe
from driftline.operators.planning import plan_action, plan_steps


def reconcile(
    desired: DataFrame, observed: DataFrame, kind: str, key: str, row_id: str | None = None,
    only_fetched: bool = False, unique: bool = False,
) -> DataFrame:
    """Observe, compare, decide and list the steps for every resource of a kind.

    ``desired`` has ``key`` and a ``desired`` struct, ``observed`` ``key`` and an
    ``observed`` struct; see ``observe`` for the rest. The join on the
    key is the only shuffle.
    """
    seen = observe(desired, observed, key, row_id, only_fetched, unique)
    return plan_steps(plan_action(drift(seen, kind)), kind)


def fleet(plans: dict[str, DataFrame], key: str) -> DataFrame:
    """Plans of several kinds as one table with the columns they share."""
    shared = ["exists", "error", "reasons", "up_to_date", "allowed", "action", "steps"]
    parts = [
        plan.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), *shared)
        for kind, plan in plans.items()
    ]
    return reduce(DataFrame.unionByName, parts)
