"""Which action each resource needs, its steps in order, and applying it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import scalars as X
from driftline.functions.unnest import unnest
from driftline.operators.drift import drift
from driftline.operators.observe import observe

POLICY_NAMES = {"CREATE": "Create", "UPDATE": "Update", "DELETE": "Delete"}


def plan_action(df: DataFrame) -> DataFrame:
    """Add ``action`` (CREATE, UPDATE, DELETE, NOOP, ERROR) and ``allowed``.

    Reads ``exists`` and ``up_to_date`` and, where present, ``error``,
    ``deletion_requested`` and ``managementPolicies``. An action the policies forbid
    becomes NOOP with ``allowed`` false. A deletion of what is gone has nothing to do.
    """
    has = set(df.columns)
    gone = F.coalesce("deletion_requested", F.lit(False)) if "deletion_requested" in has else F.lit(False)
    wanted = (
        F.when(gone, F.when(F.col("exists"), "DELETE").otherwise("NOOP"))
        .when(~F.col("exists"), "CREATE")
        .when(~F.col("up_to_date"), "UPDATE")
        .otherwise("NOOP")
    )
    if "error" in has:
        wanted = F.when(F.col("error").isNotNull(), "ERROR").otherwise(wanted)
    if "managementPolicies" not in has:
        return df.withColumn("action", wanted).withColumn("allowed", F.lit(True))
    needs = F.lit(None).cast("string")
    for action, policy in POLICY_NAMES.items():
        needs = F.when(F.col("_wanted") == action, F.lit(policy)).otherwise(needs)
    allowed = needs.isNull() | X.policy_allows(F.col("managementPolicies"), needs)
    return (
        df.withColumn("_wanted", wanted)
        .withColumn("allowed", allowed)
        .withColumn("action", F.when(F.col("allowed"), F.col("_wanted")).otherwise("NOOP"))
        .drop("_wanted")
    )


class Steps(NamedTuple):
    """Step lists of a kind for its three actions, as ``array<string>`` columns."""

    create: Column
    update: Column
    delete: Column


def _steps(*parts: str | tuple[Column, tuple[str, ...]], done: tuple[str, ...] = ()) -> Column:
    """Fixed steps and steps under a condition (null is false), in order.

    A choice between whole lists, which Spark folds to constants, instead of lists put
    together row by row.
    """
    if not parts:
        listed = F.array(*[F.lit(n) for n in done])
        return listed if done else listed.cast("array<string>")
    head, *rest = parts
    if isinstance(head, str):
        return _steps(*rest, done=(*done, head))
    condition, names = head
    return F.when(condition, _steps(*rest, done=(*done, *names))).otherwise(
        _steps(*rest, done=done)
    )


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def processor_steps(d: Column, o: Column) -> Steps:
    run = X.default_state(d["desiredState"], "Processor") == "RUNNING"
    # Only the exact upper-case text stops a processor before its deletion.
    running = F.coalesce(o["status"]["runStatus"], F.lit("")) == "RUNNING"
    return Steps(
        create=_steps("POST"),
        update=_steps("STOP", "REFRESH", "PUT", (run, ("START",))),
        delete=_steps((running, ("STOP", "REFRESH")), "DELETE"),
    )


def service_steps(d: Column, o: Column) -> Steps:
    enable = X.default_state(d["desiredState"], "ControllerService") == "ENABLED"
    enabled = F.coalesce(o["component"]["state"], F.lit("")) == "ENABLED"
    return Steps(
        create=_steps("POST", (enable, ("ENABLE",))),
        update=_steps((enabled, ("DISABLE", "REFRESH")), "PUT", (enable, ("ENABLE",))),
        delete=_steps((enabled, ("DISABLE", "REFRESH")), "DELETE"),
    )


def _schedule(state: Column, o: Column) -> list[tuple[Column, tuple[str, ...]]]:
    return [
        ((state == "RUNNING") & (_count(o["stoppedCount"]) > 0), ("SCHEDULE_RUNNING",)),
        ((state == "STOPPED") & (_count(o["runningCount"]) > 0), ("SCHEDULE_STOPPED",)),
    ]


def group_steps(d: Column, o: Column) -> Steps:
    state = X.default_state(d["desiredState"], "ProcessGroup")
    return Steps(
        create=_steps("POST"),
        update=_steps("PUT", *_schedule(state, o)),
        delete=_steps((_count(o["runningCount"]) > 0, ("SCHEDULE_STOPPED", "REFRESH")), "DELETE"),
    )


def flow_steps(d: Column, o: Column) -> Steps:
    """``runningCount`` and ``stoppedCount`` must be the counts of the fresh group."""
    state = X.default_state(d["desiredState"], "RegistryFlow")
    version = _count(d["flowVersion"])
    moved = (version > 0) & (version != _count(o["currentVersion"]))
    known = o["versionControlInformation"].isNotNull()
    return Steps(
        create=_steps("IMPORT", (state == "RUNNING", ("SCHEDULE_RUNNING",))),
        update=_steps(
            (moved, ("GET_VCI",)), (moved & known, ("CHANGE_VERSION",)), "GET_GROUP",
            *_schedule(state, o),
        ),
        delete=_steps("SCHEDULE_STOPPED", "REFRESH", "DELETE"),
    )


def simple_steps(d: Column, o: Column) -> Steps:
    return Steps(create=_steps("POST"), update=_steps("PUT"), delete=_steps("DELETE"))


STEP_RULES: dict[str, Callable[[Column, Column], Steps]] = {
    "Processor": processor_steps,
    "ControllerService": service_steps,
    "ProcessGroup": group_steps,
    "RegistryFlow": flow_steps,
    "Connection": simple_steps,
    "ParameterContext": simple_steps,
}


def plan_steps(
    df: DataFrame, kind: str, desired: str = "desired", observed: str = "observed"
) -> DataFrame:
    """Add ``steps``, the ordered calls the action of each row takes."""
    rule = STEP_RULES[kind](F.col(desired), F.col(observed))
    action = F.col("action")
    return df.withColumn(
        "steps",
        F.when(action == "CREATE", rule.create)
        .when(action == "UPDATE", rule.update)
        .when(action == "DELETE", rule.delete)
        .otherwise(F.array().cast("array<string>")),
    )


def step_order(plan: DataFrame, key: list[str]) -> DataFrame:
    """One row per step with its position in the plan, counted from 0."""
    return unnest(plan, key, "steps", "step", "position")


def classify_writes(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Add ``outcome`` and ``new_revision`` to a batch of writes.

    ``current`` has ``key`` and ``revision``; ``batch`` has ``key``, ``revision`` as
    submitted, a unique ``seq`` and, optionally, ``op`` (``PUT`` or ``DELETE``). All
    writers of a batch saw the same state: of the writes that submit the current
    revision the first by ``seq`` is ``applied``, every other one is a ``conflict``. A put
    of revision 0 creates a record that does not exist; any other write to one that
    does not exist, and any write without a key, is ``not_found``.

    Writes meet ``current`` once, as the side that the adaptive skew join splits where a key is
    hot; those that fit are reduced to the first of each key inside every task, and
    winners are matched on (key, seq). Both uses of the first join read the same shuffles.
    """
    is_put = F.col("op") == "PUT" if "op" in batch.columns else F.lit(True)
    named = F.col(key).isNotNull()
    known = current.where(named).select(key, F.col("revision").alias("_current"), F.lit(True).alias("_known"))
    creates = named & (F.col("revision") == 0) & is_put
    seen = batch.join(known, key, "left").withColumn(
        "_fits", F.coalesce(F.when(F.col("_known"), F.col("_current") == F.col("revision")).otherwise(creates), F.lit(False))
    )
    winners = seen.where("_fits").groupBy(key).agg(F.min("seq").alias("seq")).withColumn("_won", F.lit(True))
    new = F.when(F.col("_known"), F.col("_current") + 1).otherwise(0).cast("bigint")
    may_create = F.coalesce(creates, F.lit(False))
    return (
        seen.join(winners, [key, "seq"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("_won"), "applied")
            .when(F.col("_known").isNull() & ~may_create, "not_found")
            .otherwise("conflict"),
        )
        .withColumn("new_revision", F.when(F.col("_won") & is_put, new))
        .drop("_current", "_known", "_fits", "_won")
    )


def next_snapshot(current: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """``current`` after the applied writes: put rows, deleted rows gone, the rest kept."""
    fields = ["revision", *[c for c in current.columns if c not in (key, "revision")]]
    applied = writes.where("outcome = 'applied'").select(
        key,
        F.struct(
            F.col("new_revision").alias("revision"), *[F.col(c) for c in fields[1:]]
        ).alias("_put"),
    )
    both = current.select(key, F.struct(*fields).alias("_old")).join(applied, key, "full_outer")
    gone = F.col("_put").isNotNull() & F.col("_put.revision").isNull()
    return both.where(~gone).select(
        key, *[F.when(F.col("_put").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_put.{c}")).alias(c) for c in fields]
    )


def apply_checked(
    current: DataFrame, batch: DataFrame, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revision-checked apply: (applied writes, refused writes, next snapshot)."""
    writes = classify_writes(current, batch, key)
    return (
        writes.where("outcome = 'applied'"),
        writes.where("outcome <> 'applied'"),
        next_snapshot(current, writes, key),
    )


def _overlay(observed: Column, desired: Column) -> Column:
    """Observed properties after a put of the non-null desired ones."""
    sent = F.coalesce(X.drop_null_props(desired), F.create_map().cast("map<string,string>"))
    have = F.coalesce(observed, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(have, lambda k, v: ~F.map_contains_key(sent, k))
    return F.map_concat(kept, sent)


def _if_set(want: Column, have: Column, unset: str | int = "") -> Column:
    return F.when(F.coalesce(want, F.lit(unset)) != F.lit(unset), want).otherwise(have)


def _has(step: str) -> Column:
    return F.array_contains("steps", step)


def _after(kind: str, d: Column, o: Column) -> Column:
    """The observed record after the steps of an update."""
    name = F.coalesce(d["name"], F.lit("")) if kind != "RegistryFlow" else None
    if kind == "Processor":
        want, have = d["config"], o["component"]["config"]
        config = F.struct(
            _overlay(have["properties"], want["properties"]).alias("properties"),
            *[
                _if_set(want[n], have[n]).alias(n)
                for n in ("schedulingStrategy", "schedulingPeriod")
            ],
        )
        state = F.when(_has("START"), "Running").otherwise("Stopped")
        return (
            o.withField("component.name", name)
            .withField("component.config", F.when(want.isNull(), have).otherwise(config))
            .withField("status", F.struct(state.alias("runStatus")))
        )
    if kind == "ControllerService":
        state = (
            F.when(_has("ENABLE"), "ENABLED")
            .when(_has("DISABLE"), "DISABLED")
            .otherwise(o["component"]["state"])
        )
        return (
            o.withField("component.name", name)
            .withField(
                "component.properties", _overlay(o["component"]["properties"], d["properties"])
            )
            .withField("component.state", state)
        )
    if kind == "ProcessGroup":
        running, stopped = _count(o["runningCount"]), _count(o["stoppedCount"])
        up, down = _has("SCHEDULE_RUNNING"), _has("SCHEDULE_STOPPED")
        nothing = F.lit(0)
        return (
            o.withField("component.name", name)
            .withField("component.comments", _if_set(d["comments"], o["component"]["comments"]))
            .withField(
                "runningCount",
                F.when(up, running + stopped).when(down, nothing).otherwise(running).cast("int"),
            )
            .withField(
                "stoppedCount",
                F.when(up, nothing).when(down, running + stopped).otherwise(stopped).cast("int"),
            )
        )
    if kind == "Connection":
        after = o
        for field, unset in (
            ("name", ""), ("flowFileExpiration", ""),
            ("backPressureObjectThreshold", 0), ("backPressureDataSizeThreshold", ""),
        ):
            after = after.withField(
                f"component.{field}", _if_set(d[field], o["component"][field], unset)
            )
        return after
    if kind == "ParameterContext":
        sent = F.transform(
            d["parameters"],
            lambda p: F.struct(
                F.struct(
                    p["name"].alias("name"),
                    p["value"].alias("value"),
                    F.coalesce(p["description"], F.lit("")).alias("description"),
                ).alias("parameter")
            ),
        )
        return (
            o.withField("component.name", name)
            .withField(
                "component.description", _if_set(d["description"], o["component"]["description"])
            )
            .withField("component.parameters", sent)
        )
    return o.withField(
        "currentVersion",
        F.when(_has("CHANGE_VERSION"), d["flowVersion"]).otherwise(o["currentVersion"]),
    )


def converge(planned: DataFrame, kind: str) -> DataFrame:
    """Observe again after the planned updates took effect.

    ``planned`` comes from ``plan_steps``. Rows with an UPDATE get the observed record
    their steps leave behind; ``reasons`` and ``up_to_date`` are then computed anew.
    What still drifts can never converge: a null property whose key is absent, a
    processor that wants DISABLED.
    """
    updated = planned.withColumn(
        "observed",
        F.when(
            F.col("action") == "UPDATE", _after(kind, F.col("desired"), F.col("observed"))
        ).otherwise(F.col("observed")),
    ).drop("reasons", "up_to_date")
    return drift(updated, kind)


def outstanding_writes(planned: DataFrame, later: DataFrame, kind: str, key: str, row_id: str | None = None) -> DataFrame:
    """What the next observation shows of each planned write: key, action, ``before``, ``after`` and ``outcome``.

    ``planned`` comes from ``plan_steps``, ``later`` has ``key`` and ``observed``, one row per key, and where a
    lookup failed what ``observe`` takes. A create or update is ``done`` when nothing drifts any
    more, ``drifting`` by the reasons in ``after``, or ``missing``; a delete is ``done`` when
    the record is gone and ``present`` otherwise. After a failed lookup the outcome is ``unknown``. Rows without a
    key match nothing; a column of ``planned`` named in ``row_id`` spreads them and is kept.
    """
    kept = [key] if row_id in (None, key) else [key, row_id]
    writes = planned.where(F.col("action").isin("CREATE", "UPDATE", "DELETE")).select(*kept, "desired", "action", F.col("reasons").alias("before"))
    again = drift(observe(writes, later, key, row_id, unique=True), kind)
    deletes = F.col("action") == "DELETE"
    outcome = (
        F.when(F.col("error").isNotNull(), "unknown")
        .when(~F.col("exists"), F.when(deletes, "done").otherwise("missing"))
        .when(deletes, "present")
        .when(F.col("up_to_date"), "done")
        .otherwise("drifting")
    )
    return again.select(*kept, "action", "before", F.col("reasons").alias("after"), outcome.alias("outcome"))
