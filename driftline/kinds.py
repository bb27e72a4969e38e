"""What sets the kinds of resources apart, stated as data.

A new kind is a new ``KindSpec``; no operator changes for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import compare as C
from driftline.functions import scalars as X

Check = Callable[[Column, Column], Column]


def dig(record: Column, path: str) -> Column:
    """The field at a dotted path."""
    for name in path.split("."):
        record = record[name]
    return record


def always(name: str) -> Check:
    return lambda d, o: C.field_diff(d[name], o["component"][name], name)


def when_set(name: str, unset: str | int = "") -> Check:
    return lambda d, o: C.sparse_diff(d[name], o["component"][name], name, unset)


def processor_config(d: Column, o: Column) -> Column:
    want, have = d["config"], o["component"]["config"]
    compared = F.concat(
        C.map_subset_diff(want["properties"], have["properties"]),
        *[
            C.sparse_diff(want[name], have[name], name)
            for name in ("schedulingStrategy", "schedulingPeriod")
        ],
    )
    return (
        F.when(want.isNull(), C.no_reasons())
        .when(have.isNull(), F.array(F.lit("config")))
        .otherwise(compared)
    )


def processor_state(d: Column, o: Column) -> Column:
    want = X.default_state(d["desiredState"], "Processor")
    same = C.state_fold_equal(want, o["status"]["runStatus"])
    return C.reason(o["status"].isNotNull() & ~same, "state")


def service_properties(d: Column, o: Column) -> Column:
    return C.map_subset_diff(d["properties"], o["component"]["properties"])


def service_state(d: Column, o: Column) -> Column:
    want = X.default_state(d["desiredState"], "ControllerService")
    return C.reason(~C.state_exact_equal(want, o["component"]["state"]), "state")


def group_counts_check(d: Column, o: Column) -> Column:
    want = X.default_state(d["desiredState"], "ProcessGroup")
    return C.count_vs_state(want, o["runningCount"], o["stoppedCount"])


def context_parameters(d: Column, o: Column) -> Column:
    return C.named_list_diff(d["parameters"], o["component"]["parameters"])


def flow_version(d: Column, o: Column) -> Column:
    want = F.coalesce(d["flowVersion"], F.lit(0))
    return C.reason(
        (want > 0) & (want != F.coalesce(o["currentVersion"], F.lit(0))), "flowVersion"
    )


@dataclass(frozen=True)
class KindSpec:
    """One kind: its default state, its admission rules and its drift checks in order."""

    name: str
    checks: tuple[Check, ...]
    required: tuple[str, ...]
    enums: dict[str, tuple] = field(default_factory=dict)
    has_component: bool = True

    @property
    def default_state(self) -> str | None:
        return X.DEFAULT_STATES.get(self.name)


KINDS: dict[str, KindSpec] = {
    spec.name: spec
    for spec in (
        KindSpec(
            name="Processor",
            checks=(always("name"), processor_config, processor_state),
            required=("parentGroupId", "type", "name"),
            enums={
                "config.schedulingStrategy": S.SCHEDULING_STRATEGIES,
                "config.bulletinLevel": S.BULLETIN_LEVELS,
                "desiredState": S.RUN_STATES,
            },
        ),
        KindSpec(
            name="Connection",
            checks=(
                when_set("name"),
                when_set("flowFileExpiration"),
                when_set("backPressureObjectThreshold", unset=0),
                when_set("backPressureDataSizeThreshold"),
            ),
            required=(
                "parentGroupId",
                "source", "source.id", "source.type", "source.groupId",
                "destination", "destination.id", "destination.type", "destination.groupId",
            ),
            enums={
                "source.type": S.ENDPOINT_TYPES,
                "destination.type": S.ENDPOINT_TYPES,
                "loadBalanceStrategy": S.LOAD_BALANCE_STRATEGIES,
                "loadBalanceCompression": S.LOAD_BALANCE_COMPRESSIONS,
            },
        ),
        KindSpec(
            name="ControllerService",
            checks=(always("name"), service_properties, service_state),
            required=("parentGroupId", "type", "name"),
            enums={"desiredState": S.SERVICE_STATES},
        ),
        KindSpec(
            name="ProcessGroup",
            checks=(always("name"), when_set("comments"), group_counts_check),
            required=("parentGroupId", "name"),
            enums={"desiredState": S.RUN_STATES},
        ),
        KindSpec(
            name="ParameterContext",
            checks=(always("name"), when_set("description"), context_parameters),
            required=("name", "parameters[].name"),
        ),
        KindSpec(
            name="RegistryFlow",
            checks=(flow_version,),
            required=("parentGroupId", "registryId", "bucketId", "flowId"),
            enums={"desiredState": S.RUN_STATES},
            has_component=False,
        ),
    )
}
