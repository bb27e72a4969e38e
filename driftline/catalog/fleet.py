"""Queries over all kinds at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog import flows as W
from driftline.catalog import properties as P
from driftline.catalog.common import GROUPS_SQL, component_counts, desired_groups, joined, observed_groups, query
from driftline.plans.reconcile import fleet, reconcile


def _plan_sql(kind: str, key: str, present: str, reasons: str, source: str) -> str:
    """Actions of one kind out of a query that has its reasons."""
    return f"""SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key,
 CASE WHEN NOT ({present}) THEN 'CREATE' WHEN {reasons} <> '' THEN 'UPDATE' ELSE 'NOOP' END AS action,
 CASE WHEN {present} THEN array_to_string(list_sort(string_split({reasons}, ',')), ',') ELSE '' END AS reasons FROM ({source})"""


FLEET_SQL = "\nUNION ALL ".join([
    _plan_sql("ProcessGroup", "key", "present", "reasons", f"WITH {GROUPS_SQL} SELECT * FROM gr"),
    _plan_sql("Processor", "user_id", "present", "reasons", f"WITH {P.PROCESSOR_SQL} SELECT * FROM xf"),
    _plan_sql("ControllerService", "user_id", "present", "reasons", f"WITH {P.SERVICE_SQL} SELECT * FROM sf"),
    _plan_sql("ParameterContext", "user_id", "present", "reasons", f"{P.CONTEXT_SQL} SELECT user_id, have IS NOT NULL AS present, coalesce(reasons, '') AS reasons FROM e LEFT JOIN g USING (user_id)"),
    _plan_sql("Connection", "user_id", "true", "reasons", f"WITH {P.CONNECTION_SQL} SELECT user_id, concat_ws(',', r1, r2, r3, r4) AS reasons FROM cn"),
    _plan_sql("RegistryFlow", "conv_id", "true", "reasons", f"WITH {W.FLOW_SQL} SELECT * FROM fs"),
])


@query("fleet_actions", FLEET_SQL)
def fleet_actions(spark, folder):
    """The reconcile of all six kinds as one table."""
    groups = desired_groups(spark, folder)
    seen = observed_groups(groups.join(component_counts(spark, folder), "key"))
    sides = {"ProcessGroup": (groups.select("key", "desired"), seen.select("key", "observed"))}
    for kind, rows, key in (
        ("Processor", P.processors, "user_id"), ("ControllerService", P.services, "user_id"),
        ("ParameterContext", P.contexts, "user_id"), ("Connection", P.connections, "user_id"), ("RegistryFlow", W.flows, "conv_id"),
    ):
        both = rows(spark, folder).withColumnRenamed(key, "key")
        sides[kind] = both.select("key", "desired"), both.where("observed IS NOT NULL").select("key", "observed")
    plans = {kind: reconcile(want, have, kind, "key", unique=True) for kind, (want, have) in sides.items()}
    return fleet(plans, "key").select("kind", "key", "action", joined(F.array_sort("reasons")).alias("reasons"))
