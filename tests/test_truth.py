"""Truth tables of the comparisons, one case per row, and the quirks of the contract."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import compare as C
from driftline.functions import scalars as X
from driftline.kinds import KINDS
from driftline.operators import planning
from driftline.operators.drift import drift
from driftline.operators.observe import observe
from driftline.operators.payloads import build_payload
from driftline.operators.validation import validate, validate_typed
from driftline.sources.readers import project_observed

FLOW_OBSERVED = (
    "currentVersion INT, runningCount INT, stoppedCount INT, versionControlInformation STRUCT<state STRING>"
)


def sides(spark, kind, rows):
    """Rows of (desired, observed) dictionaries; absent fields are null."""
    entity = FLOW_OBSERVED if kind == "RegistryFlow" else S.ENTITY[kind]
    schema = f"n INT, desired STRUCT<{S.DESIRED[kind]}>, observed STRUCT<{entity}>"
    parsed = spark.createDataFrame(
        [(i, _json(d), _json(o)) for i, (d, o) in enumerate(rows)], "n int, d string, o string"
    )
    types = dict(spark.createDataFrame([], schema).dtypes)
    return parsed.select(
        "n",
        F.from_json("d", types["desired"]).alias("desired"),
        F.from_json("o", types["observed"]).alias("observed"),
    )


def _json(value):
    import json

    return None if value is None else json.dumps(value)


def reasons(spark, kind, rows):
    got = drift(sides(spark, kind, rows), kind).orderBy("n").collect()
    return [r["reasons"] for r in got]


def maps(spark, rows):
    df = spark.createDataFrame(
        [(i, d, o) for i, (d, o) in enumerate(rows)],
        "n int, d map<string,string>, o map<string,string>",
    )
    got = df.select("n", C.map_subset_diff(F.col("d"), F.col("o")).alias("r")).orderBy("n").collect()
    return [r["r"] for r in got]


def test_map_subset(spark):
    cases = [
        (({"a": "1"}, {"a": "1"}), []),
        (({"a": "1"}, {"a": "1", "b": "2"}), []),
        (({"a": "1"}, {"a": "2"}), ["property:a"]),
        (({"a": None}, {"a": "9"}), []),
        (({"a": None}, {"b": "9"}), ["property:a"]),
        (({"a": "1"}, {"a": None}), ["property:a"]),
        (({"a": ""}, {"a": None}), []),
        ((None, {"a": "1"}), []),
        (({}, {"a": "1"}), []),
        (({"a": "1"}, None), ["property:a"]),
        (({"b": "1", "a": "1", "c": None}, {"c": "x"}), ["property:a", "property:b"]),
    ]
    assert maps(spark, [c for c, _ in cases]) == [r for _, r in cases]


def processor(name="p", props=None, state=None, config=True, **more):
    desired = {"name": name}
    if config:
        desired["config"] = {"properties": props, **more}
    if state is not None:
        desired["desiredState"] = state
    return desired


def seen(name="p", props=None, state="Stopped", config=True, **more):
    component = {"name": name}
    if config:
        component["config"] = {"properties": props or {}, **more}
    entity = {"component": component}
    if state is not None:
        entity["status"] = {"runStatus": state}
    return entity


def test_processor(spark):
    cases = [
        (processor(), seen(), []),
        (processor("a"), seen("b"), ["name"]),
        (processor(), {"status": {"runStatus": "Running"}}, ["component"]),
        (processor(props={"a": "1"}), seen(config=False), ["config"]),
        (processor(config=False), seen(config=False), []),
        (processor(props={"a": "1"}, schedulingPeriod="5 sec"), seen(schedulingPeriod="6 sec"),
         ["property:a", "schedulingPeriod"]),
        (processor(schedulingPeriod=""), seen(schedulingPeriod="6 sec"), []),
        (processor(schedulingStrategy="CRON_DRIVEN"), seen(schedulingStrategy="TIMER_DRIVEN"), ["schedulingStrategy"]),
        (processor(state="RUNNING"), seen(state="Running"), []),
        (processor(state="RUNNING"), seen(state="Stopped"), ["state"]),
        (processor(state=""), seen(state="Stopped"), []),
        (processor(), seen(state="RUNNING"), ["state"]),
        (processor(state="RUNNING"), seen(state=None), []),
        # Fields outside the check stay ignored.
        (processor(comments="x", penaltyDuration="1 sec"), seen(), []),
    ]
    assert reasons(spark, "Processor", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def test_absent_side(spark):
    row = drift(sides(spark, "Processor", [(processor(), None)]), "Processor").first()
    assert row["reasons"] == [] and row["up_to_date"] is False


def test_connection(spark):
    full = {
        "component": {
            "name": "n", "flowFileExpiration": "0 sec", "backPressureObjectThreshold": 10000,
            "backPressureDataSizeThreshold": "1024 MB",
        }
    }
    cases = [
        ({}, full, []),
        ({"backPressureObjectThreshold": 0, "name": ""}, full, []),  # Q9: no way back to unset
        ({"backPressureDataSizeThreshold": "1 GB"}, full, ["backPressureDataSizeThreshold"]),
        ({"name": "m", "flowFileExpiration": "1 sec", "backPressureObjectThreshold": 1}, full,
         ["name", "flowFileExpiration", "backPressureObjectThreshold"]),
        ({"loadBalanceStrategy": "ROUND_ROBIN", "selectedRelationships": ["x"]}, full, []),
        ({}, {"id": "1"}, ["component"]),
    ]
    assert reasons(spark, "Connection", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def test_service(spark):
    have = lambda state, props=None: {"component": {"name": "s", "properties": props, "state": state}}
    cases = [
        ({"name": "s", "desiredState": "ENABLED"}, have("ENABLED"), []),
        ({"name": "s", "desiredState": "ENABLED"}, have("Enabled"), ["state"]),  # exact, unlike processors
        ({"name": "s", "desiredState": "ENABLED"}, have("ENABLING"), ["state"]),  # Q5
        ({"name": "s", "desiredState": ""}, have("DISABLED"), []),
        ({"name": "s", "properties": {"a": "1"}}, have("DISABLED"), ["property:a"]),
        ({"name": "t", "type": "x", "comments": "c"}, have("DISABLED"), ["name"]),
    ]
    assert reasons(spark, "ControllerService", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def test_group(spark):
    have = lambda run, stop, **m: {
        "component": {"name": "g", "comments": "c"}, "runningCount": run, "stoppedCount": stop, **m
    }
    want = lambda state, **m: {"name": "g", "desiredState": state, **m}
    cases = [
        (want("RUNNING"), have(1, 1), ["stopped_count"]),
        (want("RUNNING"), have(1, 0, invalidCount=5, disabledCount=5), []),
        (want("STOPPED"), have(1, 1), ["running_count"]),
        (want(""), have(1, 0), ["running_count"]),
        (want("DISABLED"), have(9, 9), []),  # Q6
        (want("STOPPED", comments="d"), have(0, 1), ["comments"]),
        (want("STOPPED", comments=""), have(0, 1), []),
        (want("STOPPED"), {"component": {"name": "g"}}, []),
    ]
    assert reasons(spark, "ProcessGroup", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def test_context(spark):
    def want(*params, **m):
        return {"name": "c", "parameters": list(params), **m}

    def have(*params, description=None):
        listed = [None if p is None else {"parameter": p} for p in params]
        return {"component": {"name": "c", "description": description, "parameters": listed}}

    p = lambda name, value=None, description=None: {"name": name, "value": value, "description": description}
    cases = [
        (want(p("a", "1")), have(p("a", "1")), []),
        (want(p("a", "1")), have(p("a", None)), []),  # Q10: masked
        (want(p("a", None)), have(p("a", "1")), []),
        (want(p("a", "1")), have(p("a", "2")), ["parameter_value:a"]),
        (want(p("a", "1"), p("b", "1")), have(p("a", "1"), p("b", "1"), p("c", "1")), ["parameter_count"]),
        (want(p("a", "1")), have(p("b", "1")), ["parameter:a"]),
        (want(p("a", "1", "x")), have(p("a", "1", "y")), ["parameter_description:a"]),
        (want(p("a", "1", "")), have(p("a", "1", "y")), []),
        (want(p("a", "1", "x")), have(p("a", "1", None)), []),
        (want(p("a", "1"), p("b", "1")), have(p("a", "9"), p("a", "1")), ["parameter:b"]),  # last of a name
        (want(p("a", "1")), have(None), ["parameter:a"]),  # counts, never matches
        ({"name": "c"}, have(), []),
        ({"name": "c", "description": "d"}, have(description="e"), ["description"]),
        ({"name": "c", "description": ""}, have(description="e"), []),
        ({"name": "c", "inheritedParameterContexts": ["x"]}, have(), []),
    ]
    assert reasons(spark, "ParameterContext", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def test_flow(spark):
    cases = [
        ({"flowVersion": 0}, {"currentVersion": 7}, []),
        ({"flowVersion": -1}, {"currentVersion": 7}, []),
        ({}, {"currentVersion": 7}, []),
        ({"flowVersion": 3}, {"currentVersion": 2}, ["flowVersion"]),
        ({"flowVersion": 3}, {"currentVersion": 3}, []),
        ({"flowVersion": 3}, {"runningCount": 1}, ["flowVersion"]),
        ({"flowVersion": 3, "desiredState": "RUNNING"}, {"currentVersion": 3, "stoppedCount": 4}, []),  # Q7
    ]
    assert reasons(spark, "RegistryFlow", [(d, o) for d, o, _ in cases]) == [r for *_, r in cases]


def steps(spark, kind, rows):
    df = sides(spark, kind, [(d, o) for _, d, o in rows])
    actions = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(rows)], "n int, action string")
    got = planning.plan_steps(df.join(actions, "n"), kind).orderBy("n").collect()
    return [",".join(r["steps"]) for r in got]


def test_steps(spark):
    run, stop = {"desiredState": "RUNNING"}, {"desiredState": "STOPPED"}
    status = lambda s: {"status": {"runStatus": s}}
    assert steps(spark, "Processor", [
        ("CREATE", run, None),  # Q3: not started here
        ("UPDATE", run, status("Running")),
        ("UPDATE", {"desiredState": "DISABLED"}, status("Running")),  # Q2
        ("UPDATE", {}, status("Running")),
        ("DELETE", run, status("RUNNING")),
        ("DELETE", run, status("Running")),  # Q4: mixed case is not stopped
        ("DELETE", run, {"id": "1"}),
        ("NOOP", run, status("Running")),
    ]) == ["POST", "STOP,REFRESH,PUT,START", "STOP,REFRESH,PUT", "STOP,REFRESH,PUT", "STOP,REFRESH,DELETE",
           "DELETE", "DELETE", ""]
    on, have = {"desiredState": "ENABLED"}, lambda s: {"component": {"state": s}}
    assert steps(spark, "ControllerService", [
        ("CREATE", on, None), ("CREATE", {}, None), ("UPDATE", on, have("ENABLED")),
        ("UPDATE", {}, have("ENABLED")), ("UPDATE", on, have("DISABLED")), ("DELETE", on, have("ENABLED")),
        ("DELETE", on, have("ENABLING")),
    ]) == ["POST,ENABLE", "POST", "DISABLE,REFRESH,PUT,ENABLE", "DISABLE,REFRESH,PUT", "PUT,ENABLE",
           "DISABLE,REFRESH,DELETE", "DELETE"]
    counts = lambda r, s: {"runningCount": r, "stoppedCount": s}
    assert steps(spark, "ProcessGroup", [
        ("CREATE", run, None), ("UPDATE", run, counts(0, 2)), ("UPDATE", stop, counts(2, 2)),
        ("UPDATE", {}, counts(1, 0)), ("UPDATE", {"desiredState": "DISABLED"}, counts(2, 2)),
        ("DELETE", run, counts(2, 0)), ("DELETE", run, counts(0, 3)),
    ]) == ["POST", "PUT,SCHEDULE_RUNNING", "PUT,SCHEDULE_STOPPED", "PUT,SCHEDULE_STOPPED", "PUT",
           "SCHEDULE_STOPPED,REFRESH,DELETE", "DELETE"]
    info = {"versionControlInformation": {"state": "STALE"}}
    assert steps(spark, "RegistryFlow", [
        ("CREATE", run, None), ("CREATE", {}, None),
        ("UPDATE", {"flowVersion": 2, **run}, {"currentVersion": 1, **counts(0, 1), **info}),
        ("UPDATE", {"flowVersion": 2}, {"currentVersion": 1, **counts(1, 0)}),
        ("UPDATE", {"flowVersion": 0}, {"currentVersion": 1, **counts(0, 1), **info}),
        ("DELETE", run, counts(0, 0)),
    ]) == ["IMPORT,SCHEDULE_RUNNING", "IMPORT", "GET_VCI,CHANGE_VERSION,GET_GROUP,SCHEDULE_RUNNING",
           "GET_VCI,GET_GROUP,SCHEDULE_STOPPED", "GET_GROUP", "SCHEDULE_STOPPED,REFRESH,DELETE"]
    for kind in ("Connection", "ParameterContext"):
        assert steps(spark, kind, [("CREATE", {}, None), ("UPDATE", {}, None), ("DELETE", {}, None)]) == [
            "POST", "PUT", "DELETE"]


def test_actions(spark):
    rows = [
        (False, False, None, False, None, "CREATE", True),
        (True, False, None, False, None, "UPDATE", True),
        (True, True, None, False, None, "NOOP", True),
        (True, True, None, True, None, "DELETE", True),
        (False, False, None, True, None, "NOOP", True),
        (False, False, "boom", False, None, "ERROR", True),
        (True, False, None, False, ["Observe"], "NOOP", False),
        (True, False, None, False, ["Observe", "Update"], "UPDATE", True),
        (True, True, None, False, ["Observe"], "NOOP", True),
        (True, True, None, True, ["Observe", "Create", "Update"], "NOOP", False),
    ]
    df = spark.createDataFrame(
        rows,
        "exists boolean, up_to_date boolean, error string, deletion_requested boolean, "
        "managementPolicies array<string>, want string, want_allowed boolean",
    )
    for r in planning.plan_action(df).collect():
        assert (r["action"], r["allowed"]) == (r["want"], r["want_allowed"]), r


def converged(spark, kind, desired, observed):
    rows = drift(sides(spark, kind, [(desired, observed)]), kind).withColumn("exists", F.lit(True))
    plan = planning.plan_steps(planning.plan_action(rows), kind)
    return planning.converge(plan, kind).first()["reasons"]


def test_converge(spark):
    assert converged(spark, "Processor", processor(props={"a": None}), seen()) == ["property:a"]  # Q1
    assert converged(spark, "Processor", processor(state="DISABLED"), seen()) == ["state"]  # Q2
    assert converged(spark, "Processor", processor("x", {"a": "1"}, "RUNNING", schedulingPeriod="1 sec"), seen()) == []
    assert converged(spark, "ControllerService", {"name": "s", "desiredState": "ENABLED", "properties": {"a": "1"}},
                     {"component": {"name": "t", "state": "ENABLING", "properties": {"b": "2"}}}) == []
    assert converged(spark, "ProcessGroup", {"name": "g", "desiredState": "RUNNING", "comments": "c"},
                     {"component": {"name": "h"}, "stoppedCount": 3, "runningCount": 1}) == []
    assert converged(spark, "Connection", {"name": "n", "backPressureObjectThreshold": 5},
                     {"component": {"name": "m", "backPressureObjectThreshold": 6}}) == []
    assert converged(spark, "ParameterContext", {"name": "c", "parameters": [{"name": "a", "value": "1"}]},
                     {"component": {"name": "d"}}) == []
    assert converged(spark, "RegistryFlow", {"flowVersion": 3},
                     {"currentVersion": 1, "versionControlInformation": {"state": "x"}}) == []
    # Without version information the version is never changed.
    assert converged(spark, "RegistryFlow", {"flowVersion": 3}, {"currentVersion": 1}) == ["flowVersion"]


def test_group_and_children_fight(spark):
    """Q16: a group that wants RUNNING undoes children that want STOPPED, and back."""
    group = drift(sides(spark, "ProcessGroup", [({"name": "g", "desiredState": "RUNNING"},
                  {"component": {"name": "g"}, "stoppedCount": 1})]), "ProcessGroup").first()
    child = drift(sides(spark, "Processor", [(processor(state="STOPPED"), seen(state="Running"))]), "Processor").first()
    assert group["reasons"] == ["stopped_count"] and child["reasons"] == ["state"]


@pytest.mark.parametrize(
    "status, text, status_text, want",
    [
        (404, "x", None, "NOT_FOUND"),
        (500, "x", None, "API_ERROR"),
        (None, "get processor 4404 failed", None, "NOT_FOUND"),  # Q11
        (None, "get processor 4404 failed", "409 Conflict", "API_ERROR"),
        (None, "x", "404 Not Found", "NOT_FOUND"),
        (None, None, None, "API_ERROR"),
    ],
)
def test_classify(spark, status, text, status_text, want):
    df = spark.createDataFrame([(status, text, status_text)], "s int, t string, st string")
    assert df.select(X.classify_error(F.col("s"), F.col("t"), F.col("st"))).first()[0] == want


def test_error_context(spark):
    df = spark.createDataFrame([(500, "boom", None, None), (None, "raw", "409 Conflict", "body"), (404, "x", None, None)],
                               "s int, t string, st string, b string")
    message = X.error_context(F.lit("get connection"), F.lit("7"), F.col("s"), F.col("t"), F.col("st"), F.col("b"), "Acme")
    assert [r[0] for r in df.select(message).collect()] == [
        "Acme API error: get connection 7: boom",
        "Acme API error: get connection 7 (body: body): 409 Conflict",
        "Acme resource not found: get connection 7",
    ]


def test_observe(spark):
    desired = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "gone"), (5, "lost"), (6, "bad")], "id int, name string")
    observed = spark.createDataFrame(
        [("a", 1, None, None), ("", 9, None, None), ("lost", None, 404, "x"), ("bad", None, 500, "x")],
        "name string, v int, http_status int, error_text string",
    ).withColumn("observed", F.when(F.col("v").isNotNull(), F.struct("v"))).drop("v")
    for row_id in (None, "id"):
        got = observe(desired, observed, "name", row_id).orderBy("id").collect()
        assert [(r["exists"], r["error"]) for r in got] == [
            (True, None), (False, None), (False, None), (False, None), (False, None), (False, "x")]
        assert len(got) == 6


def test_config(spark):
    cases = {
        '{"url":"https://x"}': None,
        '{"URL":"https://x"}': None,
        '{"url":""}': "url is required",
        "{}": "url is required",
        "null": "url is required",
        '{"url":5}': "cannot parse credentials",
        '{"url":"x","tlsSkipVerify":"yes"}': "cannot parse credentials",
        '{"url":"x","tlsSkipVerify":true,"extra":{}}': None,
        "[]": "cannot parse credentials",
        '"x"': "cannot parse credentials",
        "": "cannot parse credentials",
        '{"url":': "cannot parse credentials",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, want string")
    for r in df.select("*", X.config_problem(F.col("c")).alias("got")).collect():
        assert r["got"] == r["want"], r
    assert set(S.SYSTEM_VERSIONS) == {1, 2}  # Q13: declared, read by nothing


def test_project_observed(spark):
    rows = [
        ('{"id":"a","revision":{"version":3},"status":{"runStatus":"Running"},"component":{"validationStatus":"VALID","validationErrors":["e"]}}', 1),
        ('{"id":"a","status":{"runStatus":"Running"}}', 1),
        ('{"id":"a"}', 1),  # Q14
        ('{"id":', 1),
        ('{"id":"a","revision":{"version":"x"},"status":{}}', 1),
    ]
    df = spark.createDataFrame(rows, "entity string, prior_revision bigint")
    got = project_observed(df, "Processor").collect()
    assert [(r["revision"], r["run_state"], r["error"]) for r in got] == [
        (3, "Running", None), (1, "Running", None), (1, None, "entity has no status"),
        (1, None, "cannot decode entity"), (1, None, "cannot decode entity")]
    flow = spark.createDataFrame(
        [('{"versionControlInformation":{"version":3.9,"state":"STALE"}}', 1, False),
         ('{"versionControlInformation":{"version":"3","state":"OK"}}', 1, True), ('{"id":"x"}', 1, True)],
        "entity string, prior_current_version int, prior_stale boolean")
    got = project_observed(flow, "RegistryFlow").collect()
    assert [(r["current_version"], r["stale"]) for r in got] == [(3, True), (1, False), (1, True)]
    assert "latest_version" not in project_observed(flow, "RegistryFlow").columns  # Q8


def test_apply(spark):
    current = spark.createDataFrame([("a", 3, "x"), ("b", 0, "y")], "key string, revision bigint, v string")
    batch = spark.createDataFrame(
        [("a", 3, 2, "PUT", "late"), ("a", 3, 1, "PUT", "first"), ("a", 4, 0, "PUT", "ahead"),
         ("b", 0, 3, "DELETE", None), ("c", 0, 4, "PUT", "new"), ("c", 0, 5, "PUT", "again"),
         ("d", 1, 6, "PUT", "none"), ("e", 0, 7, "DELETE", None)],  # e: Q12
        "key string, revision bigint, seq int, op string, v string")
    applied, refused, after = planning.apply_checked(current, batch, "key")
    assert {(r["seq"], r["new_revision"]) for r in applied.collect()} == {(1, 4), (3, None), (4, 0)}
    assert {(r["seq"], r["outcome"]) for r in refused.collect()} == {
        (2, "conflict"), (0, "conflict"), (5, "conflict"), (6, "not_found"), (7, "not_found")}
    assert {tuple(r) for r in after.collect()} == {("a", 4, "first"), ("c", 0, "new")}


def test_payload_json(spark):
    rows = sides(spark, "Processor", [
        ({"name": "p", "type": "t", "parentGroupId": "g", "config": {"properties": {"a": "1", "b": None}}}, None),
        ({"name": "p"}, None)])
    got = [r[0] for r in build_payload(rows, "Processor").select(F.to_json("payload")).collect()]
    assert got == [
        '{"component":{"type":"t","name":"p","parentGroupId":"g","config":{"properties":{"a":"1"}}},"revision":{"version":0}}',
        '{"component":{"name":"p"},"revision":{"version":0}}']


def test_validate(spark):
    rows = sides(spark, "ParameterContext", [({"name": "c", "parameters": [{"value": "1"}]}, None), ({"name": ""}, None), (None, None)])
    got = [r["violations"] for r in validate(rows, "ParameterContext").orderBy("n").collect()]
    assert got == [["parameters[].name required"], [], ["forProvider required"]]
    rows = sides(spark, "Connection", [({"parentGroupId": "g", "source": {"id": "1", "type": "DISK"}, "loadBalanceStrategy": ""}, None)])
    refs = rows.withColumn("providerConfigRef", F.expr("named_struct('kind', 'ProviderConfig', 'name', string(null))"))
    assert validate(refs, "Connection").first()["violations"] == [
        "source.groupId required", "destination required", "source.type unsupported",
        "loadBalanceStrategy unsupported", "providerConfigRef.name required"]
    typed = spark.createDataFrame([('{"a":1,"m":{"x":"y"}}',), ('{"a":"1","m":{"x":2}}',), ("{",), (None,)], "j string")
    got = [r["violations"] for r in validate_typed(typed, "j", {"a": "number", "m": "string_map"}).collect()]
    assert got == [[], ["a not number", "m not string_map"], ["not JSON"], []]


def test_kinds():
    assert set(KINDS) == set(S.DESIRED) == set(S.ENTITY) == set(planning.STEP_RULES)
    assert KINDS["Processor"].default_state == "STOPPED" and KINDS["Connection"].default_state is None


def test_a_new_kind_is_data(spark, monkeypatch):
    from driftline import kinds

    funnel = kinds.KindSpec(name="Funnel", checks=(kinds.always("name"), kinds.when_set("size", 0)), required=("name",))
    monkeypatch.setitem(KINDS, "Funnel", funnel)
    monkeypatch.setitem(planning.STEP_RULES, "Funnel", planning.simple_steps)
    df = spark.sql("""SELECT true AS exists, named_struct('name', 'a', 'size', 2L) AS desired,
                      named_struct('component', named_struct('name', 'b', 'size', 2L)) AS observed""")
    row = planning.plan_steps(planning.plan_action(drift(df, "Funnel")), "Funnel").first()
    assert (row["reasons"], row["action"], row["steps"]) == (["name"], "UPDATE", ["PUT"])


def test_usage_type_of_cluster_configs(spark):
    """Q15: one usage type, also for configs of the cluster."""
    from driftline.operators.configs import usage_edges

    df = spark.sql("""SELECT 'ns' AS namespace, 'v1' AS apiVersion, 'Processor' AS kind, 'p' AS name, 'u' AS uid,
                      named_struct('kind', 'ClusterProviderConfig', 'name', 'default') AS providerConfigRef""")
    assert usage_edges(df.unionAll(df)).collect()[0]["namespace"] == "ns"
    assert usage_edges(df.unionAll(df)).count() == 1
