"""Inherited parameters against a plain walk, writes looked at again, rates and skew of sources, manifests as a whole."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.operators import extensions, metrics, planning
from driftline.operators.drift import drift
from driftline.sources import readers

OWN = "context_id string, name string, value string"
LINKS = "context_id string, parent_id string, position int"


def inherited(spark, own, links):
    rows = extensions.inherited_params(spark.createDataFrame(own, OWN), spark.createDataFrame(links, LINKS)).collect()
    got = {(r["context_id"], r["name"]): (r["value"], r["inherited"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_inheritance_against_a_walk(spark):
    rng = random.Random(5)
    links = {c: rng.sample(range(c), min(c, rng.randrange(4))) for c in range(60)}
    own = {(c, n): f"{c}{n}" for c in links for n in "xyz" if rng.random() < 0.25}

    def find(c, n):
        if (c, n) in own:
            return own[c, n]
        return next((v for p in links[c] if (v := find(p, n)) is not None), None)

    want = {(str(c), n): (v, (c, n) not in own) for c in links for n in "xyz" if (v := find(c, n)) is not None}
    rows = [(str(c), str(p), i) for c, ps in links.items() for i, p in enumerate(ps)]
    assert inherited(spark, [(str(c), n, v) for (c, n), v in own.items()], rows + rows[:5]) == want


def test_inheritance_of_ties_nulls_and_nothing(spark):
    own = [("p", "n", "b"), ("q", "n", "a"), ("q", "n", "c"), (None, "n", "lost"), ("r", "m", None)]
    links = [("c", "p", 0), ("c", "q", 0), ("c", "r", 1), ("d", None, 0), (None, "p", 0), ("c", "c2", 2)]
    got = inherited(spark, own, links)
    assert got["c", "n"] == ("a", True) and got["q", "n"] == ("a", False) and got["c", "m"] == (None, True)
    assert ("d", "n") not in got
    assert inherited(spark, [], links) == {}
    assert inherited(spark, own[:1], []) == {("p", "n"): ("b", False)}


@pytest.mark.parametrize("links", [[("a", "a", 0)], [("a", "b", 0), ("b", "c", 0), ("c", "a", 0)], [(f"k{i}", f"k{(i + 1) % 9}", 0) for i in range(9)]])
def test_a_cycle_without_parameters_is_an_error(spark, links):
    with pytest.raises(ValueError, match="inherit"):
        inherited(spark, [("z", "p", "v")], [*links, ("y", "z", 0)])


def test_writes_looked_at_again(spark):
    flow = "struct<flowVersion:int,desiredState:string>"
    seen = "struct<currentVersion:int,versionControlInformation:string,runningCount:int,stoppedCount:int>"
    first = [("same", 3, 3, None), ("moved", 3, 1, None), ("stuck", 3, 1, None), ("gone", 3, 1, None), ("lost", 3, 1, None), ("new", 3, None, None), ("old", 3, 3, True), ("kept", 3, 3, True), (None, 3, None, None)]
    plan = spark.createDataFrame(
        [(k, (w, "STOPPED"), None if h is None else (h, "v", 0, 1), h is not None, d) for k, w, h, d in first],
        f"key string, desired {flow}, observed {seen}, exists boolean, deletion_requested boolean",
    )
    plan = planning.plan_steps(planning.plan_action(drift(plan, "RegistryFlow")), "RegistryFlow")
    later = spark.createDataFrame(
        [(k, v and (v, "v", 0, 1), s, e) for k, v, s, e in (
            ("same", 1, None, None), ("moved", 3, None, None), ("stuck", 2, None, None), ("lost", None, 500, "boom"), ("new", 3, None, None), ("kept", 3, None, None))],
        f"key string, observed {seen}, http_status int, error_text string",
    )
    rows = planning.outstanding_writes(plan, later, "RegistryFlow", "key").collect()
    assert {r["key"]: (r["action"], r["outcome"]) for r in rows} == {
        "moved": ("UPDATE", "done"), "stuck": ("UPDATE", "drifting"), "gone": ("UPDATE", "missing"), "lost": ("UPDATE", "unknown"),
        "new": ("CREATE", "done"), "old": ("DELETE", "done"), "kept": ("DELETE", "present"), None: ("CREATE", "missing"),
    }
    stuck = next(r for r in rows if r["key"] == "stuck")
    assert stuck["before"] == stuck["after"] == ["flowVersion"]
    spread = planning.outstanding_writes(plan.withColumn("id", F.monotonically_increasing_id()), later, "RegistryFlow", "key", "id")
    assert spread.drop("id").orderBy("key").collect() == planning.outstanding_writes(plan, later, "RegistryFlow", "key").orderBy("key").collect()


def test_rates_and_skew_of_awkward_rows(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([("a", at(1)), ("a", at(1, 59)), ("a", at(2)), ("a", None), (None, at(3)), ("b", None)], "source string, ts timestamp_ntz")
    got = {r["source"]: tuple(r)[1:] for r in metrics.source_rates(rows, "source", "ts").collect()}
    assert got == {"a": (4, at(1), at(2), 2, 2), None: (1, at(3), at(3), 1, 1), "b": (1, None, None, 0, None)}
    assert metrics.source_rates(rows.limit(0), "source", "ts").count() == 0
    got = {r["attribute"]: tuple(r)[1:] for r in metrics.attribute_skew(rows, ["source", "ts"]).collect()}
    assert got["source"] == (6, 3, "a", 4, 200)
    assert got["ts"] == (6, 5, None, 2, 166)
    ties = spark.createDataFrame([(None,), ("x",)], "v string")
    assert metrics.attribute_skew(ties, ["v"]).first()["commonest"] is None
    assert metrics.attribute_skew(ties.limit(0), ["v"]).count() == 0


def test_manifests_that_repeat_or_refer_to_nothing(spark):
    rows = [
        ("a", 0, '{"kind":"Processor","metadata":{"name":"p","namespace":"n"},"spec":{"providerConfigRef":{"kind":"ProviderConfig","name":"c"}}}'),
        ("b", 1, '{"kind":"Processor","metadata":{"name":"p","namespace":"n"},"spec":{"providerConfigRef":{"name":"c"}}}'),
        ("b", 2, '{"kind":"Processor","metadata":{"name":"p"}}'),
        ("b", 3, '{"kind":"ProviderConfig","metadata":{"name":"c","namespace":"other"}}'),
        ("c", 0, '{"kind":"ClusterProviderConfig","metadata":{"name":"c","namespace":"ignored"}}'),
        ("c", 1, '{"kind":"Processor","metadata":{}}'),
        ("c", 2, None), ("d", 0, "not json"), ("d", 1, '{"kind":"Secret","metadata":{"name":"p"}}'),
    ]
    documents = spark.createDataFrame(rows, "source string, position int, document string")
    twice = [tuple(r) for r in readers.manifest_duplicates(documents).collect()]
    assert twice == [("Processor", "n", "p", 2, "a", 0)]
    lost = {tuple(r) for r in readers.lost_configs(documents).collect()}
    assert lost == {("ProviderConfig", "n", "c", 1, "a", 0), ("ClusterProviderConfig", "", "default", 1, "b", 2)}  # a document without a name refers to nothing
    assert readers.manifest_duplicates(documents.limit(0)).count() == readers.lost_configs(documents.limit(0)).count() == 0
