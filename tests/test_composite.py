"""Claims that expand to resources which feed each other, by templates in tables."""

from __future__ import annotations

import os
import random

import pytest

from driftline.catalog import example
from driftline.plans import composite as K
from driftline.session import shared_folder

OUTPUTS = "claim string, path string, value string"


def frames(spark, outputs):
    claims = spark.createDataFrame(
        [("c", example.NAME, {"spec.parentGroupId": "root", "spec.providerConfigRefName": None, 'metadata.labels["claim-namespace"]': "team"})],
        "claim string, template string, spec map<string,string>",
    )
    return claims, spark.createDataFrame(outputs, OUTPUTS)


def templates(spark, rows):
    """Templates from {template: [(step, output, [required source])]}."""
    steps = [(t, s, i, "P", o) for t, of in rows.items() for i, (s, o, _) in enumerate(of)]
    patches = [(t, s, i, p, f"spec.{i}", True) for t, of in rows.items() for s, _, needs in of for i, p in enumerate(needs)]
    return K.Templates(spark.createDataFrame(steps, K.STEPS), spark.createDataFrame(patches, K.PATCHES), spark.createDataFrame([], K.BASES))


@pytest.fixture(scope="module")
def hashing(spark):
    return example.templates(spark)


def levels(found):
    return {r["step"]: r["level"] for r in K.template_levels(found).collect()}


def rounds(claims, found, outputs):
    return {r["step"]: r["round"] for r in K.creation_rounds(claims, found, outputs).collect()}


def test_nothing_reported(spark, hashing):
    claims, outputs = frames(spark, [])
    got = {r["step"]: r for r in K.resolve_patches(claims, hashing, outputs).collect()}
    assert len(got) == 6
    assert not got["process-group"]["blocked"]
    assert got["process-group"]["fields"] == {**example.base("process-group"), "spec.forProvider.parentGroupId": "root", "metadata.namespace": "team"}
    assert all(r["fields"]["metadata.namespace"] == "team" and r["fields"]["spec.providerConfigRef.name"] == "default" for r in got.values())
    assert got["replace-text"]["missing"] == ["spec.forProvider.parentGroupId"]
    assert got["conn-replace-to-log"]["missing"] == [
        "spec.forProvider.parentGroupId", "spec.forProvider.source.groupId", "spec.forProvider.destination.groupId",
        "spec.forProvider.source.id", "spec.forProvider.destination.id"]
    assert rounds(claims, hashing, outputs) == levels(hashing) == {
        "process-group": 1, "generate-flowfile": 2, "replace-text": 2, "log-attribute": 2,
        "conn-generate-to-replace": 3, "conn-replace-to-log": 3}


def test_all_reported(spark, hashing):
    claims, outputs = frames(spark, [("c", p, f"id-{i}") for i, p in enumerate(example.OUTPUTS)])
    got = {r["step"]: r for r in K.resolve_patches(claims, hashing, outputs).collect()}
    assert not any(r["blocked"] for r in got.values())
    assert got["conn-generate-to-replace"]["fields"] == {**example.base("conn-generate-to-replace"), "metadata.namespace": "team",
        "spec.forProvider.parentGroupId": "id-0", "spec.forProvider.source.groupId": "id-0",
        "spec.forProvider.destination.groupId": "id-0", "spec.forProvider.source.id": "id-1",
        "spec.forProvider.destination.id": "id-2"}
    assert set(rounds(claims, hashing, outputs).values()) == {1}


def test_path_nobody_provides(spark):
    found = templates(spark, {"t": [("a", "status.a", ["status.none"]), ("b", None, ["status.a"])]})
    claims = spark.createDataFrame([("c", "t", None)], "claim string, template string, spec map<string,string>")
    assert rounds(claims, found, spark.createDataFrame([], OUTPUTS)) == {"a": None, "b": None}
    # What nobody provides is no matter of the template's own order.
    assert levels(found) == {"a": 1, "b": 2}


def test_cycles_are_reported_per_template(spark):
    found = templates(spark, {
        "ring": [("a", "o.a", ["o.b"]), ("b", "o.b", ["o.a"]), ("behind", "o.x", ["o.b"]), ("free", "o.f", []), ("before", "o.g", ["o.f"])],
        "self": [("a", "o.a", ["o.a"]), ("z", None, [])],
        "line": [("a", "o.a", []), ("b", "o.b", ["o.a"])],
    })
    got = {(r["template"], r["step"]): (r["level"], r["in_cycle"]) for r in K.template_levels(found).collect()}
    assert got == {
        ("ring", "a"): (None, True), ("ring", "b"): (None, True), ("ring", "behind"): (None, False), ("ring", "free"): (1, False), ("ring", "before"): (2, False),
        ("self", "a"): (None, True), ("self", "z"): (1, False), ("line", "a"): (1, False), ("line", "b"): (2, False)}
    assert {r["template"]: r["steps"] for r in K.template_cycles(K.template_levels(found)).collect()} == {"ring": ["a", "b"], "self": ["a"]}
    # A claim whose resource has reported breaks the cycle.
    claims = spark.createDataFrame([("c", "ring", {}), ("d", "ring", {"o.b": "stated"})], "claim string, template string, spec map<string,string>")
    done = {(r["claim"], r["step"]): r["round"] for r in K.creation_rounds(claims, found, spark.createDataFrame([("c", "o.a", "1")], OUTPUTS)).collect()}
    assert done == {("c", "a"): 2, ("c", "b"): 1, ("c", "behind"): 2, ("c", "free"): 1, ("c", "before"): 2,
                    ("d", "a"): 1, ("d", "b"): 2, ("d", "behind"): 1, ("d", "free"): 1, ("d", "before"): 2}


def test_patches_go_before_bases_and_new_reports_before_old(spark, hashing):
    claims = spark.createDataFrame([("c", example.NAME, {"spec.providerConfigRefName": "mine"}), ("u", "unknown", {})], "claim string, template string, spec map<string,string>")
    outputs = spark.createDataFrame([("c", example.GROUP, "z-old", 1), ("c", example.GROUP, "a-new", 2)], "claim string, path string, value string, at int")
    rows = K.resolve_patches(claims, hashing, outputs).collect()
    assert {r["claim"] for r in rows} == {"c"}
    got = {r["step"]: r["fields"] for r in rows}
    assert got["replace-text"]["spec.forProvider.parentGroupId"] == "a-new"
    assert got["replace-text"]["spec.providerConfigRef.name"] == "mine"
    assert got["replace-text"]["spec.providerConfigRef.kind"] == "ProviderConfig"
    assert "metadata.namespace" not in got["replace-text"]


def test_a_deep_template_stays_small(spark):
    """Every step needs two of the steps before it; the plan does not grow with the steps."""
    found = templates(spark, {"t": [(f"s{i}", f"o.{i}", [f"o.{j}" for j in (i - 1, i - 2)] if i > 1 else []) for i in range(12)]})
    claims = spark.createDataFrame([("c", "t", {})], "claim string, template string, spec map<string,string>")
    want = {}
    for i in range(12):
        want[i] = 1 if i < 2 else 1 + max(0 if j == 5 else want[j] for j in (i - 1, i - 2))
    assert rounds(claims, found, spark.createDataFrame([("c", "o.5", "done")], OUTPUTS)) == {f"s{i}": n for i, n in want.items()}


def test_thousands_of_random_templates_in_one_plan(spark):
    rng = random.Random(6)
    rows = {f"t{t}": [(f"s{i}", f"o{i}", [f"o{rng.randrange(7)}" for _ in range(rng.randrange(3))]) for i in range(rng.randrange(1, 6))] for t in range(2000)}

    def level(of, step, seen=()):
        if step in seen:
            return None
        needs = next(n for s, _, n in of if s == step)
        makers = [m for m, o, _ in of if o in needs]
        found = [level(of, m, (*seen, step)) for m in makers]
        return None if None in found else 1 + max(found, default=0)

    got = {(r["template"], r["step"]): r["level"] for r in K.template_levels(templates(spark, rows)).collect()}
    assert got == {(t, s): level(of, s) for t, of in rows.items() for s, _, _ in of}


def tables(spark):
    """How many tables there are below the scratch folder."""
    return sum("_SUCCESS" in names for _, _, names in os.walk(shared_folder(spark).removeprefix("file:")))


def chain(spark, n):
    return templates(spark, {"t": [(f"s{i}", f"o.{i}", [f"o.{i - 1}"] if i else []) for i in range(n)]})


def odd(spark, rows):
    """Random templates with nulls in every column, optional patches and steps that need a path twice."""
    rng = random.Random(8)
    some = lambda x: None if rng.random() < 0.08 else x
    steps, patches = [], []
    for t in range(rows):
        n, free = rng.randrange(1, 8), rng.random() < 0.3
        steps += [(some(f"t{t}"), f"s{i}", None if free and not i else i, "P", some(f"o{rng.randrange(n)}" if rng.random() < 0.3 else f"o{i}")) for i in range(n)]
        steps += [(f"t{t}", None, 9, "P", "o9")]
        patches += [(f"t{t}", some(f"s{rng.randrange(n + 1)}"), i, some(f"o{rng.randrange(n + 2)}"), "spec.x", some(rng.random() < 0.8)) for i in range(rng.randrange(2 * n))]
    return K.Templates(spark.createDataFrame(steps, K.STEPS), spark.createDataFrame(patches, K.PATCHES), spark.createDataFrame([], K.BASES))


def test_levels_of_a_chain_take_no_table_per_level(spark):
    before = tables(spark)
    assert levels(chain(spark, 12)) == {f"s{i}": i + 1 for i in range(12)}
    assert tables(spark) - before <= 3


@pytest.mark.parametrize("most", [(60, 600), (4, 600), (60, 3)])
def test_levels_by_rows_are_those_by_rounds(spark, monkeypatch, most):
    found = odd(spark, 150)
    of = lambda df: sorted(map(repr, map(tuple, df.collect())))
    monkeypatch.setattr(K, "ROW_STEPS", most[0])
    monkeypatch.setattr(K, "ROW_PATCHES", most[1])
    got = of(K.template_levels(found))
    assert got == of(K._levels_in_rounds(found))
    assert any("True" in x for x in got) and any("None, False" in x for x in got)


def test_a_row_holds_as_many_steps_as_it_may(spark):
    """All 60 bits, and the step after them."""
    for n in (60, 61):
        assert levels(chain(spark, n) if n == 60 else templates(spark, {"t": [(f"s{i}", f"o.{i}", ["o.0"] if i else []) for i in range(n)]})) == {f"s{i}": i + 1 if n == 60 else min(i, 1) + 1 for i in range(n)}
    ring = templates(spark, {"t": [(f"s{i}", f"o.{i}", [f"o.{(i - 1) % 60}"]) for i in range(60)]})
    assert {(r["level"], r["in_cycle"]) for r in K.template_levels(ring).collect()} == {(None, True)}


def test_rounds_of_a_chain_take_no_table_per_level(spark):
    claims = spark.createDataFrame([("c", "t", {})], "claim string, template string, spec map<string,string>")
    before = tables(spark)
    assert rounds(claims, chain(spark, 12), spark.createDataFrame([("c", "o.5", "done")], OUTPUTS)) == {f"s{i}": i + 1 if i < 6 else i - 5 for i in range(12)}
    assert tables(spark) - before <= 3


@pytest.mark.parametrize("most", [(60, 600), (4, 600), (60, 3)])
def test_rounds_by_rows_are_those_by_passes(spark, monkeypatch, most):
    found, rng = odd(spark, 120), random.Random(9)
    claims = spark.createDataFrame([(f"c{i}", rng.choice([None, *[f"t{i % 120}"] * 9]), rng.choice([None, {}, {"o1": None}, {"o0": "stated"}])) for i in range(300)], "claim string, template string, spec map<string,string>")
    outputs = spark.createDataFrame([(f"c{rng.randrange(300)}", f"o{rng.randrange(8)}", rng.choice([None, "x", "y"])) for _ in range(300)], OUTPUTS)
    of = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = of(K._rounds_in_passes(K.known_values(claims, outputs), found, None))
    monkeypatch.setattr(K, "ROW_STEPS", most[0])
    monkeypatch.setattr(K, "ROW_PATCHES", most[1])
    assert of(K.creation_rounds(claims, found, outputs)) == want
    assert of(K.creation_rounds(claims, found, outputs, K.template_levels(found))) == want
