"""Comparisons on random records against a plain reading of their rules."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from driftline import schemas as S
from driftline.functions import compare as C
from driftline.operators.drift import drift

NAMES = ["a", "b", "c", "d", ""]
VALUES = ["1", "2", "", None]


def random_map(rng):
    if rng.random() < 0.1:
        return None
    return {k: rng.choice(VALUES) for k in rng.sample(NAMES, rng.randrange(len(NAMES)))}


def map_reasons(want, have):
    have = have or {}
    return [
        f"property:{k}"
        for k, v in sorted((want or {}).items())
        if k not in have or (v is not None and v != (have[k] or ""))
    ]


def test_maps(spark):
    rng = random.Random(11)
    rows = [(i, random_map(rng), random_map(rng)) for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, d map<string,string>, o map<string,string>")
    got = {r["n"]: r["r"] for r in df.select("n", C.map_subset_diff(F.col("d"), F.col("o")).alias("r")).collect()}
    assert got == {n: map_reasons(d, o) for n, d, o in rows}


def random_parameter(rng):
    return {"name": rng.choice([*NAMES, None]), "value": rng.choice(VALUES), "description": rng.choice(["x", "y", "", None])}


def list_reasons(want, have):
    want, have = want or [], have or []
    found = ["parameter_count"] if len(want) != len(have) else []
    bodies = {e["parameter"]["name"] or "": e["parameter"] for e in have if e["parameter"]}
    for p in want:
        name = p["name"] or ""
        if name not in bodies:
            found.append(f"parameter:{name}")
            continue
        body = bodies[name]
        if None not in (p["value"], body["value"]) and p["value"] != body["value"]:
            found.append(f"parameter_value:{name}")
        if p["description"] and body["description"] is not None and p["description"] != body["description"]:
            found.append(f"parameter_description:{name}")
    return found


def test_lists(spark):
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        want = None if rng.random() < 0.05 else [random_parameter(rng) for _ in range(rng.randrange(4))]
        have = None if rng.random() < 0.05 else [
            {"parameter": random_parameter(rng) if rng.random() < 0.9 else None} for _ in range(rng.randrange(4))]
        rows.append((i, want, have))
    desired = f"STRUCT<{S.DESIRED['ParameterContext']}>"
    observed = f"STRUCT<{S.ENTITY['ParameterContext']}>"
    raw = spark.createDataFrame(
        [(i, json.dumps({"name": "c", "parameters": w}), json.dumps({"component": {"name": "c", "parameters": h}})) for i, w, h in rows],
        "n int, d string, o string")
    types = dict(spark.createDataFrame([], f"d {desired}, o {observed}").dtypes)
    df = raw.select("n", F.from_json("d", types["d"]).alias("desired"), F.from_json("o", types["o"]).alias("observed"))
    got = {r["n"]: r["reasons"] for r in drift(df, "ParameterContext").collect()}
    assert got == {n: list_reasons(w, h) for n, w, h in rows}


def test_first_reason_is_where_an_early_exit_stops(spark):
    """Service: name, then properties, then state."""
    rng = random.Random(13)
    rows = []
    for i in range(1000):
        want = {"name": rng.choice("ab"), "properties": random_map(rng), "desiredState": rng.choice(["ENABLED", "DISABLED", "", None])}
        have = {"component": {"name": rng.choice("ab"), "properties": random_map(rng), "state": rng.choice(["ENABLED", "DISABLED", "enabled", None])}}
        rows.append((i, want, have))

    def first(d, o):
        c = o["component"]
        if c["name"] != d["name"]:
            return "name"
        props = map_reasons(d["properties"], c["properties"])
        if props:
            return props[0]
        return "state" if (c["state"] or "") != (d["desiredState"] or "DISABLED") else None

    raw = spark.createDataFrame([(i, json.dumps(d), json.dumps(o)) for i, d, o in rows], "n int, d string, o string")
    types = dict(spark.createDataFrame([], f"d STRUCT<{S.DESIRED['ControllerService']}>, o STRUCT<{S.ENTITY['ControllerService']}>").dtypes)
    df = raw.select("n", F.from_json("d", types["d"]).alias("desired"), F.from_json("o", types["o"]).alias("observed"))
    got = {r["n"]: r["f"] for r in drift(df, "ControllerService").select("n", F.get("reasons", F.lit(0)).alias("f")).collect()}
    assert got == {n: first(d, o) for n, d, o in rows}
