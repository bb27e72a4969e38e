"""Hot keys, row order, partition counts, and the shape of the plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from driftline import catalog
from driftline.operators import changes, dataflow, extensions, metrics, planning
from driftline.operators.drift import diff_named_rows, drift
from driftline.operators.observe import observe
from driftline.catalog import groups as G
from driftline.catalog import properties as P


@pytest.fixture(scope="module")
def skewed():
    """Log rows (key, t, seq, state); one key holds a good third of them, many share a time."""
    rng = random.Random(7)
    return [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(3000), n, rng.choice("abc"))
        for n in range(6000)
    ]


LOG = "key string, t int, seq int, state string"


def walk(rows):
    """Rows per key in order, with the state before."""
    last = {}
    for key, t, seq, state in sorted(rows, key=lambda r: (r[1], r[2])):
        yield key, seq, state, last.get(key)
        last[key] = state


@pytest.mark.parametrize("width", [1, 50, 100000, None])
def test_previous_value_with_a_hot_key(spark, skewed, width):
    df = spark.createDataFrame(skewed, LOG).repartition(7)
    slices = F.floor(F.col("t") / width) if width else None
    kept = changes.desired_changed(df, ["key"], ["t", "seq"], ["state"], slices).collect()
    assert sorted(r["seq"] for r in kept) == sorted(s for _, s, state, p in walk(skewed) if p != state)
    moved = changes.condition_transitions(df, ["key"], ["t", "seq"], "state", slices).collect()
    assert {(r["seq"], r["previous_status"]) for r in moved} == {
        (s, p) for _, s, state, p in walk(skewed) if p is not None and p != state}


def test_null_keys_are_a_key_and_are_split(spark):
    rows = [(None, t, t, "ab"[t // 3 % 2]) for t in range(30)]
    df = spark.createDataFrame(rows, LOG)
    kept = changes.desired_changed(df, ["key"], ["t", "seq"], ["state"], F.floor(F.col("t") / 4))
    assert sorted(r["seq"] for r in kept.collect()) == list(range(0, 30, 3))
    many = spark.range(0, 4000, 1, 4).select(
        F.lit(None).cast("string").alias("key"), F.col("id").alias("t"), (F.col("id") % 2).alias("state"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = changes.with_previous(many, ["key"], ["t"], ["state"])
        sizes = [r["n"] for r in wide.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2500


def test_a_key_inside_one_hour_is_cut(spark):
    """Slices follow the rows also for times without a zone."""
    hour = spark.range(6000).select(
        F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") % 3).alias("state"),
        F.expr("timestamp_ntz '2024-01-16 10:00:00' + make_dt_interval(0, 0, 0, id * 0.5)").alias("ts"))
    cut = hour.select(changes.even_slices(hour, ["ts"], 16).alias("s")).groupBy("s").count().collect()
    assert len(cut) > 12 and max(r["count"] for r in cut) < 1200
    assert changes.desired_changed(hour, ["key"], ["ts", "seq"], ["state"]).count() == 6000


def test_the_log_is_read_once(spark, folder):
    plan = contract.queries()["desired_changed"](spark, folder)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert "ReusedExchange" in final or final.count("FileScan") == 1


def test_even_slices_of_a_crowded_history(spark, skewed):
    crowded = [(k, t if t < 100 else 100 + t % 7, seq, s) for k, t, seq, s in skewed]
    df = spark.createDataFrame(crowded, LOG).repartition(7)
    slices = changes.even_slices(df, ["t"], 16)
    assert 3 < df.select(slices).distinct().count() <= 16
    # A slice never falls as the order rises.
    spans = df.groupBy(slices.alias("s")).agg(F.min("t").alias("low"), F.max("t").alias("high")).orderBy("s").collect()
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:], strict=False))
    kept = changes.desired_changed(df, ["key"], ["t", "seq"], ["state"], slices).collect()
    assert sorted(r["seq"] for r in kept) == sorted(s for _, s, state, p in walk(crowded) if p != state)


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "decimal(20,3)", "bigint"])
def test_a_crowded_column_of_any_type_is_cut(spark, kind):
    """One value of the first column for most rows: the tie-break cuts it; a text column is cut like a number."""
    first = {"timestamp_ntz": "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, least(id, 50))"}.get(kind, f"cast(least(id, 50) + 10 as {kind})")
    log = spark.range(0, 8000, 1, 4).select(F.lit("k").alias("key"), F.expr(first).alias("at"), F.col("id").cast("string").alias("tie"), (F.floor(F.col("id") / 3) % 2).alias("state"))
    cut = log.groupBy(changes.even_slices(log, ["at", "tie"], 16).alias("s")).count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 1000
    kept = changes.desired_changed(log, ["key"], ["at", "tie"], ["state"])
    before, want = None, 0
    for r in log.orderBy("at", "tie").collect():
        want += r["state"] != before
        before = r["state"]
    assert kept.count() == want


def test_null_states_are_values(spark):
    rows = [("k", 1, 1, None), ("k", 2, 2, None), ("k", 3, 3, "a"), ("k", 4, 4, None)]
    df = spark.createDataFrame(rows, LOG)
    kept = changes.desired_changed(df, ["key"], ["t", "seq"], ["state"], F.col("t")).collect()
    assert sorted(r["seq"] for r in kept) == [1, 3, 4]


def test_newest_row_with_a_hot_key(spark, skewed):
    df = spark.createDataFrame(skewed, LOG).repartition(16)
    newest = changes.latest_revision(df, ["key"], "t", ["seq"])
    best = {}
    for row in skewed:
        best[row[0]] = max(best.get(row[0], row), row, key=lambda r: (r[1], r[2]))
    assert {tuple(r) for r in newest.collect()} == set(best.values())
    # One row per key leaves each task: the limit sits below the shuffle.
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_writes_with_a_hot_key(spark):
    rng = random.Random(3)
    current = {f"k{i}": rng.randrange(4) for i in range(30)}
    batch = [
        (rng.choice(["k0", f"k{rng.randrange(60)}"]), rng.randrange(4), n, rng.choice(["PUT", "PUT", "DELETE"]))
        for n in range(3000)
    ]
    now = spark.createDataFrame(list(current.items()), "key string, revision bigint")
    writes = spark.createDataFrame(batch, "key string, revision bigint, seq int, op string").repartition(9)
    got = {r["seq"]: (r["outcome"], r["new_revision"]) for r in planning.classify_writes(now, writes, "key").collect()}
    want, won = {}, set()
    for key, revision, seq, op in batch:
        known = key in current
        fits = revision == current[key] if known else revision == 0 and op == "PUT"
        if fits and key not in won:
            won.add(key)
            new = None if op == "DELETE" else current[key] + 1 if known else 0
            want[seq] = ("applied", new)
        elif not known and not (op == "PUT" and revision == 0):
            want[seq] = ("not_found", None)
        else:
            want[seq] = ("conflict", None)
    assert got == want
    after = {r["key"]: r["revision"] for r in planning.apply_checked(now, writes, "key")[2].collect()}
    expected = dict(current)
    for key, _, seq, op in batch:
        if want[seq][0] == "applied":
            if op == "DELETE":
                del expected[key]
            else:
                expected[key] = want[seq][1]
    assert after == expected


def test_nameless_rows_are_spread(spark):
    desired = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("").alias("name"))
    observed = spark.range(20000).select(F.col("id").cast("string").alias("name"), F.struct("id").alias("observed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = observe(desired, observed, "name", row_id="id")
        largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 20000 * 0.3
        assert joined.where("exists").count() == 6667 and joined.count() == 20000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def large_joins(spark):
    """Settings under which small test tables are too large to broadcast, and skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def split(df):
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_source_is_split(spark, large_joins):
    records = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("source_id"),
        F.lit("success").alias("relationship"), F.col("id").alias("record"))
    edges = spark.range(60000).select(
        F.col("id").alias("connection_id"), F.col("id").alias("source_id"), (F.col("id") + 1).alias("destination_id"),
        F.array(F.lit("success"), F.lit("success")).alias("selectedRelationships"))
    out = dataflow.route(records, edges)
    rows = out.collect()
    assert len(rows) == 60000 and len({r["record"] for r in rows}) == 60000
    assert split(out)


def test_a_hot_name_is_split(spark, large_joins):
    """Resources without a name, and resources that share one, in the lookup join."""
    desired = spark.range(0, 60000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "n1").otherwise(F.concat(F.lit("n"), "id")).alias("name"))
    observed = spark.range(60000).select(F.concat(F.lit("n"), "id").alias("name"), F.struct("id").alias("observed"))
    out = observe(desired, observed, "name")
    assert [out.collect().count(None), len(out.collect())] == [0, 60000]
    assert split(out)
    assert out.where("exists").count() == 40000


def test_a_hot_config_is_split(spark, large_joins):
    from driftline.operators.configs import resolve_config

    n = F.col("id")
    resources = spark.range(0, 60000, 1, 8).select(
        # Shuffle sizes count after compression, so the rows must not all look alike.
        n, F.sha2(n.cast("string"), 256).alias("uid"), F.lit("ns").alias("namespace"),
        F.struct(F.when(n % 2 == 0, "ProviderConfig").otherwise("ClusterProviderConfig").alias("kind"),
                 F.when(n % 2 == 0, "default").otherwise(F.concat(F.lit("c"), "id")).alias("name")).alias("providerConfigRef"))
    scoped = spark.range(1).select(F.lit("ns").alias("namespace"), F.lit("default").alias("name"), F.lit("u").alias("config"))
    cluster = spark.range(50000).select(F.concat(F.lit("c"), "id").alias("name"), F.lit("v").alias("config"))
    out = resolve_config(resources, scoped, cluster)
    assert len(out.collect()) == 60000
    assert split(out)
    assert out.where("config_error IS NOT NULL").count() == 5000


def test_reasons_do_not_depend_on_layout(spark, folder):
    base = P.processors(spark, folder)
    runs = [
        {(r["user_id"], tuple(r["reasons"])) for r in drift(df, "Processor").collect()}
        for df in (base, base.repartition(1), base.repartition(23), base.orderBy(F.desc("user_id")))
    ]
    assert runs[0] and all(r == runs[0] for r in runs)


def test_equal_sides_do_not_drift(spark, folder):
    rows = P.processors(spark, folder).where("exists")
    o = F.col("observed")
    mirrored = rows.withColumn(
        "desired",
        F.col("desired")
        .withField("name", o["component"]["name"])
        .withField("config", F.struct(*[o["component"]["config"][c].alias(c) for c in ("properties", "schedulingStrategy", "schedulingPeriod")]))
        .withField("desiredState", F.coalesce(F.upper(o["status"]["runStatus"]), F.lit("STOPPED"))),
    )
    assert drift(mirrored, "Processor").where("NOT up_to_date").count() == 0


def test_extra_observed_keys_never_drift(spark, folder):
    rows = P.processors(spark, folder).where("exists")
    more = F.map_concat("observed.component.config.properties", F.create_map(F.lit("zz extra"), F.lit("1")))
    wider = rows.withColumn("observed", F.col("observed").withField("component.config.properties", more))
    before = {(r["user_id"], tuple(r["reasons"])) for r in drift(rows, "Processor").collect()}
    assert before == {(r["user_id"], tuple(r["reasons"])) for r in drift(wider, "Processor").collect()}


def test_named_rows_agree_with_lists(spark, folder):
    """The row form and the list form of the named comparison give the same reasons."""
    both = P.contexts(spark, folder).where("observed IS NOT NULL")
    listed = drift(both, "ParameterContext").select("user_id", F.explode("reasons").alias("reason")).where("reason LIKE 'parameter%'")

    def rows(column, prefix):
        return both.select("user_id", F.posexplode(column).alias("position", "e")).select(
            "user_id", "position", *[F.col(f"e.{prefix}{c}").alias(c) for c in ("name", "value", "description")])

    have = rows("observed.component.parameters", "parameter.").withColumn("has_body", F.lit(True))
    long = diff_named_rows(rows("desired.parameters", ""), have, "user_id")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, long.select("user_id", "reason").collect()))


def test_named_rows_last_wins_and_bodies(spark):
    desired = spark.createDataFrame([("c", 0, "a", "1", None), ("c", 1, "b", "1", "")], "o string, position int, name string, value string, description string")
    observed = spark.createDataFrame(
        [("c", 0, "a", "1", None, True), ("c", 1, "a", "2", None, True), ("c", 2, None, None, None, False)],
        "o string, position int, name string, value string, description string, has_body boolean")
    got = {r["reason"] for r in diff_named_rows(desired, observed, "o").collect()}
    assert got == {"parameter_count", "parameter_value:a", "parameter:b"}


def test_convergence(spark, folder):
    """plan, apply, observe: what is left is only what can never converge."""
    left = planning.converge(P.planned_processors(spark, folder), "Processor").where("action = 'UPDATE' AND NOT up_to_date")
    for row in left.collect():
        for reason in row["reasons"]:
            if reason == "state":
                assert row["desired"]["desiredState"] == "DISABLED"
            else:
                assert row["desired"]["config"]["properties"][reason.removeprefix("property:")] is None
    again = planning.plan_steps(planning.plan_action(planning.converge(G.planned(spark, folder), "ProcessGroup")), "ProcessGroup")
    assert again.where("action = 'UPDATE'").count() == 0


def test_tree_of_any_depth_and_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)] + [("x", "gone")]
    groups = spark.createDataFrame(chain, "id string, parent_id string")
    counts = spark.createDataFrame([("n149", 5), ("n3", 1), ("x", 2)], "id string, n bigint")
    got = {r["id"]: r["n"] for r in extensions.group_tree(groups, counts).collect()}
    assert got == {**{f"n{i}": 6 if i <= 3 else 5 for i in range(150)}, "x": 2}
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("r", None)], "id string, parent_id string")
    for n in (0, 1):
        with pytest.raises(ValueError, match="cycle"):
            extensions.group_tree(loop, spark.createDataFrame([("a", n)], "id string, n bigint"))


def test_tree_sums_against_a_walk(spark):
    rng = random.Random(9)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.95 else None for i in range(200)}
    own = {i: rng.randrange(5) for i in parent if rng.random() < 0.7}
    want = dict.fromkeys(parent, 0)
    for i, n in own.items():
        at = i
        while at is not None:
            want[at] += n
            at = parent[at]
    groups = spark.createDataFrame([(str(i), None if p is None else str(p)) for i, p in parent.items()], "id string, parent_id string")
    counts = spark.createDataFrame([(str(i), n) for i, n in own.items()], "id string, n bigint")
    assert {int(r["id"]): r["n"] for r in extensions.group_tree(groups, counts).collect()} == want


def test_parameters_of_any_depth_and_cycles(spark):
    own = [("c40", "deep", "far"), ("c3", "near", "three"), ("c0", "own", "zero"), ("d", "near", "other")]
    links = [(f"c{i}", f"c{i + 1}", 0) for i in range(40)] + [("c0", "d", 1)]
    schema = "context_id string, name string, value string"
    own_df = spark.createDataFrame(own, schema)
    parents = spark.createDataFrame(links, "context_id string, parent_id string, position int")
    got = {(r["context_id"], r["name"]): (r["value"], r["inherited"]) for r in extensions.inherited_params(own_df, parents).collect()}
    want = {(f"c{i}", "deep"): ("far", i < 40) for i in range(41)}
    want |= {(f"c{i}", "near"): ("three", i < 3) for i in range(4)} | {("d", "near"): ("other", False), ("c0", "own"): ("zero", False)}
    assert got == want
    loop = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "z", 1)], "context_id string, parent_id string, position int")
    with pytest.raises(ValueError, match="inherit"):
        extensions.inherited_params(spark.createDataFrame([("z", "p", "v")], schema), loop)


def test_exact_percentiles(spark):
    rng = random.Random(4)
    rows = [("K", rng.choice("ab"), rng.choice([rng.randrange(100), rng.randrange(-5, 2**50), None]), None if rng.random() < 0.8 else "e") for _ in range(3000)]
    df = spark.createDataFrame(rows, "kind string, action string, age_seconds bigint, error string").union(
        spark.createDataFrame([("K", "none", None, None)], "kind string, action string, age_seconds bigint, error string"))
    for r in metrics.reconcile_metrics(df).collect():
        mine = [x for x in rows if x[1] == r["action"]]
        ages = sorted(x[2] for x in mine if x[2] is not None)
        if r["action"] == "none":
            assert (r["n"], r["failed"], r["age_p50"], r["age_p95"]) == (1, 0, None, None)
            continue
        at = lambda p: ages[max(1, -(-len(ages) * p // 100)) - 1]
        assert (r["n"], r["failed"], r["age_p50"], r["age_p95"]) == (len(mine), sum(x[3] is not None for x in mine), at(50), at(95))


def test_usage_of_the_newest_config(spark):
    from driftline.operators.configs import usage_edges

    schema = "apiVersion string, kind string, name string, namespace string, uid string, providerConfigRef struct<kind:string,name:string>, at int"
    rows = [("v", "K", "a", "n", "u1", ("C", "old"), 1), ("v", "K", "a", "n", "u1", ("C", "new"), 2), ("v", "K", "a", "n", "u1", ("C", "zz"), 0)]
    rows += [("v", "K", f"x{i}", "n", None, ("C", "c"), 1) for i in range(5)] + [("v", "K", "x0", "n", None, ("C", "later"), 9)]
    got = sorted((r["resourceRef"]["name"], r["providerConfigRef"]["name"]) for r in usage_edges(spark.createDataFrame(rows, schema), "at").collect())
    assert got == [("a", "new"), ("x0", "later"), ("x1", "c"), ("x2", "c"), ("x3", "c"), ("x4", "c")]


def test_an_answer_without_version_information_keeps_what_was(spark):
    from driftline.operators.observe import flow_current

    flows = spark.createDataFrame([("f",), ("g",)], "k string")
    info = spark.createDataFrame([("f", None, None, False), ("g", "3", "STALE", False)], "k string, version string, state string, failed boolean")
    info = info.withColumn("version", F.try_parse_json("version"))
    prior = spark.createDataFrame([("f", 7, True), ("g", 1, False)], "k string, current_version int, stale boolean")
    got = {r["k"]: (r["current_version"], r["stale"]) for r in flow_current(flows, info, prior, "k").collect()}
    assert got == {"f": (7, True), "g": (3, True)}


def test_named_rows_without_names_and_owners(spark):
    schema = "o string, position int, name string, value string, description string"
    desired = spark.createDataFrame([("c", 0, None, "1", None)], schema)
    observed = spark.createDataFrame([("c", 0, "", "2", None), ("undeclared", 0, "a", "1", None)], schema).withColumn("has_body", F.lit(True))
    assert [tuple(r) for r in diff_named_rows(desired, observed, "o").collect()] == [("c", "parameter_value:")]


def test_long_lists_of_names(spark):
    """Tens of thousands of entries in one row, some repeated on either side."""
    from driftline.functions.compare import named_list_diff

    n = 20_000
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.concat(F.lit("p"), i.cast("string")).alias("name"), F.lit("v").alias("value"), F.lit("").alias("description"), F.lit(False).alias("sensitive")))
    have = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.struct(
        F.concat(F.lit("p"), F.pmod(i * 7, F.lit(n)).cast("string")).alias("name"), F.when(i % 1000 == 0, "x").otherwise("v").alias("value"), F.lit("").alias("description")).alias("parameter")))
    rows = spark.range(1).select(want.alias("w"), have.alias("h")).select(F.explode(named_list_diff(F.col("w"), F.col("h"))).alias("r")).collect()
    assert len(rows) == n // 1000 and all(r["r"].startswith("parameter_value:p") for r in rows)
    small = spark.sql("""SELECT array(named_struct('name','a','value','1','description',''), named_struct('name','a','value','2','description','d'), named_struct('name','b','value','1','description','')) w,
      array(named_struct('parameter', named_struct('name','a','value','9','description','')), named_struct('parameter', named_struct('name','a','value','2','description','e'))) h""")
    got = [r[0] for r in small.select(F.explode(named_list_diff(F.col("w"), F.col("h")))).collect()]
    assert got == ["parameter_count", "parameter_value:a", "parameter_description:a", "parameter:b"]


def test_limits_in_any_unit(spark):
    edges = spark.createDataFrame([("n", "100 nanos"), ("u", "5 micros"), ("x", "30 foo"), ("z", "0 sec"), ("e", "")], "connection_id string, flowFileExpiration string")
    queue = edges.select("connection_id", F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("entered"))
    as_of = F.expr("timestamp_ntz '2024-01-01 00:00:00.000004'")
    assert {r["connection_id"] for r in dataflow.expire(queue, edges, as_of).collect()} == {"u", "x", "z", "e"}
    assert [r["connection_id"] for r in dataflow.unreadable_limits(edges).collect()] == ["x"]


def test_writes_without_a_key(spark):
    now = spark.createDataFrame([("a", 1)], "key string, revision bigint")
    writes = spark.createDataFrame([(None, 0, 1), (None, 3, 2), ("a", 1, 3), ("a", 1, 4), ("b", 0, 5)], "key string, revision bigint, seq int")
    got = {r["seq"]: r["outcome"] for r in planning.classify_writes(now, writes, "key").collect()}
    assert got == {1: "not_found", 2: "not_found", 3: "applied", 4: "conflict", 5: "applied"}


def test_several_observations_of_one_name(spark):
    desired = spark.createDataFrame([(1, "a"), (2, "b"), (3, "ok")], "id int, name string")
    rows = [("a", 1, "old", None), ("a", 2, "new", None), ("a", 2, "also", None), ("b", 7, "x", None), ("ok", 1, "y", 200)]
    observed = spark.createDataFrame(rows, "name string, version bigint, text string, http_status int").select(
        "name", F.struct(F.struct("version").alias("revision"), "text").alias("observed"), "http_status", F.lit(None).cast("string").alias("error_text"))
    got = {r["id"]: (r["exists"], r["error"], r["observed"]["text"]) for r in observe(desired, observed, "name").collect()}
    assert got == {1: (True, None, "new"), 2: (True, None, "x"), 3: (True, None, "y")}


def test_group_counts_combine_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("root").alias("p"), F.when(F.col("id") % 4 == 0, "Running").otherwise("INVALID").alias("s"))
    counted = metrics.group_counts(df, "p", "s")
    assert tuple(counted.first()) == ("root", 250, 0, 0, 750)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan[plan.index("Exchange"):]


BAD = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|SinglePartition|BatchEvalPython|ArrowEvalPython|FlatMapGroups|MapInPandas")


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("stream_")])
def test_plan_shape(spark, folder, name):
    """No cross join, no shuffle into one task, no Python outside YAML decoding."""
    plan = contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    found = set(BAD.findall(plan)) - ({"MapInPandas"} if name == "src_manifests" else set())
    assert not found


def test_scans_read_only_what_they_need(spark, folder):
    plan = contract.queries()["reconcile_groups"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>", plan)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>", plan)
