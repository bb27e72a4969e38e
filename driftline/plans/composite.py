"""Composites: claims that expand to several resources which feed each other, by templates that are data.

Templates are three tables: steps, patches between a claim's paths and a step's fields, and fixed
fields. Any number of templates is worked on in one plan. What depends on what inside
them is found in rounds over all templates at once; a claim then needs one join with its
template, as large as a document, and one with what its resources have reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import scratch_path, written

STEPS = "template string, step string, position int, kind string, output string"
PATCHES = "template string, step string, position int, source string, target string, required boolean"
BASES = "template string, step string, path string, value string"

#: A template of at most so many steps and required patches is worked on in one row, its steps the bits of a whole number.
ROW_STEPS, ROW_PATCHES = 60, 600
#: The bit of a step that never comes.
NEVER = 1 << 62


@dataclass(frozen=True)
class Templates:
    """``steps`` (template, step, position, kind, output), ``patches`` (template, step, position, source, target, required) and
    ``bases`` (template, step, path, value).

    A step reports its id at the path ``output`` of the claim, or nowhere. A patch copies what
    the claim has at ``source`` to the step's field ``target``; later positions go before earlier
    ones and patches before fixed fields. Of two steps with one output the later one counts.
    ``template`` may be of any type that joins; (template, step) is unique.
    """

    steps: DataFrame
    patches: DataFrame
    bases: DataFrame


def dependencies(templates: Templates) -> DataFrame:
    """template, step, needs: each step that another one requires an output of, once; a step that needs itself too."""
    makers = templates.steps.where("output IS NOT NULL").groupBy("template", F.col("output").alias("source"))
    makers = makers.agg(F.max_by("step", "position").alias("needs"))
    required = templates.patches.where("required").select("template", "step", "source")
    return required.join(makers, ["template", "source"]).select("template", "step", "needs").distinct()


def _peeled(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[list[DataFrame], DataFrame]:
    """The ``nodes`` (template, step) in rounds, each round those that need none of the nodes left, and those that no round reaches.

    ``edges`` (template, step, needs) lie between ``nodes``. A round counts how many of a
    step's needs it has met and takes that off the step's count; rounds and what is left are written.
    """
    spark = nodes.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    waits = edges.groupBy("template", "step").agg(F.count(F.lit(1)).alias("waits"))
    left = kept(nodes.join(waits, ["template", "step"], "left").select("template", "step", F.coalesce("waits", F.lit(0)).alias("waits")), "left-0")
    rounds = []
    while True:
        ready = left.where("waits = 0").select("template", "step")
        if ready.isEmpty():
            return rounds, left.select("template", "step")
        rounds.append(kept(ready, f"round-{len(rounds)}"))
        met = edges.join(rounds[-1].withColumnRenamed("step", "needs"), ["template", "needs"]).groupBy("template", "step").agg(F.count(F.lit(1)).alias("met"))
        further = left.where("waits > 0").join(met, ["template", "step"], "left")
        left = kept(further.select("template", "step", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits")), f"left-{len(rounds)}")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _by_size(templates: Templates) -> tuple[DataFrame, Templates | None]:
    """template, steps, needs: a row per template that fits into one; and the other templates, if there are any.

    ``steps`` (position, step, output) are the later ones first. ``needs`` has for each of them the
    ``source`` of its required patches and ``made``, the place from 1 of the step that makes it, or 0.
    What templates are made of is written and counted before any is put together.
    """
    steps = templates.steps.where("template IS NOT NULL").select("template", "step", "position", "output", F.lit(False).alias("patch"))
    patches = templates.patches.where("template IS NOT NULL AND step IS NOT NULL AND required").select("template", "step", "source", F.lit(True).alias("patch"))
    rows = written(steps.unionByName(patches, allowMissingColumns=True), "steps")
    sizes = rows.groupBy("template").agg(F.count_if("patch").alias("patches"), F.count_if(~F.col("patch")).alias("steps"))
    large = written(sizes.where((F.col("steps") > ROW_STEPS) | (F.col("patches") > ROW_PATCHES)).select("template"), "large")
    rest = None
    if not large.isEmpty():
        rows = rows.join(large, "template", "left_anti")
        rest = Templates(*(df.join(large, "template", "left_semi") for df in (templates.steps, templates.patches, templates.bases)))
    listed = rows.groupBy("template").agg(
        F.sort_array(F.collect_list(F.when(~F.col("patch"), F.struct("position", "step", "output"))), asc=False).alias("steps"),
        F.collect_list(F.when(F.col("patch"), F.struct("step", "source"))).alias("patches"),
    )
    found = lambda outputs: F.transform("patches", lambda p: F.struct(
        p["step"].alias("step"), p["source"].alias("source"), F.coalesce(F.array_position(outputs, p["source"]), F.lit(0)).cast("int").alias("made")
    ))
    needs = _with(_with(F.transform("steps", lambda s: s["output"]), found), lambda wants: F.transform("steps", lambda s: F.transform(
        F.filter(wants, lambda w: w["step"] == s["step"]), lambda w: F.struct(w["source"].alias("source"), w["made"].alias("made"))
    )))
    return listed.select("template", "steps", needs.alias("needs")), rest


def _bits(needs: Column, bit: Callable[[Column], Column]) -> Column:
    """bit, needs: each step's own bit, and the bits of all that it waits for."""
    zero = F.lit(0).cast("bigint")
    return F.transform(needs, lambda of, i: F.struct(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), i).alias("bit"), F.aggregate(of, zero, lambda m, n: m.bitwiseOR(bit(n))).alias("needs")
    ))


def _made_bit(need: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), need["made"] - 1)


def _done(bits: Column) -> Column:
    """The steps that are there before the first round and after each one, until a round adds none."""
    zero = F.lit(0).cast("bigint")

    def after(done: Column) -> Column:
        return F.aggregate(bits, zero, lambda m, s: F.when(s["needs"].bitwiseAND(F.bitwise_not(done)) == 0, m.bitwiseOR(s["bit"])).otherwise(m))

    def further(seen: Column, _: Column) -> Column:
        still = (F.size(seen) > 1) & (F.element_at(seen, -1) == F.try_element_at(seen, F.lit(-2)))
        return F.when(still, seen).otherwise(F.array_append(seen, after(F.element_at(seen, -1))))

    return F.aggregate(bits, F.array(zero), further)


def _round_of(step: Column, done: Column) -> Column:
    """The round from 1 that a step of ``_bits`` comes in, null if none does."""
    return F.when(F.element_at(done, -1).bitwiseAND(step["bit"]) != 0, F.size(F.filter(done, lambda m: m.bitwiseAND(step["bit"]) == 0)))


def _endless(bits: Column, done: Column) -> Column:
    """Of the steps that are in none of the rounds of ``done``, those that such steps need without end."""
    zero = F.lit(0).cast("bigint")
    every = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(bits)) - 1
    wanted = lambda left: F.aggregate(bits, zero, lambda m, s: F.when(s["bit"].bitwiseAND(left) != 0, m.bitwiseOR(s["needs"])).otherwise(m))
    stuck = every.bitwiseAND(F.bitwise_not(F.element_at(done, -1)))
    return F.aggregate(bits, stuck, lambda left, _: F.when(left == 0, left).otherwise(left.bitwiseAND(wanted(left))))


def template_levels(templates: Templates) -> DataFrame:
    """template, step, level, in_cycle: the earliest round in which each step can be created, from 1.

    A step on a cycle, or that needs one that is, has no level. ``in_cycle`` marks the steps
    that need and are needed without end: those on cycles and between two. Templates of
    ordinary size meet in one shuffle, a row each; large ones take as many rounds as the longest of their chains has steps.
    """
    listed, rest = _by_size(templates)
    # What only steps without a position make never comes.
    placed = F.size(F.filter("steps", lambda s: s["position"].isNotNull()))
    bit = lambda n: F.when(n["made"] == 0, F.lit(0).cast("bigint")).when(n["made"] > placed, F.lit(NEVER)).otherwise(_made_bit(n))
    of = lambda bits, done, endless: F.transform("steps", lambda s, i: F.struct(
        s["step"].alias("step"), _round_of(bits[i], done).alias("level"), (bits[i]["bit"].bitwiseAND(endless) != 0).alias("in_cycle")
    ))
    each = _with(_bits(F.col("needs"), bit), lambda bits: _with(_done(bits), lambda done: _with(_endless(bits, done), lambda endless: of(bits, done, endless))))
    found = listed.select("template", F.explode(each).alias("s")).select("template", "s.step", "s.level", "s.in_cycle")
    # Nothing meets a step of no template.
    alone = templates.steps.where("template IS NULL").select("template", "step", F.lit(1).alias("level"), F.lit(False).alias("in_cycle"))
    found = found.unionByName(alone)
    return found if rest is None else found.unionByName(_levels_in_rounds(rest))


def _levels_in_rounds(templates: Templates) -> DataFrame:
    """``template_levels`` of templates of any size: as many rounds as the longest chain has steps, for all of them together."""
    path = scratch_path(templates.steps.sparkSession, "levels")
    nodes = templates.steps.select("template", "step")
    edges = dependencies(templates)
    edges.write.parquet(f"{path}/edges")
    edges = nodes.sparkSession.read.schema(edges.schema).parquet(f"{path}/edges")
    rounds, stuck = _peeled(nodes, edges, f"{path}/up")
    found = None
    for level, ready in enumerate(rounds, 1):
        one = ready.select("template", "step", F.lit(level).alias("level"), F.lit(False).alias("in_cycle"))
        found = one if found is None else found.unionByName(one)
    none = F.lit(None).cast("int").alias("level")
    if stuck.isEmpty():
        return found if found is not None else nodes.select("template", "step", none, F.lit(False).alias("in_cycle"))
    # The same from the other end: what nothing stuck needs is behind a cycle and not on one.
    among = edges.join(stuck, ["template", "step"]).join(stuck.withColumnRenamed("step", "needs"), ["template", "needs"])
    turned = among.select("template", F.col("needs").alias("step"), F.col("step").alias("needs"))
    _, cycles = _peeled(stuck, turned, f"{path}/down")
    marked = stuck.join(cycles.withColumn("in_cycle", F.lit(True)), ["template", "step"], "left")
    rest = marked.select("template", "step", none, F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    return rest if found is None else found.unionByName(rest)


def template_cycles(levels: DataFrame) -> DataFrame:
    """template, steps: the sorted steps that are in a cycle, for each template that has one."""
    return levels.where("in_cycle").groupBy("template").agg(F.sort_array(F.collect_list("step")).alias("steps"))


def assembled(templates: Templates, levels: DataFrame | None = None) -> DataFrame:
    """template, steps: one row per template with its steps, their patches and fixed fields; by level if ``levels`` are given, else by position.

    ``made`` of a patch is its maker's place among the steps, from 1, null where no step has that output.
    A row is as large as the template's document. Written, so that its size is known to those who join it.
    """
    spark = templates.steps.sparkSession
    rank = F.col("position")
    steps = templates.steps
    if levels is not None:
        steps = steps.join(levels.select("template", "step", "level"), ["template", "step"], "left")
        rank = F.struct(F.col("level").isNull().alias("last"), "level", "position")
    patches = templates.patches.groupBy("template", "step").agg(
        F.sort_array(F.collect_list(F.struct("position", "source", "target", F.coalesce("required", F.lit(False)).alias("required")))).alias("patches")
    )
    bases = templates.bases.groupBy("template", "step").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("base"))
    rows = steps.select("template", rank.alias("rank"), "position", "step", "kind", "output").join(patches, ["template", "step"], "left").join(bases, ["template", "step"], "left")
    whole = rows.select("template", F.struct(
        "rank", "position", "step", "kind", "output", F.coalesce("base", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("base"),
        F.coalesce("patches", F.array().cast("array<struct<position:int,source:string,target:string,required:boolean>>")).alias("patches"),
    ).alias("s"))
    path = scratch_path(spark, "templates")
    listed = whole.groupBy("template").agg(F.sort_array(F.collect_list(F.struct(F.col("s.rank").alias("rank"), F.col("s.step").alias("step"), F.struct(
        F.col("s.step").alias("step"), F.col("s.kind").alias("kind"), F.col("s.output").alias("output"), F.col("s.position").alias("position"), F.col("s.patches").alias("patches"),
    ).alias("s"), F.map_entries("s.base").alias("base")))).alias("l"))
    listed = listed.select("template", F.transform("l", lambda x: x["s"].withField("base", F.map_from_entries(x["base"]))).alias("steps"))
    listed.write.parquet(path)
    return spark.read.schema(listed.schema).parquet(path)


def known_values(claims: DataFrame, outputs: DataFrame) -> DataFrame:
    """``claims`` (claim, template, spec) with ``known``, what each path of the claim is worth.

    A value that a resource reported comes before one that the claim states. Of several
    reports for a path the one of the greatest ``at`` counts, and without such a column or
    at equal ones the greatest value.
    """
    at = F.col("at") if "at" in outputs.columns else F.lit(0)
    newest = outputs.groupBy("claim", "path").agg(F.max_by("value", F.struct(at.alias("at"), "value")).alias("value")).where("value IS NOT NULL")
    reported = newest.groupBy("claim").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("reported"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    told, stated = F.coalesce("reported", empty), F.coalesce("spec", empty)
    own = F.map_filter(stated, lambda k, v: v.isNotNull() & F.try_element_at(told, k).isNull())
    return claims.join(reported, "claim", "left").select("claim", "template", F.map_concat(told, own).alias("known"))


def resolve_patches(claims: DataFrame, templates: Templates, outputs: DataFrame) -> DataFrame:
    """claim, step, kind, fields, missing, blocked: each step of each claim with its fields and the required inputs it lacks.

    ``claims`` has ``claim``, ``template`` and ``spec``, a map of path to value; ``outputs`` has
    ``claim``, ``path`` and ``value`` of what resources reported and may have ``at``, a time or
    a number. Fields are the step's fixed ones and, over them, the patched ones. An optional patch
    without a value leaves its field alone; a required one blocks the step. A claim of an unknown template has no steps.
    """
    known = known_values(claims, outputs)
    rows = known.join(assembled(templates), "template").select("claim", "known", F.explode("steps").alias("s"))
    value = lambda p: F.try_element_at("known", p["source"])

    def put(fields: Column, p: Column) -> Column:
        others = F.map_filter(fields, lambda k, v: k != p["target"])
        return F.when(value(p).isNull(), fields).otherwise(F.map_concat(others, F.create_map(p["target"], value(p))))

    lacking = F.filter("s.patches", lambda p: p["required"] & value(p).isNull())
    missing = F.transform(lacking, lambda p: p["target"])
    return rows.select(
        "claim", F.col("s.step").alias("step"), F.col("s.kind").alias("kind"),
        F.map_filter(F.aggregate("s.patches", F.col("s.base"), put), lambda k, v: v.isNotNull()).alias("fields"), missing.alias("missing"),
    ).withColumn("blocked", F.size("missing") > 0)


def creation_rounds(claims: DataFrame, templates: Templates, outputs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """claim, step, round: the round in which each step of each claim can be created, counted from 1.

    A step waits for the steps whose outputs it requires and which have not reported
    yet. A step that needs a path nobody provides has no round, nor has one on a cycle of steps none
    of which has reported. ``levels`` are those of ``template_levels``; only large templates need them, and they are found here if not given.
    """
    listed, rest = _by_size(templates)
    known = known_values(claims, outputs)
    # Written, so that its size is known to the join; of what is known only the paths go there.
    planned = written(listed.select("template", F.transform("steps", lambda s: s["step"]).alias("names"), "needs"), "planned")
    rows = known.select("claim", "template", F.map_keys("known").alias("paths")).join(planned, "template")
    bit = lambda n: F.when(F.array_contains("paths", n["source"]), F.lit(0).cast("bigint")).when(n["made"] == 0, F.lit(NEVER)).otherwise(_made_bit(n))
    of = lambda bits, done: F.transform("names", lambda name, i: F.struct(name.alias("step"), _round_of(bits[i], done).alias("round")))
    each = _with(_bits(F.col("needs"), bit), lambda bits: _with(_done(bits), lambda done: of(bits, done)))
    found = rows.select("claim", F.explode(each).alias("s")).select("claim", "s.step", "s.round")
    return found if rest is None else found.unionByName(_rounds_in_passes(known, rest, levels))


def _rounds_in_passes(known: DataFrame, templates: Templates, levels: DataFrame | None) -> DataFrame:
    """``creation_rounds`` of templates of any size, for claims with their ``known`` values: step after step in the order of their levels."""
    levels = _levels_in_rounds(templates) if levels is None else levels
    listed = assembled(templates, levels)
    makers = F.transform("steps", lambda s, i: F.struct(s["output"].alias("output"), s["position"].alias("position"), (i + 1).alias("at")))

    def made(source: Column) -> Column:
        of = F.filter(makers, lambda m: m["output"] == source)
        return F.array_max(F.transform(of, lambda m: F.struct(m["position"].alias("position"), m["at"].alias("at"))))["at"]

    # Of each step what it requires: the path and the place of its maker.
    needs = F.transform("steps", lambda s: F.transform(F.filter(s["patches"], lambda p: p["required"]), lambda p: F.struct(p["source"].alias("source"), made(p["source"]).alias("made"))))
    stuck = levels.where("level IS NULL").groupBy("template").agg(F.count(F.lit(1)).cast("int").alias("stuck"))
    planned = listed.select("template", F.transform("steps", lambda s: s["step"]).alias("names"), needs.alias("needs")).join(stuck, "template", "left")
    rows = known.join(planned, "template")

    def after(rounds: Column, need: Column) -> Column:
        """The round of a step with these needs, given the rounds so far; null if one of them has none."""
        waits = F.transform(need, lambda n: F.when(F.try_element_at("known", n["source"]).isNotNull(), F.lit(0)).otherwise(F.try_element_at(rounds, n["made"])))
        return F.when(F.exists(waits, lambda w: w.isNull()), F.lit(None).cast("int")).otherwise(F.coalesce(F.array_max(waits), F.lit(0)) + 1)

    def one_pass(rounds: Column, _: Column) -> Column:
        # Steps come by level, so that what a step needs is known before it.
        return F.aggregate("needs", F.struct(rounds.alias("rounds"), F.lit(1).alias("at")), lambda a, need: F.struct(
            F.transform(a["rounds"], lambda r, i: F.when(i + 1 == a["at"], after(a["rounds"], need)).otherwise(r)).alias("rounds"), (a["at"] + 1).alias("at")
        ))["rounds"]

    # Steps without a level have no order; as many more passes as there are of them reach them all.
    passes = F.sequence(F.lit(0), F.coalesce("stuck", F.lit(0)))
    none = F.transform("names", lambda n: F.lit(None).cast("int"))
    rounds = F.aggregate(passes, none, one_pass)
    found = rows.select("claim", F.explode(F.arrays_zip(F.col("names").alias("step"), rounds.alias("round"))).alias("s"))
    return found.select("claim", F.col("s.step").alias("step"), F.col("s.round").alias("round"))
