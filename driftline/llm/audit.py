"""How filters interact: what each removes in every order, what it removes for nothing, and what only it removes.

A document counts only through its cell, the set of filters that it fails as a bit mask, within its
part. Each cell's counts are folded over all orders of the filters by higher-order
SQL functions, into one struct per order and step; a part's cells are summed
element by element. So the orders cost nothing per document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.lines import bind
from driftline.llm.text import word_list
from driftline.session import written

#: Measures of a step, as SQL over a cell c, the failure of this filter, and the failure of one before it.
MEASURES = {
    "kept": "if(acc.gone OR hit, 0L, c.n)",
    "removed": "if(hit AND NOT acc.gone, c.n, 0L)",
    "redundant": "if(hit AND acc.gone, c.n, 0L)",
    "unique_fails": "if(hit AND c.mask = shiftleft(1, f), c.n, 0L)",
    "good_lost": "if(hit AND NOT acc.gone, c.good, 0L)",
    "toxic_lost": "if(hit AND NOT acc.gone, c.toxic, 0L)",
}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"


def text_failures(text: Column) -> Column:
    """A struct of whether a text (null: empty) fails each of four filters: A few words, B repeated words, C capitals, D signs."""
    text = F.coalesce(text, F.lit(""))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    rest = ((100 * capitals > MOST_CAPITALS * F.char_length(text)).alias("C"), text.rlike(SIGNS).alias("D"))

    def of_words(ws: Column) -> Column:
        n = F.size(ws)
        return F.struct((n < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct(ws)) < LEAST_DISTINCT * n).alias("B"), *rest)

    return bind(word_list(text), of_words)


def document_facts(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, digest, mask: a written table with a row per row of ``docs``; bits 0 to 3 of the mask are the text's failures."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mask = bind(text_failures(text), lambda f: sum(f[c].cast("int") * (1 << i) for i, c in enumerate("ABCD")))
    facts = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    return written(facts, "facts")


def with_copies(facts: DataFrame, bit: int) -> DataFrame:
    """``facts`` with the bit of the mask set where a smaller doc_id has the same digest; null ids are the greatest.

    Copies combine inside each task before they meet by digest, and come back by (digest,
    doc_id), so that a text with a third of all rows is no hot key.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    firsts = facts.groupBy("digest").agg(F.min(order)["doc_id"].alias("first_id"))
    firsts = firsts.select(F.col("digest").alias("first_digest"), "first_id", F.lit(True).alias("is_first"))
    same = (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    copy = F.col("is_first").isNull().cast("int")
    return facts.join(firsts, same, "left").select("doc_id", "part", (F.col("mask") + copy * (1 << bit)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with good and toxic; a document without a label or an id is neither, one with several is what any of them says."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # Null ids meet nothing, and spread by their mask's place in the table instead of going to one task.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("bigint"))
    masks = masks.withColumn("_spread", spread)
    met = masks.join(marks.withColumn("_spread", F.lit(0).cast("bigint")), ["doc_id", "_spread"], "left")
    return met.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interaction(marked: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, the measures and shapley, from a row per document with part, mask, good and toxic.

    One row per part, order of the filters and step, zeros included; bit i of the mask is
    the failure of the i-th letter. A part has at most 2^filters cells, which are all that
    meets in one task, and as many orders as the filters have permutations. No documents give no rows.
    """
    orders = list(permutations(range(len(letters))))
    cells = marked.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    parts = parts.withColumn("orders", F.array(*[F.array(*[F.lit(f) for f in o]) for o in orders]))
    zero = "named_struct(" + ", ".join(f"'{m}', 0L" for m in MEASURES) + ")"
    bound = {m: sql.replace("hit", "(shiftright(c.mask, f) & 1 = 1)") for m, sql in MEASURES.items()}
    step = "named_struct(" + ", ".join(f"'{m}', {sql}" for m, sql in bound.items()) + ")"
    fold = (
        f"flatten(transform(orders, o -> aggregate(o, named_struct('gone', false, 'steps', array_repeat({zero}, 0)),"
        f" (acc, f) -> named_struct('gone', acc.gone OR shiftright(c.mask, f) & 1 = 1, 'steps', concat(acc.steps, array({step}))), acc -> acc.steps)))"
    )
    added = "named_struct(" + ", ".join(f"'{m}', x.{m} + y.{m}" for m in MEASURES) + ")"
    sums = F.expr(f"aggregate(cells, array_repeat({zero}, {len(orders) * len(letters)}), (sums, c) -> zip_with(sums, {fold}, (x, y) -> {added}))")
    shares = F.expr(
        f"transform(sequence(0, {len(letters) - 1}), g -> aggregate(zip_with(flatten(orders), sums, (f, s) -> if(f = g, s.removed, 0L)), 0L, (a, x) -> a + x))"
    )
    names = F.array(*[F.lit("".join(letters[f] for f in o)) for o in orders])
    # Between the steps stands a shuffle of a row per part, so that each is worked out once.
    summed = parts.select("part", "orders", sums.alias("sums")).select("part", "orders", "sums", shares.alias("shares"))
    rows = summed.select("part", "shares", F.flatten("orders").alias("filters"), F.posexplode("sums").alias("at", "s"))
    width = F.lit(len(letters))
    return rows.select(
        "part", F.element_at(names, F.floor(F.col("at") / width).cast("int") + 1).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"), "s.*",
        F.element_at("shares", F.element_at("filters", F.col("at") + 1) + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The interaction of the filters A to D of ``text_failures`` and E, a copy of a smaller doc_id's text, per part.

    A null part is the empty string and null text the empty text. Rows that repeat id and text are no copies of
    each other; null ids are the greatest, and no copies among themselves. Whole texts; other columns of ``docs`` play no part.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    facts = document_facts(docs, part, id_col, text_col)
    return interaction(with_labels(with_copies(facts, 4), labels), "ABCDE")
