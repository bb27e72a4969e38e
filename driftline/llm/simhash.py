"""Near duplicates by SimHash fingerprints, linked through BK-trees.

A BK-tree's children are keyed by their Hamming distance to the parent; a search follows
only the edges within the radius of its own distance. The fingerprints are cut into
shards so that any two within the radius share one: of b blocks of bits, two fingerprints
that differ in at most r bits agree on some b - r. A shard's tree is built and searched
where the shard is. Sending the shards' trees to all tasks instead would take every
fingerprint through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.batches import blocks, rows_to_rows, ship
from driftline.llm.components import components, written
from driftline.llm.text import all_columns

SEED = 42
BITS = 64
SHINGLE = 4
RADIUS = 4
#: Members that a shard should have on average, and at most before it is cut by further bits.
SHARD_MEAN, SHARD_MOST = 64, 4096
#: How often a shard above that is cut before any two blocks of it make a tree.
CUTS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of word shingles, repeats included; 0 without words."""
    digest, before, counts, total = xxhash.xxh64_digest, [], np.zeros(BITS, np.int64), 0
    parts = list(blocks((text or "").encode().lower()))
    for k, part in enumerate(parts):
        words = before + part.split()
        if len(words) < shingle:
            if k < len(parts) - 1 or total or not words:
                before = words
                continue
            size = len(words)
        else:
            size = shingle
        joined = b" ".join(words)
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends[: len(ends) - size])]
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)])
        rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for i in range(0, len(rows), 1 << 16):
            counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
        total += len(rows)
        before = words[len(words) - shingle + 1 :] if size == shingle else []
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big") if total else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Distinct integers by Hamming distance, with the classes that links of at most ``radius`` bits make.

    A node knows whether all below it are of one class; a search skips such a subtree when
    what it searches for is of that class already, so that dense groups stay cheap.
    """

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent, self.same = radius, [], [], [], []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, x: int) -> None:
        values, children, same, r = self.values, self.children, self.same, self.radius
        me = len(values)
        self.parent.append(me)
        stack = [0] if me else []
        while stack:
            n = stack.pop()
            if same[n] >= 0 and self.find(same[n]) == self.find(me):
                continue
            d = (values[n] ^ x).bit_count()
            if d <= r:
                a, b = self.find(n), self.find(me)
                # The smaller index stays, so that a class is named by its first member.
                self.parent[max(a, b)] = min(a, b)
            for k, c in children[n].items():
                if -r <= k - d <= r:
                    stack.append(c)
        n, mine = 0, self.find(me)
        while me:
            if same[n] >= 0 and self.find(same[n]) != mine:
                same[n] = -1
            d = (values[n] ^ x).bit_count()
            if d not in children[n]:
                children[n][d] = me
                break
            n = children[n][d]
        values.append(x)
        children.append({})
        same.append(me)
        if me >= 255 and (me + 1) & me == 0:
            self.refresh()

    def refresh(self) -> None:
        """Find again which subtrees are of one class; children have greater indices than parents."""
        for n in range(len(self.values) - 1, -1, -1):
            mine = self.find(n)
            one = all(self.same[c] >= 0 and self.find(self.same[c]) == mine for c in self.children[n].values())
            self.same[n] = mine if one else -1

    def links(self) -> Iterator[tuple[int, int]]:
        """Each value with its class's first, where that is another."""
        for i, x in enumerate(self.values):
            j = self.find(i)
            if i != j:
                yield x, self.values[j]


def block_masks(bits: list[int], radius: int, count: int) -> list[int]:
    """Masks of count - radius out of count blocks of ``bits``, one for each choice."""
    sizes = [len(bits) * (i + 1) // count for i in range(count)]
    parts = [sum(1 << b for b in bits[s:e]) for s, e in zip([0, *sizes], sizes, strict=False)]
    return [sum(c) for c in combinations(parts, count - radius)]


def shard_masks(rows: int, bits: list[int], radius: int) -> list[int]:
    """Masks whose shards have SHARD_MEAN of ``rows`` evenly spread fingerprints at most, as few masks as do."""
    for count in range(radius + 1, len(bits) + 1):
        masks = block_masks(bits, radius, count)
        if rows >> min(m.bit_count() for m in masks) <= SHARD_MEAN or len(masks) > 100:
            break
    return masks


def shard_links(shards: DataFrame, radius: int, most: int | None) -> DataFrame:
    """a, b, whole: links inside the shards of ``fp`` by ``shard``; of a shard above ``most``, its members as (a, shard, whole = true)."""
    ship(shards.sparkSession)
    dealt = shards.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bool]] = []
        key, members, large = None, [], False

        def close():
            if len(members) > 1:
                tree = BKTree(radius)
                for x in members:
                    tree.add(x)
                out.extend((signed(a), signed(b), False) for a, b in tree.links())

        def sent():
            a, b, whole = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(whole, pa.bool_())], ["a", "b", "whole"])

        for batch in batches:
            for k, fp in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    close()
                    key, members, large = k, [], False
                members.append(fp & (1 << 64) - 1)
                if large or (most is not None and len(members) > most):
                    # Too many for one tree: they go on as rows and are held no longer.
                    out.extend((signed(x), k, True) for x in members)
                    members, large = [], True
                if len(out) >= 100_000:
                    yield sent()
        close()
        if out:
            yield sent()

    return dealt.mapInArrow(run, "a bigint, b bigint, whole boolean")


def cut_shards(large: DataFrame, radius: int, most: int) -> DataFrame:
    """fp, shard: each shard cut by radius + 1 blocks of bits, of which any two within the radius share one.

    A shard's own bits are dealt to the blocks by how evenly they split it, so that bits that
    are alike in all its members, which are those of earlier cuts too, make no block useless.
    """
    ones = F.array(*[F.count_if(F.col("fp").bitwiseAND(F.lit(signed(1 << b))) != 0) for b in range(BITS)])
    counts = large.groupBy("shard").agg(F.count("*").alias("n"), ones.alias("ones"))
    bits = F.array(*[F.lit(signed(1 << b)) for b in range(BITS)])
    uneven = F.zip_with("ones", bits, lambda c, bit: F.struct((-F.least(c, F.col("n") - c)).alias("even"), bit.alias("bit")))
    dealt = counts.select("shard", F.array_sort(uneven).alias("bits"))

    def mask(j: int):
        dealt_to = F.filter("bits", lambda x, i: (x.even < 0) & (i % (radius + 1) == j))
        return F.aggregate(dealt_to, F.lit(0).cast("bigint"), lambda all_, x: all_.bitwiseOR(x.bit))

    cut = large.join(dealt.select("shard", F.array(*[mask(j) for j in range(radius + 1)]).alias("masks")), "shard")
    parts = cut.select("fp", "shard", F.posexplode("masks").alias("block", "mask"))
    return parts.select("fp", F.xxhash64("shard", "block", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))


def pair_shards(large: DataFrame, radius: int, most: int) -> DataFrame:
    """fp, shard: each shard as blocks of some most / 2 members, and a shard for any two blocks."""
    counts = large.groupBy("shard").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("blocks"))
    dealt = large.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = dealt.select("fp", "shard", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
    return met.select("fp", F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")).alias("shard"))


def fingerprint_links(prints: DataFrame, rows: int, radius: int, most: int = SHARD_MOST) -> DataFrame:
    """a, b: links that connect just those of the distinct ``fp`` that links of at most ``radius`` bits connect.

    Shards above ``most`` members are cut again, three times at most, by bits that split them
    evenly. What is large even then becomes trees of two blocks each, so that no task holds more
    than about ``most`` members at a time. Shards are named by hashes; a name that two of them
    share makes one shard of both, which costs time only.
    """
    masks = shard_masks(rows, list(range(BITS)), radius)
    names = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    found = written(shard_links(prints.select("fp", F.explode(names).alias("shard")), radius, most), "shard-links")
    links = found.where("NOT whole").select("a", "b")
    for again in [cut_shards] * CUTS + [pair_shards]:
        large = found.where("whole").select(F.col("a").alias("fp"), F.col("b").alias("shard"))
        if large.isEmpty():
            break
        found = written(shard_links(again(large, radius, most), radius, most if again is cut_shards else None), "shard-links")
        links = links.unionByName(found.where("NOT whole").select("a", "b"))
    return links


def document_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, text_key, fp: a written table with a row per row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda key, text_key, text: ((key, text_key, signed(fingerprint(text, shingle))),)

    source = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string"))
    return written(rows_to_rows(source, f"doc_id {kind}, text_key bigint, fp bigint", make), "fingerprints")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """doc_id, text_key, fingerprint, component_id, kept: a row for each row of ``docs``.

    The fingerprint is of shingles of words in lower case (A-Z only); a text of fewer words
    is one shingle, and null, empty or blank is fingerprint zero, linked like any other.
    component_id is the least id among all that chains of links reach; null ids count only
    where there is no other. kept marks the row of that id, or all its repeats where id and text
    repeat. No rows give no rows; other columns of ``docs`` play no part.
    """
    prints = document_prints(docs, id_col, text_col, shingle)
    # The least member of each fingerprint: null ids last.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    distinct = written(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, distinct.count(), radius))
    rooted = written(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    named = written(rooted.join(least, "root").select("fp", "least"), "named")
    return prints.join(named, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, that of the least id, all columns as they are."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept")
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.col("text_key").alias("key")).distinct()
    # The documents' columns travel as one, so that none of them can be taken for one of the join's.
    keyed = docs.select(F.struct(*all_columns(docs)).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.xxhash64(text_col).alias("key"))
    same = Window.partitionBy("id", "key").orderBy("id")
    rows = keyed.join(kept, ["id", "key"], "left_semi").withColumn("number", F.row_number().over(same))
    return rows.where("number = 1").select("row.*")
