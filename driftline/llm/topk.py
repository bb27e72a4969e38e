"""Exact top-k by inner product, block by block: bounds first, then the blocks that they leave.

Vectors are terms with integer weights. Rows are cut into document ranges, blocks, in an
order that puts vectors of the same strongest terms side by side. A block has a forward index (its rows' weights) and
each term's greatest and least weight in it; the sum of a query's weights times these is a
bound of every score in the block. Each query takes blocks in falling order of its bounds until they fall
below its k-th score, or equal it with no smaller id to offer. Queries meet blocks in tiles: a
range of queries against a range of blocks, each of bounded size; a tile streams its blocks
and sends k rows per query, which then meet by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.batches import ship
from driftline.operators.ranks import numbered

#: Rows of a block, and of a group of queries that takes blocks together.
BLOCK, GROUP = 256, 1024
#: Groups of queries, and blocks, of a tile at most; fewer blocks where there are tasks to spare.
TILE_GROUPS, TILE_BLOCKS = 8, 4096
#: Bytes of blocks that a tile holds at a time.
HELD = 32 << 20
#: Strongest terms that decide a row's place in the document order.
LEADING = 3
SCALE = 64
NO_ID = np.iinfo(np.int64).max
PACKED = "ids binary, width int, size int, weights binary, most binary, least binary"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long (its ends, where that is beyond it); null for a null, or one not finite, anywhere."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _packed(ids: list, vectors: list[np.ndarray]) -> tuple:
    """A block or group as one row, its weights in the narrowest integers that hold them."""
    width = max(map(len, vectors))
    weights = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(weights, vectors, strict=True):
        row[: len(v)] = v
    top = max(int(weights.max(initial=0)), -int(weights.min(initial=0)))
    size = next(s for s in (1, 2, 4, 8) if s == 8 or top < 1 << (8 * s - 1))
    numbers = np.array([NO_ID if i is None else i for i in ids], np.int64)
    kind = np.dtype(f"i{size}")
    edges = [e(axis=0).astype(kind).tobytes() if width else b"" for e in (weights.max, weights.min)]
    return numbers.tobytes(), width, size, weights.astype(kind).tobytes(), *edges


def _matrix(data: bytes, width: int, size: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"i{size}").reshape(rows, width)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (ids, width, size, weights, most, least) of at most ``rows`` vectors (id, v) each, from neighbours in their partition; no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(vectors.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def close():
            columns = [pa.array([x], t) for x, t in zip(_packed(ids, held), schema.types, strict=True)]
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, v in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                ids.append(i)
                held.append(np.array(v, np.int64))
                if len(ids) == rows:
                    yield close()
        if ids:
            yield close()

    return vectors.select("id", "v").mapInArrow(run, PACKED)


class Best:
    """The k best of some queries so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, kind: np.dtype):
        self.k = k
        # Below every score, with an id above every other: an empty place.
        self.none = -np.inf if kind.kind == "f" else None
        self.scores = np.full((queries, k), -np.inf if kind.kind == "f" else -(1 << 200), kind)
        self.ids = np.full((queries, k), NO_ID, np.int64)
        self.used = np.zeros((queries, k), bool)

    def hopeful(self, rows: np.ndarray, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        """Whether a block with these bounds and least ids can still change a row's best."""
        kth, kth_id, full = self.scores[rows, -1], self.ids[rows, -1], self.used[rows, -1]
        return ~full | (bounds > kth) | ((bounds == kth) & (least_ids < kth_id))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """``scores`` of ``rows`` by columns with these ``ids``; only what is ``valid``."""
        kth, kth_id, full = self.scores[rows, -1:], self.ids[rows, -1:], self.used[rows, -1:]
        better = valid & (~full | (scores > kth) | ((scores == kth) & (ids < kth_id)))
        touched = np.flatnonzero(better.any(axis=1))
        if not len(touched):
            return
        rows, better = rows[touched], better[touched]
        # Each touched row's better columns, to the left.
        most = int(better.sum(axis=1).max())
        order = np.argsort(~better, axis=1, kind="stable")[:, :most]
        used = np.concatenate([self.used[rows], np.take_along_axis(better, order, 1)], axis=1)
        all_scores = np.concatenate([self.scores[rows], np.take_along_axis(scores[touched], order, 1)], axis=1)
        all_ids = np.concatenate([self.ids[rows], ids[order]], axis=1)
        best = np.lexsort((all_ids, -all_scores, ~used), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, best, 1)
        self.ids[rows] = np.take_along_axis(all_ids, best, 1)
        self.used[rows] = np.take_along_axis(used, best, 1)


def _fitted(matrix: np.ndarray, width: int, kind: np.dtype) -> np.ndarray:
    """``matrix`` with ``width`` columns; missing terms weigh 0, and terms that the other side lacks go."""
    out = np.zeros((len(matrix), width), kind)
    n = min(width, matrix.shape[1])
    out[:, :n] = matrix[:, :n]
    return out


class Group:
    """Queries that take blocks together, and their best so far."""

    def __init__(self, row: dict, k: int, kind: np.dtype):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.weights = _matrix(row["weights"], row["width"], row["size"], len(self.ids)).astype(kind)
        self.first = row["first"]
        self.best = Best(len(self.ids), k, kind)

    def search(self, blocks: list[dict], kind: np.dtype) -> None:
        """Take ``blocks`` in falling order of each query's bounds until they cannot change its best."""
        width = self.weights.shape[1]
        most = np.concatenate([_fitted(b["most"], width, kind) for b in blocks])
        least = np.concatenate([_fitted(b["least"], width, kind) for b in blocks])
        # The greatest product of a weight with anything between a term's least and most.
        bounds = np.maximum(self.weights, 0) @ most.T + np.minimum(self.weights, 0) @ least.T
        least_ids = np.array([b["least_id"] for b in blocks])
        order = np.lexsort((np.broadcast_to(least_ids, bounds.shape), -bounds), axis=1)
        active, at, step = np.arange(len(self.ids)), 0, 1
        while at < len(blocks) and len(active):
            # The next blocks of each query; twice as many each time, so that queries of a block meet it together.
            turn = order[active, at : at + step]
            for b in np.unique(turn):
                rows = active[(turn == b).any(axis=1)]
                rows = rows[self.best.hopeful(rows, bounds[rows, b], least_ids[b])]
                if len(rows):
                    block = blocks[b]
                    scores = self.weights[rows] @ _fitted(block["weights"], width, kind).T
                    self.best.add(rows, scores, block["ids"], block["ids"] != self.ids[rows, None])
            at, step = at + step, max(1, at + step)
            if at < len(blocks):
                following = order[active, at]
                active = active[self.best.hopeful(active, bounds[active, following], least_ids[following])]

    def rows(self) -> Iterator[tuple]:
        """number, id, score, candidate id of the best."""
        for q, place in zip(*np.nonzero(self.best.used), strict=True):
            yield int(self.first + q), int(self.ids[q]), int(self.best.scores[q, place]), int(self.best.ids[q, place])


def number_kind(top: int, other: int, width: int) -> np.dtype:
    """The type in which sums of ``width`` products of numbers up to ``top`` and ``other`` are exact."""
    most = top * other * max(1, width)
    return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object)


def _tile_rows(k: int, kind: np.dtype):
    """The function of a tile's rows, groups of queries first and then blocks, to its best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, groups, blocks, held = None, [], [], 0

        def search():
            for g in groups:
                g.search(blocks, kind)
            blocks.clear()

        def close():
            if blocks:
                search()
            for g in groups:
                rows = list(g.rows())
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "query_id", "score", "vec_id"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["tile"] != tile:
                    yield from close()
                    tile, groups, blocks, held = row["tile"], [], [], 0
                if row["first"] is not None:
                    groups.append(Group(row, k, kind))
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                matrices = {c: _matrix(row[c], row["width"], row["size"], n) for c, n in (("weights", len(ids)), ("most", 1), ("least", 1))}
                blocks.append({"ids": ids, "least_id": int(ids.min()), **matrices})
                held += len(row["weights"]) + len(row["ids"])
                if held > HELD:
                    search()
                    held = 0
        yield from close()

    return run


def top_scores(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest integer inner products of each query row with all rows but its own.

    ``queries`` is a condition on rows of ``vectors``; a query without an id is none. Components are floor(scale * x); vectors
    that are null or hold a null or a component that is not finite take no part. Of vectors of different lengths the shorter is
    filled with zeros, an empty one too. A query's own are all rows with its id; each row of an id that repeats is a query
    and a candidate of its own. Ties go to the smaller id, null ids last. Fewer candidates than
    ``k`` give as many rows; no rows give none. A score beyond a long is an error. Other columns play no part.

    Nothing is sampled and nothing left out: a bound only saves work. Blocks and queries
    of each tile are bounded in rows; what moves is each block once per TILE_GROUPS groups of queries.
    """
    spark = vectors.sparkSession
    ids = F.col(id_col).cast("bigint")
    valid = vectors.select(ids.alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(queries & ids.isNotNull(), F.lit(False)).alias("q")).where("v IS NOT NULL")
    strongest = F.slice(F.array_sort(F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("a"), (2 * i + F.when(x < 0, 1).otherwise(0)).alias("t")))), 1, LEADING)
    placed = valid.withColumn("place", F.transform(strongest, lambda s: s["t"])).sortWithinPartitions("place", "id")
    blocks = numbered(packed(placed, BLOCK))
    groups = numbered(packed(placed.where("q"), GROUP))
    n_blocks, n_groups = blocks.count(), groups.count()
    if not n_groups:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    tops = [_greatest(df) for df in (blocks, groups)]
    kind = number_kind(tops[0][0], tops[1][0], min(tops[0][1], tops[1][1]))
    ranges = -(-n_groups // TILE_GROUPS)
    spare = int(spark.conf.get("spark.sql.shuffle.partitions")) // ranges
    cuts = max(-(-n_blocks // TILE_BLOCKS), min(n_blocks, spare))
    tiled = _tiled(blocks, groups, n_blocks, ranges, cuts)
    found = tiled.mapInArrow(_tile_rows(k, kind), "number bigint, query_id bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def _greatest(df: DataFrame) -> tuple[int, int]:
    """A number that no weight exceeds, by the bytes they take, and the most terms."""
    size, width = df.agg(F.max("size"), F.max("width")).first()
    return 1 << (8 * size - 1), width


def _tiled(blocks: DataFrame, groups: DataFrame, n_blocks: int, ranges: int, cuts: int) -> DataFrame:
    """Rows of tiles: each group of queries once per range of blocks, each block once per range of groups; groups come first."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    of_block = F.floor((F.col("number") - 1) * cuts / n_blocks).cast("int")
    of_group = F.floor((F.col("number") - 1) / TILE_GROUPS).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = groups.select(*names, ((F.col("number") - 1) * GROUP).alias("first"), of_group.alias("r"), each(cuts).alias("c"))
    two = blocks.select(*names, F.lit(None).cast("bigint").alias("first"), of_block.alias("c"), each(ranges).alias("r"))
    rows = one.unionByName(two).withColumn("tile", F.col("r") * F.lit(cuts) + F.col("c")).drop("r", "c")
    tiles = ranges * cuts
    return rows.repartitionByRange(tiles, "tile").sortWithinPartitions("tile", F.col("first").asc_nulls_last())
