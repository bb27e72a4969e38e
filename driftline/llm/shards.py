"""Token sequences in training order: a keyed permutation gives each its place, and shards of fixed stride hold them in that order.

A sequence's number is its document's times the most sequences a document may have, plus
its own place in the document, so that it is known without counting anything before it. A Feistel
network with cycle-walking permutes the numbers' whole range; the order of the permuted numbers is the
training order, whatever the shards. Each shard holds a range of them and is
sorted; what lies before it in other shards makes its places global slots.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.batches import column_values, ship
from driftline.llm.pieces import byte_pieces

#: Ids of a sequence, and bytes of a shard, about.
LENGTH, SHARD_BYTES = 256, 16 << 20
ROUNDS = 6
#: doc_id, place in the document (the top bit: no id), ids that are not padding.
HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
NO_ID = 1 << 31
#: Bytes of ids per byte of text, for the number of shards only.
IDS_PER_BYTE = 0.9
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters of a text, and records, that are worked on at a time.
PART, RECORDS = 1 << 20, 4096
SEQUENCES = "slot bigint, doc_id bigint, seq bigint, n_ids bigint, ids binary"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixture."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of range(size), chosen by ``key``, at ``numbers``.

    The network works on the least even number of bits that holds the range, at most four times it; results outside
    go through again until they fall inside, which stays a permutation.
    """
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (mixed(right, key * ROUNDS + i) & mask)
        out[todo] = x = left << half | right
        todo = todo[x >= np.uint64(size)]
    return out


class ByteBpe:
    """Ids of texts under a rank file."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        ranks = {piece: i for i, piece in enumerate(byte_pieces(data))}
        self.type = "<u2" if len(ranks) < 1 << 16 else "<u4"
        self.end = np.array([len(ranks)], self.type).tobytes()
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids of ``text`` and of its end, in pieces. No match of the pattern goes from the end of a word into white space, so texts can be cut there."""
        at = 0
        while len(text) - at > PART and (m := CUT.search(text, at + PART)):
            yield np.array(self.coder.encode_ordinary(text[at : m.start()]), self.type).tobytes()
            at = m.start()
        yield np.array(self.coder.encode_ordinary(text[at:] if at else text), self.type).tobytes()
        yield self.end


_LOADED: dict[tuple[int, str], ByteBpe] = {}


def loaded(data: bytes, pattern: str) -> ByteBpe:
    key = hash(data), pattern
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(data, pattern)
    return _LOADED[key]


def document_numbers(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[Column, int, int, int]:
    """A number per document, its range, the most sequences of one, and the bytes of all texts."""
    key = F.col(id_col).cast("long")
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    low, high, most, total = docs.agg(F.min(key), F.max(key), F.max(size), F.sum(size.cast("long"))).first()
    sequences = ((most or 0) + 1 + length - 1) // length  # no more ids than bytes, and the end
    count = 1 if low is None else high - low + 2
    if count * sequences < 1 << 62:
        return F.coalesce(key - F.lit(low or 0) + 1, F.lit(0).cast("long")), count, sequences, total or 0
    # Ids too far apart: documents that share a hash share numbers, and their ids order them.
    bits = 61 - sequences.bit_length()
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(1 << bits)), F.lit(0).cast("long")), 1 << bits, sequences, total or 0


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str, pattern: str, key: int = 17, length: int = LENGTH,
    shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the token sequences of all texts to ``folder`` in training order.

    A document's ids and an end id are cut into sequences of ``length``, the last one filled up with end ids. Null and
    empty texts are one sequence of the end alone. Ids of documents are whole numbers or null; where they repeat, document and content
    order the equal places. ``folder``/data has a file per shard=N, records of one size each ending in a line feed;
    ``folder``/manifest has shard, records and first slot; ``folder``/format.json what the files are.
    """
    spark = docs.sparkSession
    number, count, most, total = document_numbers(docs, id_col, text_col, length)
    domain = count * most
    shards = max(1, -(-int(total * IDS_PER_BYTE) // shard_bytes))
    width = -(-domain // shards)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def records_of(coder: ByteBpe, doc: int | None, text: str) -> Iterator[bytes]:
        full, place, parts, held = length * len(coder.end), 0, [], 0
        for block in coder.blocks(text):
            parts.append(block)
            held += len(block)
            if held >= full:
                ids = b"".join(parts)
                for at in range(0, held - full + 1, full):
                    yield struct.pack(HEAD, doc or 0, place | (NO_ID if doc is None else 0), length) + ids[at : at + full]
                    place += 1
                parts, held = [ids[held - held % full :]], held % full
        if held:
            count = held // len(coder.end)
            head = struct.pack(HEAD, doc or 0, place | (NO_ID if doc is None else 0), count)
            yield head + b"".join(parts) + coder.end * (length - count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(data.value, pattern)
        numbers: list[int] = []
        held: list[bytes] = []

        def sent():
            places = permuted(np.array(numbers, np.uint64), domain, key)
            batch = pa.RecordBatch.from_arrays(
                [pa.array((places // np.uint64(width)).astype(np.int32)), pa.array(places.astype(np.int64)), pa.array(held, pa.binary())],
                ["shard", "place", "record"],
            )
            numbers.clear(), held.clear()
            return batch

        for batch in batches:
            for doc, first, text in zip(*[column_values(c) for c in batch.columns], strict=True):
                for i, record in enumerate(records_of(coder, doc, text or "")):
                    numbers.append(first * most + i)
                    held.append(record)
                    if len(held) == RECORDS:
                        yield sent()
        if held:
            yield sent()

    ship(spark)
    source = docs.select(F.col(id_col).cast("long"), number.alias("number"), F.col(text_col).cast("string"))
    records = source.mapInArrow(run, "shard int, place bigint, record binary")
    ordered = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "record")
    out = ordered.select("shard", F.col("record").cast("string").alias("value"))
    out.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(f"{folder}/data")
    unit = 2 if len(byte_pieces(data.value)) < 1 << 16 else 4
    form = {"length": length, "unit": unit, "stride": HEAD_SIZE + length * unit + 1, "key": key, "domain": domain, "shards": shards}
    spark.createDataFrame([(json.dumps(form),)], "value string").coalesce(1).write.text(f"{folder}/format.json")
    files = shard_files(spark, [f"{folder}/data"]).select("shard", F.floor(F.col("length") / form["stride"]).alias("records"))
    # A row per shard: few, and of no size.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("shard").agg(F.sum("records").alias("records"))
    sizes.withColumn("first", F.coalesce(F.sum("records").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")


def shard_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int"))


def shard_format(spark: SparkSession, folder: str) -> dict[str, int]:
    return json.loads(spark.read.text(f"{folder}/format.json").first()[0])


def read_shards(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, doc_id, seq, n_ids, ids (binary, without padding) of the slots from ``start`` to before ``stop``.

    Only shards that hold some are opened, and in them the records are found by their stride.
    """
    ship(spark)
    form = shard_format(spark, folder)
    stride, unit = form["stride"], form["unit"]
    manifest = spark.read.schema("shard int, records long, first long").parquet(f"{folder}/manifest")
    paths = [f"{folder}/data"]
    if start > 0 or stop is not None:
        # At most a row per shard; files outside the range are not opened.
        stop = 1 << 62 if stop is None else stop
        manifest = manifest.where((F.col("first") < stop) & (F.col("first") + F.col("records") > start) & (F.col("records") > 0))
        paths = [f"{folder}/data/shard={r['shard']}" for r in manifest.collect()]
        if not paths:
            return spark.createDataFrame([], SEQUENCES)
    stop = 1 << 62 if stop is None else stop
    files = shard_files(spark, paths).join(manifest, "shard").select("first", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view = memoryview(content.as_buffer())
                for at in range(max(0, start - first), min(len(view) // stride, stop - first), 10_000):
                    slots, heads, ids = [], [], []
                    for i in range(at, min(at + 10_000, len(view) // stride, stop - first)):
                        head = struct.unpack_from(HEAD, view, i * stride)
                        body = i * stride + HEAD_SIZE
                        slots.append(first + i)
                        heads.append(head)
                        ids.append(bytes(view[body : body + head[2] * unit]))
                    docs = [None if place & NO_ID else doc for doc, place, _ in heads]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots, pa.int64()), pa.array(docs, pa.int64()), pa.array([p & ~NO_ID for _, p, _ in heads], pa.int64()),
                         pa.array([n for *_, n in heads], pa.int64()), pa.array(ids, pa.binary())],
                        ["slot", "doc_id", "seq", "n_ids", "ids"],
                    )

    return files.mapInArrow(run, SEQUENCES)
