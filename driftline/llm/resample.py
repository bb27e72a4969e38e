"""Importance resampling towards a target corpus, by hashed word runs.

Each run of words is a feature, its bucket the CRC-32 of its bytes. The logarithm of a
bucket's share in the target against its share in the documents is its gain; a document's
weight is the sum of its features' gains, and with Gumbel noise on top the greatest scores
are a draw without replacement. Features are counted and weighed in batches of whole
texts; only one count per bucket comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.batches import ship
from driftline.llm.crc import span_crcs
from driftline.operators.ranks import top_share

#: Words of a feature, at least and at most, and the number of buckets.
LEAST_RUN, MOST_RUN, BUCKETS = 1, 1, 10_000
SEED, LEAST_WORDS, SHARE = 2024, 20, (10, 100)
#: Bytes of text that are worked on at a time; a word that is longer stays whole.
PIECE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    # Words are of digits, letters and all that is not ASCII.
    inside = np.zeros(256, bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        inside[ord(low) : ord(high) + 1] = True
    inside[128:] = True
    return lower, inside


LOWER, INSIDE = _tables()


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end where a word ends."""
    at = 0
    while len(data) - at > size:
        end, step = at + size, 256
        while end < len(data):
            outside = np.flatnonzero(~INSIDE[np.frombuffer(data, np.uint8, min(step, len(data) - end), end)])
            if len(outside):
                end += int(outside[0])
                break
            end, step = min(end + step, len(data)), step * 2
        yield data[at:end]
        at = end
    yield data[at:]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in ``data``."""
    edges = np.diff(INSIDE[data].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, ends - starts


class Runs:
    """The buckets of all runs of ``least`` to ``most`` words, of texts taken together."""

    def __init__(self, least: int, most: int, buckets: int):
        self.least, self.most, self.buckets = least, most, buckets

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and for each feature its text's number and its bucket."""
        n_words = np.zeros(len(texts), np.int64)
        owners, found = [], []
        group, sizes = [], 0
        for i, text in enumerate(texts):
            if len(text) > PIECE:
                self._long(i, text, n_words, owners, found)
                continue
            group.append(i)
            sizes += len(text)
            if sizes > PIECE:
                self._several(group, texts, n_words, owners, found)
                group, sizes = [], 0
        self._several(group, texts, n_words, owners, found)
        return n_words, np.concatenate([np.zeros(0, np.int64), *owners]), np.concatenate([np.zeros(0, np.int64), *found])

    def _several(self, group: list[int], texts: list[bytes], n_words, owners, found) -> None:
        if not group:
            return
        data = np.frombuffer(b"\0".join([texts[i] for i in group]), np.uint8)
        starts, lengths = word_spans(data)
        ends = np.cumsum([len(texts[i]) + 1 for i in group])
        owner = np.searchsorted(ends, starts, "right")
        n_words[group] = np.bincount(owner, minlength=len(group))
        self._runs(LOWER[data], starts, lengths, np.asarray(group)[owner], 0, owners, found)

    def _long(self, i: int, text: bytes, n_words, owners, found) -> None:
        # The last words of a piece go before the next one, so that runs reach over its edge.
        kept, carried = b"", 0
        for piece in pieces(text):
            data = np.frombuffer(kept + piece, np.uint8)
            starts, lengths = word_spans(data)
            n_words[i] += len(starts) - carried
            self._runs(LOWER[data], starts, lengths, np.full(len(starts), i), carried, owners, found)
            carried = min(self.most - 1, len(starts))
            kept = data[starts[len(starts) - carried] :].tobytes() + b" " if carried else b""

    def _runs(self, data, starts, lengths, owner, carried: int, owners, found) -> None:
        """Features whose last word is not among the first ``carried`` ones."""
        if not len(starts):
            return
        if self.most > 1:
            # The words again, one space between them.
            first = np.cumsum(lengths + 1) - lengths - 1
            joined = np.full(int(first[-1] + lengths[-1] + 1), 32, np.uint8)
            within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            joined[np.repeat(first, lengths) + within] = data[np.repeat(starts, lengths) + within]
            data, starts = joined, first
        for n in range(self.least, self.most + 1):
            begin = np.arange(max(0, carried - n + 1), len(starts) - n + 1)
            begin = begin[owner[begin] == owner[begin + n - 1]] if n > 1 else begin
            if len(begin):
                last = begin + n - 1
                owners.append(owner[begin])
                found.append((span_crcs(data, starts[begin], starts[last] + lengths[last] - starts[begin]) % self.buckets).astype(np.int64))


def _bytes(column: pa.Array) -> list[bytes]:
    return [v.as_py() or b"" for v in column.cast(pa.binary())]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of some PIECE bytes of text, one row at least."""
    sizes = batch.column(batch.num_columns - 1).cast(pa.binary())
    at = held = 0
    for i in range(len(sizes)):
        held += len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
        if held >= 4 * PIECE:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < len(sizes):
        yield batch.slice(at)


def bucket_counts(texts: DataFrame, text_col: str = "text", least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket; a task sends at most one row per bucket."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = Runs(least, most, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _groups(batch):
                counts += np.bincount(runs.of(_bytes(part.column(0)))[2], minlength=buckets)
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bucket", "n"])

    source = texts.select(F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts (bucket, n) of the documents and of the target."""
    counts = []
    for df in (raw, target):
        one = np.zeros(buckets)
        for bucket, n in df.collect():
            one[bucket] = n
        counts.append(one)
    s, t = counts
    share = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(
    docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RUN, most: int = MOST_RUN
) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row per row of ``docs``, without a shuffle. The gains, one per bucket, are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(gain)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(least, most, len(table.value))
        for batch in batches:
            for part in _groups(batch):
                n_words, owner, bucket = runs.of(_bytes(part.column(1)))
                weight = np.zeros(part.num_rows, np.int64)
                np.add.at(weight, owner, table.value[bucket])
                n_features = np.bincount(owner, minlength=part.num_rows)
                columns = [part.column(0), pa.array(n_words), pa.array(n_features.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(seed: int, doc_id: Column) -> Column:
    """Noise of a document in thousandths, from a hash of seed and id; null is the id 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, seed: int = SEED, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
    least: int = LEAST_RUN, most: int = MOST_RUN, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: a row per row of ``docs``; rank is null for what is not drawn.

    Words are lower-cased (A-Z only) runs of digits, letters and non-ASCII characters;
    features are all runs of ``least`` to ``most`` of them, repeats counted. Of the n documents of
    ``least_words`` words or more, floor(n * share) of the greatest scores are drawn, ties to the lesser id, null
    ids last; rows that repeat an id compete like others. Null and empty texts have no features and weigh 0. An
    empty target counts no features at all, and no documents give no rows. Other columns play no part.
    """
    counted = bucket_counts(docs, text_col, least, most, buckets)
    wanted = bucket_counts(target, target_col, least, most, buckets)
    weighed = weigh(docs, gains(counted, wanted, buckets), id_col, text_col, least, most)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_share(scored, order, F.col("n_words") >= least_words, *share)
