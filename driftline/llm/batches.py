"""Row functions over Arrow batches, with bounded memory on both sides."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: An output batch is sent on when its values reach this size.
BATCH_BYTES = 16 << 20
#: Words that a task's cache keeps at most, in each of two generations.
CACHE_WORDS = 300_000
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` that end before a word begins; a longer word stays whole."""
    start, n = 0, len(data)
    while n - start > size:
        end = start + size
        while end < n and data[end] not in SPACE_BYTES:
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


def ship(spark: SparkSession) -> None:
    """Send this package's source to the workers, once per application, so that they need not have it."""
    context = spark.sparkContext
    if getattr(context, "_driftline_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    # The driver serves its copy to the workers until it ends.
    folder = tempfile.mkdtemp(prefix="driftline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "driftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for place, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._driftline_shipped = True


def rows_to_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]
) -> DataFrame:
    """Rows of ``schema`` for each row of ``df``: make() in each task gives a function from a row's values to tuples.

    mapInArrow without a shuffle; nothing outlives a task but what ``make`` keeps in its module.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for values in zip(*[column_values(c) for c in batch.columns], strict=True):
                for row in f(*values):
                    rows.append(row)
                    held += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if held >= BATCH_BYTES:
                        yield to_batch(rows, target)
                        rows, held = [], 0
        if rows:
            yield to_batch(rows, target)

    return df.mapInArrow(run, schema)


def column_values(column: pa.Array) -> Iterator:
    """The values one by one, so that a batch of long texts is not held twice."""
    return (v.as_py() for v in column)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class WordCache:
    """Values by word, of the last words used: when the young generation is full it becomes the old one."""

    def __init__(self, compute: Callable, most: int = CACHE_WORDS):
        self.compute, self.most, self.young, self.old = compute, most, {}, {}

    def __call__(self, words: list) -> list:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        get, miss = self.young.get, self.miss
        # No value is None, but one may be 0 or empty.
        return [v if (v := get(w)) is not None else miss(w) for w in words]

    def miss(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= 64:
            self.young[word] = value
        return value
