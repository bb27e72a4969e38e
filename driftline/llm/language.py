"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams, of one to three symbols, that
both contain, over the geometric mean of the numbers that each contains. Landmarks of the
training sample span it (Nystroem), ridge regression against each language in that space
gives one weight per landmark and language, and texts are scored in batches by two matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, BooleanType, DoubleType

from driftline.llm.batches import ship

#: n-grams are numbered by a hash of their code points into so many places, alike for every script.
SIZE = 1 << 18
#: Bounds of the fit: rows per language and in all (but one of each language at least), landmarks (the same), the
#: length of a text in the sample, and the rows of a language that has longer ones only. They bound the model; they do not depend on the input's size.
SAMPLE_PER_LANGUAGE, SAMPLE, LANDMARKS, SAMPLE_CHARS, LONG_TEXTS = 256, 4096, 128, 20_000, 2
RIDGE = 1e-2
#: Texts per matrix product, and characters of a text taken at a time.
BATCH, PART = 128, 1 << 20
UNKNOWN = "und"


def letters() -> np.ndarray:
    """For each code point, that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text), PART):
        yield np.frombuffer(text[i : i + PART].encode("utf-32-le", "surrogatepass"), "<u4")


# Odd multipliers, one for each place in an n-gram; the high bits of the product's sum are the n-gram's number.
_ONE, _TWO, _THREE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - 18)


def grams(text: str, low: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The n-grams that ``text`` contains, as sorted numbers below SIZE; ``flags`` is all false before and after.

    ``low`` is ``letters()``. n-grams are of lower-cased letters and 0 for a run of what is no letter.
    """
    tail = np.zeros(1, np.uint32)
    for points in code_points(text):
        s = np.concatenate([tail, low[points]])
        s = s[np.concatenate([[True], (s[1:] | s[:-1]) != 0])]
        one = s * _ONE
        two = one[:-1] + s[1:] * _TWO
        three = two[:-1] + s[2:] * _THREE
        for numbers in (one, two, three):
            flags[numbers >> _SHIFT] = True
        tail = s[-2:]
    # The separator by itself says nothing.
    flags[0] = False
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


class Model:
    """Landmarks' n-grams and the weight of each landmark for each language."""

    def __init__(self, rows: list[tuple[str, str]], ridge: float = RIDGE, landmarks: int = LANDMARKS):
        """``rows``: (language, text) in the order in which landmarks are taken."""
        self.languages = sorted({lang for lang, _ in rows})
        self.table = letters()
        flags = np.zeros(SIZE, bool)
        sets = [grams(t, self.table, flags) for _, t in rows]
        share, taken, chosen = max(1, landmarks // max(1, len(self.languages))), Counter(), []
        for i, (lang, _) in enumerate(rows):
            if taken[lang] < share and len(sets[i]):
                taken[lang] += 1
                chosen.append(i)
        used = np.unique(np.concatenate([sets[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        self.column = np.full(SIZE, -1, np.int32)
        self.column[used] = np.arange(len(used), dtype=np.int32)
        marks = self.presence([sets[i] for i in chosen])
        self.marks = (marks / np.sqrt(np.maximum(1, [len(sets[i]) for i in chosen]))[:, None]).T.astype(np.float32).copy()
        kernel = self.kernel(sets).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[chosen])
        keep = values > 1e-6 * max(1e-12, values.max(initial=0))
        root = vectors[:, keep] / np.sqrt(values[keep])
        mapped = kernel @ root
        one = np.array([[lang == x for x in self.languages] for lang, _ in rows], float).reshape(len(rows), len(self.languages))
        solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ one)
        self.weights = (root @ solved).astype(np.float32)

    def presence(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), int((self.column >= 0).sum())), np.float32)
        for i, s in enumerate(sets):
            known = self.column[s]
            out[i, known[known >= 0]] = 1
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Texts by landmarks, in batches."""
        parts = [np.zeros((0, self.marks.shape[1]), np.float32)]
        for i in range(0, len(sets), BATCH):
            some = sets[i : i + BATCH]
            norms = np.sqrt(np.maximum(1, [len(s) for s in some])).astype(np.float32)
            parts.append((self.presence(some) @ self.marks) / norms[:, None])
        return np.concatenate(parts)

    def predict(self, sets: list[np.ndarray]) -> list[tuple[str, float]]:
        """Language and score of each; without any n-gram the language is unknown. The first language wins a tie."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(sets)
        scores = self.kernel(sets) @ self.weights
        best = scores.argmax(axis=1)
        return [
            (self.languages[j], float(min(1.0, max(0.0, scores[i, j])))) if len(sets[i]) else (UNKNOWN, 0.0)
            for i, j in enumerate(best.tolist())
        ]


def held_out(key: Column) -> Column:
    """Whether a row is kept from training, by its id."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample of the rows that have a language and are not held out; every language among them is learned.

    Distinct texts are counted per language; then those whose hash falls below twice the share asked for
    are ranked by it, copies once, and the first come to the driver: texts of SAMPLE_CHARS characters
    at most, SAMPLE of them or one of each language, and of a language that has none as short its LONG_TEXTS shortest, whole.
    """
    rows = docs.where(~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text RLIKE '\\\\p{L}'"
    ).withColumns({"rank": F.xxhash64("text"), "chars": F.char_length("text")})
    short = F.col("chars") <= SAMPLE_CHARS
    counted = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(short, F.col("rank"))).alias("n")).collect()
    if not counted:
        return Model([])
    each = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE // len(counted)))
    shares = {r["lang"]: min(1.0, (2 * each + 50) / r["n"]) for r in counted if r["n"]}
    chosen = []
    if shares:
        share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang"))
        few = rows.where(short & (F.pmod("rank", F.lit(1 << 32)) / F.lit(float(1 << 32)) < share))
        chosen += _first(few.groupBy("lang", "rank").agg(F.min("text").alias("text")), ["rank", "text"], each)
    long_only = [r["lang"] for r in counted if not r["n"]]
    if long_only:
        chosen += _first(rows.where(F.col("lang").isin(long_only)), ["chars", "rank", "text"], LONG_TEXTS)
    return Model(sorted(chosen, key=lambda r: r[0]))


def _first(rows: DataFrame, order: list[str], each: int) -> list[tuple[str, str]]:
    """(lang, text) of the first ``each`` rows of each language, in order."""
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("at") <= each)
    return [(r["lang"], r["text"]) for r in sorted(placed.select("lang", "at", "text").collect())]


def predict_language(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``, from its whole text alone.

    lang_pred is a learned language, ``und`` with score 0 for a text that is null or has no letter or if
    nothing was learned. Letters of any script count. score is from 0 to 1. Ids may be null or repeat; other columns play no
    part. No shuffle; the model, of bounded size, is broadcast.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    schema = StructType([
        StructField("doc_id", kind), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flags = np.zeros(SIZE, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = [grams(t.as_py() or "", m.table, flags) for t in part.column(2)]
                langs, scores = zip(*m.predict(sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict_language with a model fitted to the same table's labelled rows."""
    return predict_language(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with ``least_score`` or more; all columns as they are. No shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flags = np.zeros(SIZE, bool)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                found = m.predict([grams(t.as_py() or "", m.table, flags) for t in part.column(at)])
                yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    # Numbered names on the way, as a name with a dot would not pass.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
