"""Byte-pair encoding and decoding with a public vocabulary of word-end pieces.

Merges of a word are taken from a priority queue by rank, over a doubly linked list of
symbols; entries whose symbols have since been merged are skipped. Decoding concatenates
the vocabulary's strings.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable
from hashlib import sha256

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.batches import WordCache, rows_to_rows

# Fixed values of the vocabulary's file format: how it writes bytes as characters, the mark
# of a word's end, its white space and the pattern of its words.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WORD_END = "</w>"
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Chunks of a text that are encoded at a time, and chunks in each generation of the cache.
BLOCK, CACHED = 50_000, 200_000


def byte_characters() -> list[str]:
    others = [b for b in range(256) if b not in PRINTABLE]
    return [chr(b) if b in PRINTABLE else chr(256 + others.index(b)) for b in range(256)]


def merge_ids(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``ids`` after all merges, least rank first and leftmost among equals; n log n in the word's length."""
    n = len(ids)
    if n < 2:
        return ids
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = []
    for i in range(n - 1):
        found = merges.get((ids[i], ids[i + 1]))
        if found is not None:
            queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j] = merged, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            found = merges.get((merged, ids[k]))
            if found is not None:
                heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((ids[h], merged))
            if found is not None:
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
    return [x for x in ids if x >= 0]


class WordBpe:
    """Encoder and decoder of a vocabulary file's bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        pairs = (p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.inner = [vocab.get(c) for c in chars]
        self.last = [vocab.get(c + WORD_END) for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**vocab, **self.special}
        self.strings = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.strings[i] = name.encode()
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORD)
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.chunks = regex.compile(f"[^{SPACE}]+")
        self.cache = WordCache(self.chunk_ids, CACHED)

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a run without white space, as little-endian 32-bit integers."""
        parts = self.words.findall(chunk)
        if len(parts) != 1:
            return b"".join(self.cache(parts))
        data = parts[0].encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return array("I", merge_ids([i for i in ids if i is not None], self.merges)).tobytes()

    def plain(self, text: str) -> Iterable[bytes]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = self.chunks.findall(text) if self.odd_space.search(text) else text.split()
        for i in range(0, len(chunks), BLOCK):
            yield from self.cache(chunks[i : i + BLOCK])

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, special tokens in it included, as little-endian unsigned 32-bit integers."""
        if self.marks is None or not self.marks.search(text):
            return b"".join(self.plain(text))
        parts, at = [], 0
        for m in self.marks.finditer(text):
            parts += self.plain(text[at : m.start()])
            parts.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        return b"".join([*parts, *self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The strings of the ids, special ones included, joined by spaces: the file names no decoder."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: bytes) -> bytes:
        """What ``decode`` gives, in UTF-8."""
        numbers = array("I")
        numbers.frombytes(ids)
        strings = self.strings
        return b" ".join([strings[i] for i in numbers])


_LOADED: dict[int, WordBpe] = {}


def loaded(data: bytes) -> WordBpe:
    """One encoder per vocabulary and worker process, so that its cache serves many tasks."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, digests: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, where asked, decoded, or digests: a row per row of ``docs``.

    ``digests`` gives ids_sha256 and decoded_sha256, of the ids' bytes and of what they decode to in
    UTF-8, instead of the text decoded; they are taken where the ids are, so that the text goes no
    further. Null is the empty text, which has no ids and decodes to ''. Whole texts, whatever their
    length; ids may be null or repeat; other columns play no part. No shuffle. The
    vocabulary's file, of fixed size, is broadcast.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = loaded(data.value)

        def row(key, text):
            ids = bpe.encode(text or "")
            out = key, len(ids) // 4, ids
            if digests:
                yield (*out, sha256(ids).hexdigest(), sha256(bpe.decode_bytes(ids)).hexdigest())
            else:
                yield (*out, bpe.decode(ids)) if decoded else out

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids_sha256 string, decoded_sha256 string" if digests else ", decoded string" if decoded else ""
    return rows_to_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), f"doc_id {kind}, n_tokens bigint, ids binary{more}", make)
