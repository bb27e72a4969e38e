"""Token counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links, each with the number of pieces that are
popped along it, so that one pass over a word's bytes counts its greedy longest-match
pieces without building or revisiting any.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.batches import WordCache, blocks, rows_to_rows

#: Steps (state, byte) that are remembered at most; each is found again from the trie.
MEMO = 1_000_000


class PieceAutomaton:
    """Counts greedy longest-match pieces of words.

    ``first`` may begin a word, ``later`` continue one; by default both are the same. A word
    that cannot be cut into pieces counts as one, as for an unknown-word piece.
    """

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        self.steps: dict[int, int] = {}
        self.ends: list[bool] = []
        self.root = self.node()
        self.add(self.root, first)
        self.again = self.root
        if later is not None:
            self.again = self.node()
            self.add(self.again, later)
        self.link()
        self.memo: dict[int, tuple[int, int] | None] = {}

    def node(self) -> int:
        self.ends.append(False)
        return len(self.ends) - 1

    def add(self, root: int, pieces: Iterable[bytes]) -> None:
        steps = self.steps
        for piece in pieces:
            at = root
            for b in piece:
                key = at << 8 | b
                at = steps.get(key, -1)
                if at < 0:
                    at = steps[key] = self.node()
            if piece:
                self.ends[at] = True

    def link(self) -> None:
        """Failure links and popped counts, nearest to the roots first."""
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.steps.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        self.fail, self.popped = [-1] * len(self.ends), [0] * len(self.ends)
        level = list(dict.fromkeys((self.root, self.again)))
        while level:
            further = []
            for u in level:
                for b, v in below.get(u, ()):
                    further.append(v)
                    if self.ends[v]:
                        self.fail[v], self.popped[v] = self.again, 1
                        continue
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and (z << 8 | b) not in self.steps:
                        z, count = self.fail[z], count + self.popped[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.steps[z << 8 | b], count
            level = further

    def step(self, state: int, byte: int) -> tuple[int, int] | None:
        count = 0
        while (to := self.steps.get(state << 8 | byte, -1)) < 0:
            count += self.popped[state]
            state = self.fail[state]
            if state < 0:
                return None
        return to, count

    def count(self, word: bytes) -> int:
        state, total, memo = self.root, 0, self.memo
        for b in word:
            key = state << 8 | b
            found = memo.get(key, 0)
            if found == 0:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[key] = self.step(state, b)
            if found is None:
                return 1
            state = found[0]
            total += found[1]
        while state not in (self.root, self.again):
            total += self.popped[state]
            state = self.fail[state]
            if state < 0:
                return 1
        return total


def byte_pieces(data: bytes) -> list[bytes]:
    """The pieces of a vocabulary file of base64 strings and ranks."""
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line]


_LOADED: dict[int, WordCache] = {}


def loaded(data: bytes) -> WordCache:
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = WordCache(PieceAutomaton(byte_pieces(data)).count)
    return _LOADED[key]


def count_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces, most_pieces (of one word): a row per row of ``docs``.

    Words are runs of anything but ASCII white space; each is matched with a space before
    it, as the vocabulary writes words, and a space is no piece of its own unless the
    longest match says so. Null and blank texts have no words and count 0. Whole texts, block by block; ids may
    be null or repeat; other columns play no part. No shuffle; the vocabulary's file, of
    fixed size, is broadcast.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counts = loaded(data.value)

        def row(key, text):
            words = pieces = most = 0
            for block in blocks((text or "").encode()):
                # The mark of a word's start is put on here, where the words are told apart.
                got = counts([b" " + w for w in block.split()])
                words += len(got)
                pieces += sum(got)
                most = max(most, max(got, default=0))
            yield key, words, pieces, most

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_pieces bigint, most_pieces bigint"
    return rows_to_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), schema, make)
