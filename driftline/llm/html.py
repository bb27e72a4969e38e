"""Main text of pages by a linear-chain conditional random field over their leaf blocks.

A block's features are the tags, classes, ids and roles of its ancestors and the form of its text; two
states, main text or not, are chained in page order. The model is trained on labelled
pages by maximum likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.batches import rows_to_rows
from driftline.llm.blocks import Block, leaf_blocks
from driftline.llm.labelled_pages import labelled_pages

#: Labelled pages of the fit, and what the fit runs with.
PAGES, SEED, ROUNDS, RATE, PENALTY = 1000, 11, 100, 0.6, 0.005
#: Words of furniture, in lower case.
CUES = re.compile(
    r"©|\b(copyright|rights reserved|cookies?|privacy|terms|subscribe|newsletter|sign (in|up)|log ?in|share|tweet|follow us|"
    r"comments?|reply|advertisement|sponsored|read more|related|search)\b", re.IGNORECASE
)

DIGIT = re.compile(r"\d")


def features(block: Block, place: int) -> list[str]:
    """Names of what holds for ``block``: ancestors, then text."""
    text = block.text
    words = text.count(" ") + 1
    marks = sum(text.count(c) for c in ".,;:!?")
    near = [f"near{i}={n}" for i, names in enumerate(reversed(block.near)) for n in names]
    return [
        "bias", *block.names, *near, f"tag={block.tag}", f"words={min(8, words.bit_length())}",
        f"links={block.linked * 4 // len(text)}", f"marks={min(4, marks.bit_length())}",
        f"ends={text[-1] in '.!?…:;'}", f"cue={words < 40 and bool(CUES.search(text))}",
        f"first={place == 0}", f"digits={len(DIGIT.findall(text)) * 4 > len(text)}",
    ]


class Crf:
    """Weights of features for main text, and of the four steps between states; state 1 is main text."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray):
        self.weights, self.steps = weights, steps.tolist()

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely states (Viterbi); on a tie, not main text."""
        get, (stay, enter), (leave, keep) = self.weights.get, self.steps[0], self.steps[1]
        back, off, on = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            gain = sum(get(f, 0.0) for f in features(block, i))
            if i:
                a, b, c, d = off + stay, on + leave, off + enter, on + keep
                back.append((b > a, d > c))
                off, on = max(a, b), max(c, d)
            on += gain
        states = []
        if blocks:
            state = on > off
            states.append(state)
            for from_off, from_on in reversed(back):
                state = from_on if state else from_off
                states.append(state)
        return states[::-1]


def train(pages: list[str], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Crf:
    """Fit to pages whose elements carry data-label: gradient ascent on the likelihood, all pages at once.

    Pages are rows of a padded table, so that the forward and backward passes go through it column by column.
    """
    chains = [leaf_blocks(p) for p in pages]
    chains = [c for c in chains if c]
    names: dict[str, int] = {}
    cells, size = [], max(map(len, chains))
    truth, real = np.zeros((len(chains), size), int), np.zeros((len(chains), size), bool)
    for p, chain in enumerate(chains):
        for i, block in enumerate(chain):
            truth[p, i], real[p, i] = block.label == "1", True
            cells.append([names.setdefault(f, len(names)) for f in features(block, i)])
    x = np.zeros((len(cells), len(names)))
    for row, c in enumerate(cells):
        x[row, c] = 1
    weights, steps = np.zeros(len(names)), np.zeros((2, 2))
    squares, step_squares = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    pairs = real[:, 1:]
    seen = np.array([[((truth[:, :-1] == a) & (truth[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for _ in range(rounds):
        score = np.zeros((len(chains), size, 2))
        score[real, 1] = x @ weights
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for i in range(1, size):
            step = np.logaddexp.reduce(forward[:, i - 1, :, None] + steps, axis=1) + score[:, i]
            forward[:, i] = np.where(real[:, i, None], step, forward[:, i - 1])
        for i in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(steps + (score[:, i + 1] + backward[:, i + 1])[:, None, :], axis=2)
            backward[:, i] = np.where(real[:, i + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        on = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[real]
        expected = np.array([[
            np.exp(forward[:, :-1, a] + steps[a, b] + score[:, 1:, b] + backward[:, 1:, b] - total[:, None])[pairs].sum() for b in (0, 1)] for a in (0, 1)
        ])
        change = x.T @ (truth[real] - on) - penalty * weights
        step_change = seen - expected - penalty * steps
        squares += change**2
        step_squares += step_change**2
        weights += rate * change / np.sqrt(squares)
        steps += rate * step_change / np.sqrt(step_squares)
    return Crf({name: float(weights[i]) for name, i in names.items() if abs(weights[i]) > 1e-9}, steps)


@lru_cache(1)
def default_model() -> Crf:
    return train(labelled_pages(PAGES, SEED))


def main_text(page: str, model: Crf) -> str:
    """The main blocks of ``page`` joined by spaces; empty if there are none."""
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, on in zip(blocks, model.decode(blocks), strict=True) if on)


def extract_text(
    pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """page_id, url, text, n_chars (code points): a row per row of ``pages``, from the whole page.

    Null and empty pages, and pages without main text, have the empty text. Ids and addresses may be null or
    repeat; other columns play no part. No shuffle; the model, of the size of its features, is sent with the task.
    """
    crf = model or default_model()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def make():
        return lambda key, url, page: ((key, url, main_text(page or "", crf)),)

    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    rows = rows_to_rows(source, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string", make)
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
