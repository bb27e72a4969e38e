"""Leaf blocks of HTML pages: the text between block-level tags, with what stands around it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Fixed values of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; that of the first kind is not even markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("noscript template select button datalist".split())
#: A start tag closes an open element of the first set unless one of the second is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
PARAGRAPH_STOPS = frozenset("table td th caption".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z].*\Z",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|style|data-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Tags that say what their content is, as classes do.
TELLING = frozenset("article main nav header footer aside form address figure".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """``text`` with single spaces; ``names`` of tags and of classes, ids and roles around it; ``near``, those of
    the two nearest elements that tell; ``tag`` of the block; ``linked`` characters inside links; ``label``
    of the nearest element that has one."""

    text: str
    names: frozenset[str]
    near: tuple[tuple[str, ...], ...]
    tag: str
    linked: int
    label: str


def attribute_names(attributes: str) -> tuple[list[str], str | None, bool]:
    names, label, hidden = [], None, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "data-label":
            label = value
        elif key == "hidden" or key == "style":
            hidden |= key == "hidden" or "display:none" in value.replace(" ", "").lower()
        else:
            names += ["." + w.lower() for w in NAME.findall(value)]
    return names, label, hidden


def leaf_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order. Time is linear in the page but for pathological nesting."""
    blocks: list[Block] = []
    stack: list[tuple[str, list[str], str | None, bool]] = []
    open_tags, around = Counter(), Counter()
    labels, telling = [""], []
    unseen, pieces, linked, tag = 0, [], 0, "body"

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, frozenset(around), tuple(telling[-2:]), tag, min(linked, len(text)), labels[-1]))
            pieces, linked = [], 0

    def pop():
        nonlocal unseen
        name, names, label, hidden = stack.pop()
        open_tags[name] -= 1
        for n in names:
            around[n] -= 1
            if not around[n]:
                del around[n]
        if label is not None:
            labels.pop()
        if len(names) > 1 or name in TELLING:
            telling.pop()
        unseen -= hidden

    def close(names, stops) -> None:
        """Pop up to the nearest open one of ``names``, unless one of ``stops`` is nearer."""
        if not any(open_tags[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in stops:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at and not unseen:
            text = html.unescape(page[at:start])
            pieces.append(text)
            if open_tags["a"]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
            tag = name if not closing else "/"
        if closing:
            if open_tags[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = ends.end() if ends else end
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        elif name in BLOCK:
            close({"p"}, PARAGRAPH_STOPS)
        names, label, hidden = attribute_names(m[3]) if m[3] else ([], None, False)
        names.append(name)
        hidden |= name in HIDDEN
        stack.append((name, names, label, hidden))
        open_tags[name] += 1
        around.update(names)
        if label is not None:
            labels.append(label)
        if len(names) > 1 or name in TELLING:
            telling.append(tuple(names if name in TELLING else names[:-1]))
        unseen += hidden
    flush()
    return blocks
