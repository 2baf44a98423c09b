"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks (runs of text between block-level tags). A linear classifier gives each block a score:
the log odds that it is main text, from the tags and names (class, id, role) around it, its length, end and share of link
text. It is learned, by penalised logistic regression, from the labelled blocks of html_blocks, a bounded set that is part
of this package; names that the set doesn't have weigh nothing. A score above zero is the cost of calling the block
boilerplate, one below zero the cost of calling it content: the capacities of its edges to the two terminals. Neighbouring
blocks, and blocks that follow one another in the same parent, are joined by smoothness edges. The minimum cut labels all
blocks at once. Blocks whose own score outweighs all their edges are settled first, which keeps the optimum; the max-flow
is run on what is left.

Dropped without a look are script, style, template, iframe, textarea and select elements and the like, whose content isn't
text of the page. Character references are decoded in each run of text between tags, so markup never completes one.

Defined cases: null is empty; a page without content blocks gives an empty text; a page may break off anywhere, in a tag or
a comment too, and unclosed elements end with it; where both labellings cost the same, a block is boilerplate; pages of any
length are cut as a whole; equal pages give equal texts; rows without an id stay; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .html_blocks import LABELLED

_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea template iframe select xmp noembed noframes".split())
#: Elements that an opening tag of the key ends, if they are open up to the nearest of the walls.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALLS = frozenset("ul ol menu table dl div article section main aside nav header footer form body html".split())
#: Inline tags, which say nothing about what is in them unless they have names.
_PLAIN = frozenset("a b i u em strong span small big sub sup font code abbr cite q s del ins mark kbd samp var time tt br wbr".split())
_P_ENDS = _BLOCKS - {"button", "label", "option", "optgroup", "legend", "caption"}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_SIMPLE = re.compile(r"\b(?:class|id|role|itemprop|aria-label|hidden|style)\b", re.I)
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_END = re.compile(r"[.!?…。！？:;,»\"”)]$")

#: Strength of the penalty on squared weights, and of the smoothness edges, in log odds.
PENALTY, ROUNDS = 0.02, 30
NEXT, SIBLING = 0.35, 0.6


_Names = frozenset[str]


def around(tag: str, names: Iterable[str], hidden: bool, outer: _Names) -> _Names:
    """The features of what is in an element, given those of what is around it."""
    found = {f"<{tag}>"}
    inside = "<article>" in outer or "<main>" in outer
    if tag in ("header", "footer") and inside:  # an article's own
        found = {f"<{tag}> inside"}
    elif tag == "h1" and "<header> inside" in outer:
        found.add("<h1> of an article")
    if hidden:
        found.add("hidden")
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if words:  # of a compound, the last word says what it is
            found.add(words[-1])
            found.update(f"{w}-" for w in words[:-1])
    if tag in ("article", "main"):  # some servers put whole pages into a form
        outer = outer - {"<form>"}
    return outer | found


def told(words: int, linked: float, ended: bool) -> list[tuple[str, float]]:
    """The features of a block's own text."""
    return [("bias", 1.0), ("linked", linked), ("long", float(words >= 15)), ("short", float(words < 5)), ("ended", float(ended))]


def labelled() -> list[tuple[dict[str, float], int]]:
    """The labelled blocks: features and label."""
    rows = []
    for line in LABELLED.split("\n"):
        if line:
            label, words, linked, ended, *path = line.split()
            hidden = path[-1] == "hidden"
            names: _Names = frozenset()
            for k, x in enumerate(path[: len(path) - hidden]):
                tag, *classes = re.split(r"[.#@]", x)
                names = around(tag, classes, hidden and k == len(path) - 2, names)
            rows.append((dict.fromkeys(names, 1.0) | dict(told(int(words), float(linked), ended == "y")), int(label)))
    return rows


@cache
def weights() -> dict[str, float]:
    """Learned from the labelled blocks, by Newton's method."""
    rows = labelled()
    number = {f: i for i, f in enumerate(sorted({f for x, _ in rows for f in x}))}
    x, y = np.zeros((len(rows), len(number))), np.array([label for _, label in rows], float)
    for r, (own, _) in enumerate(rows):
        for f, v in own.items():
            x[r, number[f]] = v
    w = np.zeros(len(number))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + PENALTY * np.eye(len(w)), x.T @ (y - p) - PENALTY * w)
    return {f: float(w[i]) for f, i in number.items()}


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, score of the ancestors, parent's number, characters of links) of each block that has text."""
    out: list[tuple[str, float, int, int]] = []
    known = weights()
    # open elements: tag, weight of it and all above, number, features
    stack: list[tuple[str, float, int, _Names]] = [("", 0.0, 0, frozenset())]
    parts: list[str] = []
    numbers, linked, in_link = 1, 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                k = len(stack) - 1
                while k and stack[k][0] not in _BLOCKS:
                    k -= 1
                tag, weight, own, _ = stack[k]
                parent = stack[k - 1][2] if k and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") else own
                out.append((text, weight, parent, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal in_link
        for tag, *_ in stack[k:]:
            in_link -= tag == "a"
        del stack[k:]

    match = _TOKEN.search
    while at < n:
        lt = page.find("<", at)
        m = match(page, lt) if lt >= 0 else None
        begin = m.start() if m else n
        if begin > at:
            s = html.unescape(page[at:begin])
            parts.append(s)
            if in_link:
                linked += len(s)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[4] == "" and at == n:  # the page breaks off in this tag
            if tag in _BLOCKS:
                flush()
            break
        if m[1]:
            if tag in _BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in _WALLS and tag not in _BLOCKS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _RAW and not m[3].rstrip().endswith("/"):
            if tag in _BLOCKS:
                flush()
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _P_ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCKS:
                        break
            if tag in _ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _ENDS[tag]:
                        close(k)
                        if tag != "tr":
                            break
                    elif stack[k][0] in _WALLS:
                        break
        if tag in _VOID:
            continue
        outer = stack[-1][3]
        names = outer if tag in _PLAIN and not m[3] else _named(tag, m[3], outer)
        stack.append((tag, stack[-1][1] if names is outer else sum(known.get(f, 0.0) for f in names), numbers, names))
        numbers += 1
        in_link += tag == "a"
    flush()
    return out


def _named(tag: str, attributes: str, outer: _Names) -> _Names:
    names: list[str] = []
    hidden = False
    if attributes and tag not in ("html", "body", "a") and _SIMPLE.search(attributes):
        for key, value in _NAMES.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "style":
                hidden |= key == "hidden" or bool(re.search(r"display\s*:\s*none", value))
            else:
                names += value.split()
    return around(tag, names, hidden, outer)


def scores(found: list[tuple[str, float, int, int]]) -> list[float]:
    known = weights()
    return [weight + sum(known[f] * v for f, v in told(text.count(" ") + 1, min(1.0, linked / len(text)), bool(_END.search(text)))) for text, weight, _, linked in found]


def edges(found: list[tuple[str, float, int, int]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between blocks that follow each other in one parent."""
    out, last = [], {}
    for i, (_, _, parent, _) in enumerate(found):
        before = last.get(parent)
        if i:
            out.append((i - 1, i, NEXT + SIBLING if before == i - 1 else NEXT))
        if before is not None and before != i - 1:
            out.append((before, i, SIBLING))
        last[parent] = i
    return out


def minimum_cut(score: list[float], joins: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling x that has the least sum of |score[i]| where x[i] != (score[i] > 0), plus the weights of edges whose ends differ."""
    n = len(score)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in joins:
        near[i].append((j, w))
        near[j].append((i, w))
    own, around, label = list(score), [sum(w for _, w in x) for x in near], [None] * n
    todo = deque(range(n))
    while todo:  # what outweighs its open edges takes its own side
        i = todo.popleft()
        if label[i] is None and abs(own[i]) >= around[i]:
            label[i] = own[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    around[j] -= w
                    todo.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        content = _flow(open_, own, near, label)
        for i in open_:
            label[i] = i in content
    return label


def _flow(nodes: list[int], own: list[float], near: list[list[tuple[int, float]]], label: list) -> set[int]:
    """The source's side of a minimum cut, by blocking flows over level graphs."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {v: {} for v in (s, t, *nodes)}
    for i in nodes:
        if own[i] > 0:
            cap[s][i], cap[i][s] = own[i], 0.0
        else:
            cap[i][t], cap[t][i] = -own[i], 0.0
        for j, w in near[i]:
            if label[j] is None:
                cap[i][j] = cap[i].get(j, 0.0) + w
    tiny = 1e-9
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for u, c in cap[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if t not in level:
            return {v for v in level if v >= 0}
        rest = {v: list(x) for v, x in cap.items()}
        path = [s]
        while path:
            v = path[-1]
            if v == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                back = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                    if cap[a][b] <= tiny:
                        back = k + 1
                del path[back:]  # on from before the first edge that is full
                continue
            while rest[v]:
                u = rest[v][-1]
                if cap[v].get(u, 0.0) > tiny and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
                rest[v].pop()
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()


def main_text(page: str) -> str:
    found = blocks(page)
    keep = minimum_cut(scores(found), edges(found))
    return "\n".join(text for (text, _, _, _), k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, page: str = "html", by: str = "page_id") -> DataFrame:
    """(by, url, text, n_chars) of every row."""
    kind = pages.schema[by].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in texts_of(batch, "h")]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [by, "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(by).alias("i"), F.col("url").cast("string").alias("u"), F.col(page).alias("h")), each, f"`{by}` {kind}, url string, text string, n_chars long")
