"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so the tokens' labels are derived first, from a bounded sample of labelled rows: a word or a
word's beginning is marked if it occurs in so many of the toxic documents, and so few others, that chance can't explain it
(binomial tail, times the number of candidates); then again among the toxic documents that no mark explains yet. What a
text has twice or three times within REGION tokens is a candidate of its own, as a beginning may be chance once, and not when
repeated; regions are the same in learning and scoring, so that a long text has no more repeats than a short one. A token
is labelled toxic if it is in a toxic document and has a mark. A CRF of two states (toxic, other) with the marks as
features and learned transitions is fitted to windows of the sample by gradient ascent of the conditional likelihood.

Forward-backward gives each token's marginal. A document's score is its tokens' largest marginal, over all of the text; the
offending offsets are the runs of tokens whose marginal is 0.5 or more.

Bounds on what is learned from, at every size of the input: SAMPLE labelled documents by label (least hashes), CHARS code
points of each, WINDOWS windows of WINDOW tokens. Defined cases: null is empty; a text without words gets the chain's
start marginal; without labelled toxic documents all scores are low; rows of equal text score alike; a document whose
labels differ counts as toxic; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

SAMPLE, CHARS, WINDOWS, WINDOW, STEPS, PREFIXES, REPEATS, REGION, CHANCE = {1: 1_200, 0: 3_600}, 6_000, 2_400, 48, 60, (4, 5, 6, 7), (2, 3), 1_000, 1e-3
_TOKEN = re.compile(r"\w+")


def features(token: str) -> list[str]:
    w = token.lower()
    return [f"{w}=", *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k)]


def counted(found: Mapping[str, int]) -> Iterator[str]:
    """The candidates of a text whose features occur so often: each once, and again as repeated."""
    for f, n in found.items():
        yield f
        for k in REPEATS:
            if n >= k:
                yield f"{f}{k}"


def candidates(tokens: list[str]) -> set[str]:
    out: set[str] = set()
    for at in range(0, len(tokens), REGION):
        found: dict[str, int] = defaultdict(int)
        for t, n in Counter(tokens[at : at + REGION]).items():
            for f in features(t):
                found[f] += n
        out.update(counted(found))
    return out


def _tail(k: int, n: int, p: float) -> float:
    """log P(X >= k) for X of n trials of chance p, by its first and largest terms."""
    term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return min(0.0, term - log(1 - ratio) if ratio < 0.999 else 0.0)


def mine(toxic: Iterable[set[str]], clean: Iterable[set[str]]) -> list[str]:
    """The marks: features of documents (as sets) that chance can't have put into the toxic ones alone.

    Of the clean documents only counts are kept, and of the toxic ones the features that three have at least.
    """
    found = [frozenset(map(sys.intern, d)) for d in toxic]
    df = Counter(f for d in found for f in d)
    df = {f: n for f, n in df.items() if n >= 3}
    found = [d & df.keys() for d in found]
    other: Counter[str] = Counter()
    n_clean = 0
    for d in clean:
        n_clean += 1
        other.update(d & df.keys())
    if not found or not n_clean:
        return []
    limit = log(CHANCE / max(1, len(df)))
    fit = {f for f, n in df.items() if n >= 0.85 * (n + other[f])}
    posts = defaultdict(set)
    for i, d in enumerate(found):
        for f in d & fit:
            posts[f].add(i)
    rate = len(found) / (len(found) + n_clean)
    marks = {f for f in fit if df[f] >= 0.95 * (df[f] + other[f]) and _tail(df[f], df[f] + other[f], rate) < 2 * limit}
    explained = set().union(*(posts[f] for f in marks)) if marks else set()
    while len(explained) < len(found):
        open_ = len(found) - len(explained)
        p = open_ / (open_ + n_clean)
        best = min(((_tail(k, k + other[f], p), f) for f in fit - marks if (k := len(posts[f] - explained)) >= 3), default=(0.0, ""))
        if best[0] >= limit:
            break
        marks.add(best[1])
        explained |= posts[best[1]]
    # of a word and its beginnings that are found in nearly the same documents, the longest says most
    longest: set[str] = set()
    for f in sorted(marks, key=lambda f: (-len(_stem(f)), f)):
        if not any(len(posts[g]) >= 0.9 * len(posts[f]) for g in longest if _stem(g).startswith(_stem(f)) and _stem(g) != _stem(f)):
            longest.add(f)
    return sorted(longest)


def _stem(mark: str) -> str:
    return mark.rstrip("23").rstrip("*=")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    start: float
    trans: tuple[float, float, float, float]  # potentials other-other, other-toxic, toxic-other, toxic-toxic


def _chain(g: np.ndarray, trans: tuple[float, float, float, float], start: float) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the forward and the backward messages; g (steps x chains) are the odds of the tokens' own potentials."""
    oo, ot, to, tt = trans
    f, b = np.empty_like(g), np.empty_like(g)
    f[0] = g[0] * start
    for t in range(1, len(g)):
        f[t] = g[t] * (ot + f[t - 1] * tt) / (oo + f[t - 1] * to)
    b[-1] = 1.0
    for t in range(len(g) - 2, -1, -1):
        x = g[t + 1] * b[t + 1]
        b[t] = (to + x * tt) / (oo + x * ot)
    return f, b


def fit(windows: list[list[tuple[list[str], int]]], marks: list[str]) -> Model:
    """Each window is a list of (marks of the token, its label)."""
    number = {f: i for i, f in enumerate(marks)}
    n = len(windows)
    w, bias, start, trans = np.zeros(len(marks)), -4.0, -4.0, np.array([0.0, -2.0, 0.0, 0.0])
    if n and marks:
        size = max(map(len, windows))
        label, real = np.zeros((size, n)), np.zeros((size, n), bool)
        rows, cols, which = [], [], []
        for j, win in enumerate(windows):
            for i, (own, y) in enumerate(win):
                label[i, j], real[i, j] = y, True
                for f in own:
                    rows.append(i)
                    cols.append(j)
                    which.append(number[f])
        rows, cols, which = (np.array(x, np.int64) for x in (rows, cols, which))
        both = real[1:] & real[:-1]
        seen = np.array([(both & (label[:-1] == a) & (label[1:] == c)).sum() for a, c in ((0, 0), (0, 1), (1, 0), (1, 1))], float)
        count = np.bincount(which, minlength=len(marks)).clip(1)
        m = v = np.zeros(len(marks) + 6)
        for step in range(1, STEPS + 1):
            theta = np.full((size, n), bias)
            np.add.at(theta, (rows, cols), w[which])
            g = np.exp(np.clip(theta, -30, 30))
            g[~real] = 1e-12
            tr = tuple(np.exp(trans))
            f, b = _chain(g, tr, exp(start))
            p = np.where(real, f * b / (1 + f * b), 0)
            # pairwise marginals
            fo = 1 / (1 + f[:-1])
            ft = 1 - fo
            x = g[1:] * b[1:]
            joint = np.stack([fo * tr[0], fo * tr[1] * x, ft * tr[2], ft * tr[3] * x])
            joint = np.where(both, joint / joint.sum(0), 0).sum((1, 2))
            err = label * real - p
            grad = np.concatenate((np.bincount(which, err[rows, cols], len(marks)) / count - 0.01 * w, [err.sum() / max(1, label.sum()), err[0].mean() * 10], (seen - joint) / max(1.0, min(seen.sum(), 4 * label.sum() + 1))))
            m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
            move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
            w, bias, start, trans = w + move[:-6], bias + move[-6], start + move[-5], trans + move[-4:]
    return Model({f: float(w[i]) for f, i in number.items()}, float(bias), float(start), tuple(float(x) for x in np.exp(trans - trans[0])))


def train(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, 1 if toxic). Tokens are made anew in each pass, and never held for all rows."""
    tokens = lambda text: _TOKEN.findall(text[:CHARS])
    sets = lambda label: (candidates(tokens(text)) for text, y in rows if y == label)
    marks = mine(sets(1), sets(0))
    own = _Marks(marks)
    hit, plain = [], []
    for k, (text, _) in enumerate(rows):
        marked = [bool(x) for x in own.of(tokens(text))]
        for at in range(0, len(marked), WINDOW):
            (hit if any(marked[at : at + WINDOW]) else plain).append((k, at))
    windows = []
    for found in (hit, plain):
        chosen = defaultdict(list)
        for k, at in found[:: max(1, -(-len(found) // (WINDOWS // 2)))]:
            chosen[k].append(at)
        for k, begins in chosen.items():
            found_marks, y = own.of(tokens(rows[k][0])), rows[k][1]
            windows += [[(x, int(bool(x) and y)) for x in found_marks[at : at + WINDOW]] for at in begins]
    return fit(windows, marks)


class _Marks(dict):
    """The features of a token that marks are made of; a bounded cache."""

    MOST = 100_000

    def __init__(self, marks: Iterable[str]):
        super().__init__()
        self.marks = frozenset(marks)
        self.roots = frozenset(m.rstrip("23") for m in marks)

    def __missing__(self, token: str) -> tuple[str, ...]:
        own = tuple(f for f in features(token) if f in self.roots)
        if len(self) >= self.MOST:
            self.clear()
        if len(token) <= 64:
            self[token] = own
        return own

    def of(self, tokens: list[str]) -> list[list[str]]:
        """The marks of each token of a text."""
        roots = list(map(self.__getitem__, tokens))
        if not any(roots):
            return [[]] * len(tokens)
        out: list[list[str]] = []
        for at in range(0, len(roots), REGION):
            region = roots[at : at + REGION]
            found = Counter(f for own in region for f in own)
            marks = {f: [m for m in counted({f: n}) if m in self.marks] for f, n in found.items()}
            out += [[m for f in own for m in marks[f]] for own in region]
        return out


class Tagger:
    """Marginals of texts' tokens, as odds."""

    def __init__(self, model: Model):
        self.m, self.plain, self.marks = model, exp(max(-30.0, model.bias)), _Marks(model.weights)
        n = 80
        f, b = _chain(np.full((n, 1), self.plain), model.trans, exp(model.start))
        # the largest odds in a text of n tokens without marks; from 80 tokens on it doesn't change
        self.of_plain = [exp(model.start) * self.plain]
        for k in range(1, n + 1):
            self.of_plain.append(float((f[:k, 0] * b[n - k :, 0]).max()))

    def potentials(self, tokens: list[str]) -> np.ndarray | None:
        """The odds of the tokens' own potentials; None if none has a mark."""
        own = self.marks.of(tokens)
        if not any(own):
            return None
        return np.array([exp(min(30.0, max(-30.0, self.m.bias + sum(map(self.m.weights.__getitem__, x))))) if x else self.plain for x in own])

    def odds(self, texts: list[str]) -> list[np.ndarray | float]:
        """Of each text the odds of each token, or their maximum if no token has a mark."""
        plain = self.plain
        out: list = [0.0] * len(texts)
        own: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            tokens = _TOKEN.findall(t)
            g = self.potentials(tokens)
            if g is None:
                out[i] = self.of_plain[min(len(tokens), len(self.of_plain) - 1)]
            else:
                own.append((i, g))
        # texts of like length run in step; a padding token is one without weight on either side
        own.sort(key=lambda x: len(x[1]))
        lo = 0
        while lo < len(own):
            hi = lo
            while hi < len(own) and len(own[hi][1]) <= 1.3 * len(own[lo][1]) + 16:
                hi += 1
            group = own[lo:hi]
            size = len(group[-1][1])
            g = np.full((size, len(group)), plain)
            for j, (_, x) in enumerate(group):
                g[: len(x), j] = x
            f, b = self._run(g, np.array([len(x) for _, x in group]))
            for j, (i, x) in enumerate(group):
                out[i] = f[: len(x), j] * b[: len(x), j]
            lo = hi
        return out

    def _run(self, g: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        oo, ot, to, tt = self.m.trans
        f, b = np.empty_like(g), np.ones_like(g)
        f[0] = g[0] * exp(self.m.start)
        for t in range(1, len(g)):
            f[t] = g[t] * (ot + f[t - 1] * tt) / (oo + f[t - 1] * to)
        for t in range(len(g) - 2, -1, -1):
            x = g[t + 1] * b[t + 1]
            b[t] = np.where(t + 1 < lengths, (to + x * tt) / (oo + x * ot), 1.0)
        return f, b

    def score(self, texts: list[str]) -> list[float]:
        tops = (float(o.max()) if isinstance(o, np.ndarray) else o for o in self.odds(texts))
        return [o / (1 + o) for o in tops]

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(begin, end, largest marginal) in code points, of the runs of toxic tokens."""
        o = self.odds([text])[0]
        if not isinstance(o, np.ndarray):
            return []
        p, out, last = o / (1 + o), [], -2
        for k, m in enumerate(_TOKEN.finditer(text)):
            if p[k] >= 0.5:
                if last == k - 1:
                    out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[k])))
                else:
                    out.append((*m.span(), float(p[k])))
                last = k
        return out


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", by: str = "doc_id") -> Model:
    """Fits a model to the rows of docs that labels has, within the bounds of this module."""
    y = labels.where(F.col(label).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).alias("i")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked: dict[int, int] = {}
    for value, n in SAMPLE.items():
        for r in y.where(F.col("y") == value).orderBy(F.xxhash64("i"), "i").limit(n).collect():
            picked[r["i"]] = value
    if not picked:
        return fit([], [])
    rows = docs.where(F.col(by).isin(list(picked))).select(F.col(by).alias("i"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, CHARS).alias("t")).distinct().collect()
    return train(sorted(((r["t"], picked[r["i"]]) for r in rows), key=lambda x: (x[1], x[0])))


def scored(docs: DataFrame, model: Model, *, text: str = "text", by: str = "doc_id", spans: bool = False) -> DataFrame:
    """(by, score, predicted) of every row, with spans also the offending (begin, end, marginal)."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[by].dataType.simpleString()
    made: list[Tagger] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Tagger(shared.value))
        texts = texts_of(batch, "t")
        s = made[0].score(texts)
        cols, names = [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [by, "score", "predicted"]
        if spans:
            found = [[{"begin": a, "end": b, "marginal": p} for a, b, p in made[0].spans(t)] if x >= 0.5 else [] for t, x in zip(texts, s, strict=True)]
            cols.append(pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))))
            names.append("spans")
        return pa.RecordBatch.from_arrays(cols, names)

    return map_batches(docs.select(F.col(by).alias("i"), F.col(text).alias("t")), each, f"`{by}` {kind}, score double, predicted int" + ", spans array<struct<begin: long, end: long, marginal: double>>" * spans)


def without_toxic(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay, and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Tagger] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Tagger(shared.value))
        return batch.filter(pa.array([x < 0.5 for x in made[0].score(texts_of(batch, text))], pa.bool_()))

    return map_batches(docs, each, docs.schema)
