"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of its labelled text accepts all substrings of that sample.
A text is parsed greedily into longest matches against each automaton; a letter that the sample lacks is a phrase by
itself. The language that needs the fewest phrases, each weighted by the bits that point into its sample (log2 of the
sample's length; a letter that the sample lacks by LITERAL bits), wins. Each language has its own alphabet, of all letters
of its sample; what is no letter is one symbol.

The parse runs in lockstep, yet is exactly the sequential one: texts are cut into blocks of BLOCK code points, and one numpy
step moves all blocks of a batch one code point on, as if a phrase began with each block. Then the parse that is open at a
block's end goes on into the next ones until it begins a phrase where the block there began one too; from there on both
are the same, so counts before that place are replaced. Whole texts count.

Bounds on what is learned from, at every size of the input: SLOTS documents a language (of each of SLOTS slots the row of the
least hash; with over SAMPLED / SLOTS languages fewer slots), CHARS code points a language, dealt evenly to its documents,
each giving one window at a hashed place. SYMBOLS bounds the code points of all languages: with over SYMBOLS / CHARS of them,
each sample is shorter. Any number of languages is learned.

Defined cases: a text that is null or has no letter (str.isalpha) is `und` with score 0, as is every text if nothing is
labelled; ties go to the language that sorts first; repeated rows are predicted alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, stored, texts_of

SLOTS, SAMPLED, CHARS, SYMBOLS, BLOCK = 128, 128_000, 24_000, 8_000_000, 256
#: Cells of all plain tables; languages beyond them, or whose alphabets are wide, have packed ones, which are slower, but give the same.
CELLS = 16_000_000
#: Codes of letters that no sample has, of everything that is no letter, and of the padding after a text.
UNSEEN, GAP, PAD = 0, 1, 2
#: Bits of a letter that a sample lacks, which no pointer can say: those of any code point.
LITERAL = 21
#: The state before a phrase; it has no transitions.
START = 0
_LOW, _MISS = np.int64((1 << 32) - 1), 29


def lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence; state 0 is the root."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


def packed(trans: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The automaton in one array: a state's number is an offset, at which, plus a code, lies (state << 32 | next state).

    The root's transitions are apart, by code: the states after the first symbol of a phrase, START if there is none.
    """
    room = max(1024, 3 * sum(map(len, trans[1:])))
    used, taken, at = set(), {START}, np.zeros(len(trans), np.int64)
    seed = 1
    for s in sorted(range(1, len(trans)), key=lambda s: -len(trans[s])):
        own = trans[s]
        while True:  # places are drawn by a generator, so that equal samples give equal tables
            seed = (seed * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
            base = 1 + (seed >> 33) % room
            if base not in taken and not any(base + c in used for c in own):
                break
        taken.add(base)
        used.update(base + c for c in own)
        at[s] = base
    table = np.full(room + width + 1, -1, np.int64)
    for s in range(1, len(trans)):
        for c, q in trans[s].items():
            table[at[s] + c] = at[s] << 32 | at[q]
    root = np.zeros(width, np.int64)
    for c, q in trans[0].items():
        root[c] = at[q]
    return table, root


def plain(trans: list[dict[int, int]], width: int) -> np.ndarray:
    """The automaton with all transitions: at state + code, the next state, plus 1 << _MISS if that begins a phrase. States are multiples of width."""
    first = np.full(width, 1 << _MISS, np.int32)
    for c, q in trans[0].items():
        first[c] |= q * width
    table = np.tile(first, len(trans))
    at = [s * width + c for s, nexts in enumerate(trans) if s for c in nexts]
    table[at] = [q * width for s, nexts in enumerate(trans) if s for q in nexts.values()]
    return table


@dataclass
class Model:
    langs: list[str]
    letters: np.ndarray  # code points of all samples, in order
    bits: np.ndarray  # of a pointer into each language's sample
    local: list[np.ndarray]  # code (as of letters) -> the language's own code
    tables: list[np.ndarray]
    roots: list[np.ndarray | None]  # of packed tables


def train(samples: dict[str, str]) -> Model:
    """samples: text by language."""
    most = min(CHARS, max(1, SYMBOLS // max(1, len(samples))))
    low = {k: v.lower()[:most] for k, v in sorted(samples.items()) if lettered(v)}
    own = {k: sorted({c for c in v if c.isalpha()}) for k, v in low.items()}
    letters = np.array(sorted({ord(c) for v in own.values() for c in v}), np.int64)
    local, tables, roots, cells = [], [], [], 0
    for k, text in low.items():
        code = {c: i + 3 for i, c in enumerate(own[k])}
        trans, width = automaton([code.get(c, GAP) for c in text]), len(code) + 3
        if cells + len(trans) * width <= CELLS:
            cells += len(trans) * width
            table, root = plain(trans, width), None
        else:
            table, root = packed(trans, width)
        lut = np.zeros(len(letters) + 3, np.int32)
        lut[GAP], lut[PAD] = GAP, PAD
        lut[np.searchsorted(letters, [ord(c) for c in own[k]]) + 3] = np.arange(len(code)) + 3
        local.append(lut)
        tables.append(table)
        roots.append(root)
    return Model(list(low), letters, np.log2([max(2, len(v)) for v in low.values()]), local, tables, roots)


class Parser:
    def __init__(self, model: Model):
        self.model = model
        self.lut = np.full(0x110000, GAP, np.int32)
        self.lut[[i for i in range(0x110000) if chr(i).isalpha()]] = UNSEEN
        self.lut[model.letters] = np.arange(len(model.letters)) + 3

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and how many of them are letters that the language's sample lacks."""
        m = self.model
        low = [t.lower() for t in texts]
        n = np.array([len(t) for t in low], np.int64)
        codes = self.lut[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
        blocks = -(-n // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))
        grid = np.full(int(first[-1]) * BLOCK, PAD, np.int32)
        grid[np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1] * BLOCK, n)] = codes
        grid = grid.reshape(-1, BLOCK)
        last = np.zeros(len(grid), bool)
        last[first[1:][blocks > 0] - 1] = True
        out, lacked, ends = np.zeros((len(texts), len(m.langs)), np.int64), np.zeros((len(texts), len(m.langs)), np.int64), np.cumsum(n)
        for k in range(len(m.langs)):
            lack = np.concatenate(([0], np.cumsum(m.local[k][codes] == UNSEEN)))
            lacked[:, k] = lack[ends] - lack[ends - n]
            counts, joins = self._parsed(m.local[k][grid], last, m.tables[k], m.roots[k])
            total = np.concatenate(([0], np.cumsum(counts)))
            out[:, k] = total[first[1:]] - total[first[:-1]]
            # parses that stayed apart for more than a block: these texts' blocks are followed one by one
            for t in np.unique(np.searchsorted(first, joins, side="right") - 1) if len(joins) else ():
                out[t, k] = _sequential(m.local[k][grid[first[t] : first[t + 1]].ravel()], m.tables[k], m.roots[k])
        return out, lacked

    def _parsed(self, grid: np.ndarray, last: np.ndarray, table: np.ndarray, root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, given the blocks before; and the blocks for which this wasn't found."""
        n = len(grid)
        begins = np.zeros((BLOCK, n), bool)
        kind = np.int32 if root is None else np.int64
        ends = np.empty(n, kind)
        for lo in range(0, n, 4096):
            state = np.full(min(4096, n - lo), START, kind)
            for j, row in enumerate(np.ascontiguousarray(grid[lo : lo + 4096].T)):
                state = _step(state, row, table, root, begins[j, lo : lo + 4096])
            ends[lo : lo + 4096] = state
        begins &= (grid != PAD).T
        counts = begins.sum(0)
        # the open parse of each block but a text's last goes on into the next block
        into = np.flatnonzero(~last) + 1
        state, begun, passed = ends[into - 1], np.zeros(len(into), np.int64), np.zeros(len(into), np.int64)
        for j in range(BLOCK):
            if not len(into):
                break
            hit = np.zeros(len(into), bool)
            state = _step(state, grid[into, j], table, root, hit)
            real = grid[into, j] != PAD
            own = begins[j, into]
            met = hit & own
            done = met | ~real
            # at the meeting place the block's own phrases go on; before it, those begun here count instead
            counts[into[done]] += begun[done] - passed[done]
            begun += hit & real
            passed += own
            keep = ~done
            into, state, begun, passed = into[keep], state[keep], begun[keep], passed[keep]
        return counts, into

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        m = self.model
        if not m.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        count, lacked = self.phrases(texts)
        cost = count * m.bits + lacked * np.maximum(0, LITERAL - m.bits)
        best = cost.argmin(1)
        odds = np.exp2(-np.minimum(60.0, (cost - cost.min(1, keepdims=True)) / 8)).sum(1)
        known = [lettered(t) for t in texts]
        return [m.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(1 / o) if k else 0.0 for o, k in zip(odds, known, strict=True)]


def _step(state: np.ndarray, codes: np.ndarray, table: np.ndarray, root: np.ndarray | None, begins: np.ndarray) -> np.ndarray:
    """The states after codes; begins is set where that was a new phrase."""
    found = table.take(state + codes)
    if root is None:
        np.greater_equal(found, 1 << _MISS, out=begins)
        found &= (1 << _MISS) - 1
        return found
    np.not_equal(found >> 32, state, out=begins)
    return np.where(begins, root.take(codes), found & _LOW)


def _sequential(codes: np.ndarray, table: np.ndarray, root: np.ndarray | None) -> int:
    state, n, codes = START, 0, codes[codes != PAD].tolist()
    if root is None:
        for c in codes:
            state = table.item(state + c)
            if state >> _MISS:
                n, state = n + 1, state & (1 << _MISS) - 1
        return n
    for c in codes:
        v = table.item(state + c)
        if v >> 32 == state:
            state = v & 0xFFFFFFFF
        else:
            n, state = n + 1, root.item(c)
    return n


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", by: str = "doc_id") -> Model:
    """Learns from the labelled rows of docs, within the bounds of this module."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(by))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), h.alias("h"), F.col(text).alias("t")).where(F.length("t") > 0)
    least = stored(known.groupBy("l", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(SLOTS)).alias("s")).agg(F.min("h").alias("h")), "slots")
    langs = least.select("l").distinct().count()
    slots = max(1, min(SLOTS, SAMPLED // max(1, langs)))
    picked = least.groupBy("l", F.pmod("s", F.lit(slots))).agg(F.min("h").alias("h")).select("l", "h").collect()  # SAMPLED rows, or one a language
    dropped(least)
    if not picked:
        return train({})
    most = max(1, min(CHARS, SYMBOLS // langs))
    held: dict[str, int] = {}
    for r in picked:
        held[r["l"]] = held.get(r["l"], 0) + 1
    # up to four even shares of each, as some are shorter than theirs
    plan = spark.createDataFrame([(r["l"], r["h"], 4 * -(-most // held[r["l"]])) for r in picked], "l string, h long, w int")
    begin = F.pmod(F.xxhash64("h", F.lit(13)), F.greatest(F.lit(1), F.length("t") - F.col("w") + 1)).cast("int") + 1
    rows = known.join(F.broadcast(plan), ["l", "h"]).select("l", "h", F.substring(F.col("t"), begin, F.col("w")).alias("t")).distinct().collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["h"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"])
    return train({k: "\n".join(shares(v, most)) for k, v in samples.items()})


def shares(texts: list[str], most: int) -> list[str]:
    """The texts' beginnings, as equal in length as they can be with most code points in all, and a separator each."""
    left, out = most, {}
    for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: max(0, left // (len(texts) - n) - 1)]
        left -= len(out[i]) + 1
    return [out[i] for i in range(len(texts))]


def identify(docs: DataFrame, model: Model, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, lang_pred, score) of every row of docs."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[by].dataType.simpleString()
    parser: list[Parser] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not parser:
            parser.append(Parser(shared.value))
        langs, scores = parser[0].predict(texts_of(batch, "t"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [by, "lang_pred", "score"])

    return map_batches(docs.select(F.col(by).alias("i"), F.col(text).alias("t")), each, f"`{by}` {kind}, lang_pred string, score double")
