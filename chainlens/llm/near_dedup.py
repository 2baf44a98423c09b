"""Near duplicates by BagMinHash: texts are bags (multisets) of word shingles, likeness is the weighted Jaccard similarity.

Each shingle of weight w is a set of Poisson processes over the discretised weights [0, w): one for each dyadic interval
[0,1), [1,2), [2,4), [4,8), ... whose rate is the interval's length, so heavy shingles cost the logarithm of their weight.
An event of a process has a time, a register and a level in the interval; it counts if its level is under w. The events
depend on shingle and interval alone, so two bags share all events under both weights, and the first event of a register
is the same in both with the probability sum(min) / sum(max): signatures estimate the weighted Jaccard without bias.

Only events up to a time bound are made: with total weight W, the registers are full by about (ln M + c) / W, so most
processes end at their first event's time. If a register stays empty, the bound is doubled for that text.

Texts that share a band of registers are compared by their bags (see linkage). At a likeness of 0.8 a pair shares none of
the BANDS bands with odds of (1 - 0.8 ^ ROWS) ^ BANDS, about 1 in 9,000; its sketches then rule it out with odds of
linkage.ODDS at most. Groups are joined by links, so a document whose link is missed stays with its group by another one.

Defined cases: null is empty; texts without words are like equal texts alone; under five words a text is one shingle; an id
that is null takes no part; rows sharing an id count as one document, that of the text of the least digest; of texts that
tie, the least id stands for the group; an empty table gives no rows; other columns are not read, and clash with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linkage
from .common import dropped, free_name, mix, shingle_hashes, stored

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 30, 6
REGISTERS = BANDS * ROWS
#: Events of a process that signatures() makes at a time, at most.
AT_A_TIME = 32
_ONE = np.uint64(1)


def bags(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and weight of each distinct shingle of each text."""
    found = [np.unique(hashes[lo:hi], return_counts=True) for lo, hi in zip(begin[:-1], begin[1:], strict=True)]
    owner = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
    return owner, np.concatenate([h for h, _ in found] or [hashes]), np.concatenate([w for _, w in found] or [begin[:0]])


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The hash of the first event in each register of each text (0 for a text without shingles)."""
    total = np.bincount(owner, weight, texts)
    best = np.full((texts, REGISTERS), np.inf)
    mark = np.zeros((texts, REGISTERS), np.uint64)
    # the processes: one for each dyadic interval that begins under the weight
    levels = np.frexp(weight.astype(np.float64) - 0.5)[1].clip(0) + 1  # 1: 1, 2: 2, 3 and 4: 3, 5 to 8: 4
    which = np.repeat(np.arange(len(owner)), levels)
    k = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    length = np.where(k == 0, 1, 1 << np.maximum(k - 1, 0))  # intervals [0,1), then [2^(k-1), 2^k)
    low = np.where(k == 0, 0, length)
    seed = mix(shingle[which] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rate, own, most = length * float(REGISTERS), owner[which], weight[which]
    todo = total > 0
    factor = np.full(texts, 1.0)
    while todo.any():
        bound = np.where(todo, factor * (np.log(REGISTERS) + 2.5) / np.maximum(total, 1), 0)[own]
        state, time = seed, np.zeros(len(seed))
        live = np.flatnonzero(bound > 0)
        state, time, step = state[live], time[live], 0
        while len(live):
            # of the few processes with many events, several are made at a time; those after a process's end don't count
            states = np.empty((max(1, min(AT_A_TIME, 8192 // len(live))), len(live)), np.uint64)
            for j in range(len(states)):
                step += 1
                state = states[j] = mix(state + np.uint64(step))
            u = _uniform(states)
            times = np.cumsum(np.vstack((time, -np.log(u) / rate[live])), axis=0)
            room = np.exp(np.minimum(-(bound[live] - times[:-1]) * rate[live], 0))
            on = np.logical_and.accumulate(u > room, axis=0)
            of = live[np.nonzero(on)[1]]
            more = mix(states[on] ^ np.uint64(0xA0761D6478BD642F))
            reg = ((more >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            level = low[of] + ((more & np.uint64(0xFFFFFFFF)) * length[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            hit = np.flatnonzero(level < most[of])
            o, r, t, m = own[of[hit]], reg[hit], times[1:][on][hit], more[hit]
            flat = o * REGISTERS + r
            b, g = best.reshape(-1), mark.reshape(-1)
            np.minimum.at(b, flat, t)
            win = t == b[flat]
            g[flat[win]] = m[win]
            live, state, time = live[on[-1]], state[on[-1]], times[-1][on[-1]]
        empty = np.isinf(best).any(1) & todo
        todo = empty
        factor[empty] *= 2
        best[empty], mark[empty] = np.inf, 0
    return mark


def sketch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, begin = shingle_hashes(texts, WIDTH)
    sig = signatures(*bags(hashes, begin), len(texts))
    return linkage.band_keys(sig, BANDS), (sig & np.uint64(0xFF)).astype(np.uint8), np.diff(begin)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The weighted Jaccard similarity of two bags, given as hashes with repeats."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(1, len(a) + len(b) - both)


def near_groups(docs: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, class_id, group_id) of every row."""
    return linkage.groups(docs, sketch, likeness, threshold, width=WIDTH, text=text, by=by)


def deduplicated(docs: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", by: str = "doc_id") -> DataFrame:
    """docs with one row of each group: that of the least id; rows whose id is null stay."""
    found = stored(near_groups(docs, threshold=threshold, text=text, by=by), "groups")
    gone_id = free_name("gone", docs.columns)
    gone = stored(found.where(F.col(by) != F.col("group_id")).select(F.col(by).alias(gone_id)).distinct(), "gone")
    kept = docs.join(linkage.small(gone, gone.count()), F.col(by).cast("long") == F.col(gone_id), "left_anti")
    twice = stored(found.where(F.col(by) == F.col("group_id")).groupBy(by).count().where("count > 1").select(F.col(by).alias(gone_id)), "twice")
    n = twice.count()
    if n:  # of rows that repeat an id, one with the text of the least digest stays, the same whatever task runs again
        on, few = F.col(by).cast("long") == F.col(gone_id), linkage.small(twice, n)
        order = F.struct(F.md5(F.coalesce(F.col(text), F.lit(""))), F.sha2(F.to_json(F.struct(*docs.columns)), 256))
        one = kept.join(few, on, "left_semi").groupBy(by).agg(F.min_by(F.struct(*docs.columns), order).alias(free_name("row", [by])))
        kept = kept.join(few, on, "left_anti").unionByName(one.select(F.col(one.columns[1] + ".*")))
    dropped(found)
    return kept
