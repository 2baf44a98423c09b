"""Slow and plain versions of the operators."""

import hashlib
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"


def lines(docs):
    """docs: (id, text). (id, lines, dropped, text) of each."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = {}
    for n, (i, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append((n, i))
    last = {k: max((-(2**63) if i is None else i) for _, i in h) for k, h in holders.items() if len(h) >= 5}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in last or i is not None and last[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def likeness(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def groups(docs, threshold=0.8, sets=False):
    """id -> (class, group): least ids of equal texts, and of texts linked by all pairs."""
    first, bags = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        first.setdefault(t or "", i)
    reps = sorted(set(first.values()))
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, t)
    for i in reps:
        b = bag(next(t for j, t in docs if j == i and first[t or ""] == i))
        bags[i] = Counter(dict.fromkeys(b, 1)) if sets else b
    up = {i: i for i in reps}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    size = {i: sum(b.values()) for i, b in bags.items()}
    for x in reps:
        for y in reps:
            if x < y and size[x] and min(size[x], size[y]) >= threshold * max(size[x], size[y]) and not bags[x].keys().isdisjoint(bags[y]) and top(x) != top(y) and likeness(bags[x], bags[y]) >= threshold:
                a, b = sorted((top(x), top(y)))
                up[b] = a
    return {i: (first[t or ""], top(first[t or ""])) for i, t in docs}


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
