"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes, exactly one token can come last if the prefix is encoded as BPE encodes it; it is
the token whose encoding pairs validly with the last token of the prefix before it. So `last[i]` is stored for each
prefix, the encoding is read off from the end, bytes may be appended without touching what is stored, and after an edit
only prefixes from the edit on are computed again, until the stored ones repeat.

Pieces (matches of the split pattern) are encoded one by one and kept in a cache of bounded size. Ranks come from a
vocabulary file whose path is a parameter; nothing is trained. No special tokens.

Defined cases: null is empty; an empty text has no ids; a vocabulary that lacks a single byte raises if that byte
occurs; repeated rows and ties need no rule, as each text is encoded on its own; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cached_property
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, texts_of


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @cached_property
    def tails(self) -> set[bytes]:
        """The ends of all tokens, to stop the search for last tokens early."""
        return {b[j:] for b in self.ranks for j in range(len(b))}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte, or a token that merges never reach."""
        if token not in self._halves:
            b = self.bytes_of[token]
            found = None
            if len(b) > 1:
                parts = self.merged(b, self.ranks[b])
                found = tuple(parts) if len(parts) == 2 else None
            self._halves[token] = found
        return self._halves[token]

    def merged(self, b: bytes, below: int | None = None) -> list[int]:
        """BPE as defined: merge the pair of the lowest rank, leftmost first, while there is one (of a rank under below)."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens apart where they meet: no merge across the border comes before their own merges."""
        bytes_of, ranks, limit = self.bytes_of, self.ranks, 1 << 60
        a, b = left, right
        while True:
            r = ranks.get(bytes_of[a] + bytes_of[b])
            if r is not None and r < limit:
                # the merge across the border would have come first, unless one of the two was made earlier
                return False
            if a > b:
                limit = a
                if (h := self.halves(a)) is None:
                    limit = b + 1
                    if (h := self.halves(b)) is None:
                        return True
                    b = h[0]
                else:
                    a = h[1]
            else:
                limit = b + 1
                if (h := self.halves(b)) is None:
                    limit = a
                    if (h := self.halves(a)) is None:
                        return True
                    a = h[1]
                else:
                    b = h[0]


class Prefixes:
    """The last tokens of all prefixes of a piece; grows at its end, and is mended after an edit."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self._from(len(self.last))

    def _token_at(self, end: int) -> int:
        """The only valid last token of piece[:end]."""
        v, piece, last = self.v, self.piece, self.last
        ranks, tails = v.ranks, v.tails
        begin = end - 1
        while begin >= 0 and (part := piece[begin:end]) in tails:
            token = ranks.get(part)
            if token is not None and (len(part) == 1 or v.halves(token) is not None) and (begin == 0 or v.fits(last[begin - 1], token)):
                return token
            begin -= 1
        raise ValueError(f"the vocabulary has no token for byte {piece[end - 1]}")

    def _from(self, at: int) -> None:
        for end in range(at + 1, len(self.piece) + 1):
            self.last.append(self._token_at(end))

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replaces piece[begin:end]; returns how many prefixes were computed again."""
        old_last, old_len = self.last, len(self.piece)
        self.piece = self.piece[:begin] + new + self.piece[end:]
        self.last = old_last[:begin]
        shift, same, longest = len(self.piece) - old_len, 0, max(map(len, self.v.ranks), default=1)
        for stop in range(begin + 1, len(self.piece) + 1):
            if same >= longest:  # a token's reach of unchanged answers over unchanged bytes: the rest repeats too
                self.last.extend(old_last[stop - 1 - shift :])
                return stop - 1 - begin
            token = self._token_at(stop)
            same = same + 1 if stop > begin + len(new) and old_last[stop - 1 - shift] == token and stop - len(self.v.bytes_of[token]) >= begin + len(new) else 0
            self.last.append(token)
        return len(self.piece) - begin

    def ids(self) -> tuple[int, ...]:
        out, at, size = [], len(self.piece), self.v.bytes_of
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(size[token])
        return tuple(reversed(out))


#: Code points of which Python's re and the split pattern's classes think alike: for texts of these alone, re splits, which is faster.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00c0-\\u024f\\u0391-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5]")


class Encoder(dict):
    """ids by piece; a bounded cache over the prefix computation, which finds the tokens that end at each byte by automaton."""

    MOST, LONG = 350_000, 48

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.v, self.split = vocabulary, regex.compile(pattern).findall
        self.fast = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")).findall
        if r"\p{" in pattern.replace(r"[^\s\p{L}\p{N}]", "").replace(r"\p{L}", "").replace(r"\p{N}", ""):
            self.fast = self.split
        self.names = {i: str(i) for i in vocabulary.bytes_of}
        self.pairs: dict[int, bool] = {}
        ends = ahocorasick.Automaton()
        for b, i in vocabulary.ranks.items():
            if len(b) == 1 or vocabulary.halves(i) is not None:  # others can't come out of merges
                ends.add_word(b.decode("latin-1"), (i, len(b)))
        ends.make_automaton()
        self.ends = ends.iter

    def _ids(self, b: bytes) -> tuple[int, ...]:
        """As Prefixes(b).ids(): last holds each prefix's only valid last token."""
        last, sizes, done = [-1] * len(b), [0] * len(b), -1
        pairs = self.pairs
        for end, (token, size) in self.ends(b.decode("latin-1")):
            if end == done:
                continue
            before = end - size
            if before >= 0:
                key = last[before] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > 400_000:
                        pairs.clear()
                    ok = pairs[key] = last[before] >= 0 and self.v.fits(last[before], token)
                if not ok:
                    continue
            last[end], sizes[end], done = token, size, end
        if done != len(b) - 1 or -1 in last:
            raise ValueError("the vocabulary lacks a byte of the text")
        out, at = [], len(b) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        return tuple(out)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        b = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ranks.get(b)
        ids = (whole,) if whole is not None else self._ids(b)
        if len(piece) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        split = self.split if _PLAIN.search(text) else self.fast
        return list(chain.from_iterable(map(self.__getitem__, split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


#: Bytes of texts (or ids) that are taken at a time.
TAKEN = 1 << 20
_ENCODERS: dict[tuple[str, str], Encoder] = {}
kept("bpe", _ENCODERS.clear)


def encoder(path: str, pattern: str) -> Encoder:
    """One for each process, until it does another operator's work; the vocabulary file is installed on every executor."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(Vocabulary.read(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, ids array<int>) of every row."""
    kind = docs.schema[by].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.encode(t) for t in texts_of(batch, "t")], pa.list_(pa.int32()))], [by, "ids"])

    return map_batches(docs.select(F.col(by).alias("i"), F.col(text).alias("t")), each, f"`{by}` {kind}, ids array<int>", TAKEN, keeps="bpe")


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "ids", by: str = "doc_id") -> DataFrame:
    """(by, bytes) of every row; null ids are none."""
    kind = encoded.schema[by].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([e.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], [by, "bytes"])

    return map_batches(encoded.select(F.col(by).alias("i"), F.col(ids).alias("x")), each, f"`{by}` {kind}, bytes binary", TAKEN, keeps="bpe")


def digests(docs: DataFrame, path: str, pattern: str, *, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(by, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass."""
    kind = docs.schema[by].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        n, a, b = [], [], []
        for t in texts_of(batch, "t"):
            ids = e.encode(t)
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(e.names.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [by, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(by).alias("i"), F.col(text).alias("t")), each, f"`{by}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", TAKEN, keeps="bpe")
