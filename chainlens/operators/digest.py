"""The one pass over a log's lines: decoding, hashing, and all checks that a block's own lines allow.

Each run of lines becomes one row, its digest: the entry hashes packed (32 bytes a record), a byte of flags a record, counts,
the errors found, and what its neighbours need to check the seams. Everything else (positions, the checks between blocks,
the chain root, reports) is made from digests, and lines are read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import blake3, ed25519, messages, record
from ..functions.record import Record
from ..functions.strict_json import JsonError
from . import splits

#: Bits of a record's flags.
SIG_OK, SIG_SKIPPED, RECEIPT_SEEN, RECEIPT_OK, HAS_SIGNATURE, HAS_RECEIPT, SDK, KEPT = (1 << k for k in range(8))
COUNTERS = {"signatures_ok": SIG_OK, "signatures_skipped": SIG_SKIPPED, "receipts_seen": RECEIPT_SEEN, "receipts_ok": RECEIPT_OK, "signed": HAS_SIGNATURE, "with_receipt": HAS_RECEIPT, "sdk": SDK, "kept": KEPT}

#: Where in a record's checks an error arises; errors of a record are ordered by it.
PARSE, LINK, SEQUENCE, TIMESTAMP, SIGNATURE, ALG, RECEIPT, FORMAT = range(8)

#: last: for what is no record, the sequence of the last record before it in the block; ts is that one's then.
_ERROR = "line long, record long, rank int, sub int, sequence string, ts long, error_type string, details string, last string"
_SIDE = "line long, sequence string, ts long, hash string"
DIGEST = f"name string, block long, first_line long, lines long, first_record long, records long, first_kept long, hashes binary, flags binary, head struct<{_SIDE}>, tail struct<{_SIDE}>, errors array<struct<{_ERROR}>>, warnings array<struct<record long, text string>>, streams array<string>, " + ", ".join(f"{c} long" for c in COUNTERS)

_P_ERROR = pa.list_(pa.struct([("line", pa.int64()), ("record", pa.int64()), ("rank", pa.int32()), ("sub", pa.int32()), ("sequence", pa.string()), ("ts", pa.int64()), ("error_type", pa.string()), ("details", pa.string()), ("last", pa.string())]))
_P_SIDE = pa.struct([("line", pa.int64()), ("sequence", pa.string()), ("ts", pa.int64()), ("hash", pa.string())])

#: White space of the two kinds of blank lines.
ASCII_BLANK = b" \t\n\x0c\r"


@dataclass(frozen=True)
class Policy:
    """Which records' signatures are checked: all, none, or those whose sequence one_in divides (0: none)."""

    kind: str = "all"
    one_in: int = 0

    def __post_init__(self) -> None:
        if self.kind not in ("all", "none", "sample"):
            raise ValueError(f"a signature policy is all, none or sample, not {self.kind}")

    def selects(self, sequence: int) -> bool:
        return self.kind == "all" or self.kind == "sample" and self.one_in != 0 and sequence % self.one_in == 0


ALL, NONE = Policy(), Policy("none")


def sample(one_in: int) -> Policy:
    return Policy("sample", one_in)


@dataclass
class Checks:
    """What the pass checks.

    pin: the only key that may sign; unicode_blank: lines of any white space are blank, and bad UTF-8 has its own error; from_ns
    and to_ns: bounds, themselves in, of the times of the records that are marked as kept.
    """

    policy: Policy = ALL
    pin: bytes | None = None
    keystore: Mapping[str, bytes] | None = None
    iso: bool = True
    unicode_blank: bool = False
    from_ns: int | None = None
    to_ns: int | None = None

    def keeps(self, ts: int) -> bool:
        return (self.from_ns is None or ts >= self.from_ns) and (self.to_ns is None or ts <= self.to_ns)


Error = tuple  # of the fields of _ERROR; last may be left out


def quoted(text: str) -> str:
    """A text in quotes, with escapes, as messages show what was given."""
    out = []
    for c in text:
        out.append({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}"))
    return '"' + "".join(out) + '"'


def receipt_checks(own: list[tuple[str, dict, str, str | None]], keystore: Mapping[str, bytes]) -> list[tuple[str, str] | None]:
    """For each (sequence, receipt, payload hash and event id of the record) the error's type and text, or None. Signatures are checked together."""
    out: list[tuple[str, str] | None] = [None] * len(own)
    keys, signed, signatures, at = [], [], [], []
    for k, (seq, r, _, _) in enumerate(own):
        kind = what = None
        if r["sig_alg"] != "ed25519":
            kind, what = "receipt_unsupported_alg", quoted(r["sig_alg"])
        elif r["server_key_id"] not in keystore:
            kind, what = "receipt_key_unknown", r["server_key_id"]
        else:
            try:
                sig = bytes.fromhex(r["receipt_sig"]) if r["receipt_sig"].isalnum() or not r["receipt_sig"] else None
            except ValueError:
                sig = None
            if sig is None:
                kind, what = "receipt_sig_malformed", "receipt_sig is not valid hex"
            elif len(sig) != 64:
                kind, what = "receipt_sig_malformed", f"receipt_sig must be 64 bytes, got {len(sig)}"
            else:
                keys.append(keystore[r["server_key_id"]])
                signed.append(record.receipt_message(r))
                signatures.append(sig)
                at.append(k)
        if kind:
            out[k] = kind, messages.RECEIPT[kind].format(seq=seq, what=what)
    for k, ok in zip(at, ed25519.verify_many(keys, signed, signatures), strict=True):
        seq, r, payload_hash, event_id = own[k]
        if not ok:
            out[k] = "receipt_signature_invalid", messages.RECEIPT["receipt_signature_invalid"].format(seq=seq)
        elif r["payload_hash"] != payload_hash or event_id is not None and r["event_id"] != event_id:
            which = "payload_hash" if r["payload_hash"] != payload_hash else "event_id"
            out[k] = "receipt_entry_mismatch", messages.RECEIPT["receipt_entry_mismatch"].format(seq=seq, what=which)
    return out


class Digester:
    """Digests the blocks that a task reads."""

    def __init__(self, checks: Checks):
        self.c = checks

    def open(self, name: str, block: int) -> None:
        self.name, self.block, self.line, self.record, self.kept = name, block, 0, 0, 0
        self.before: tuple[str, int, int] | None = None  # entry hash, sequence and time of the last record

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def decoded(self, lines: list[bytes], errors: list[Error]) -> tuple[list[Record], list[int]]:
        """The records, and the line of each."""
        rows, at = [], []
        iso, unicode_blank = self.c.iso, self.c.unicode_blank
        for i, line in enumerate(lines, self.line):
            if line[-1:] == b"\r":
                line = line[:-1]
            try:
                if unicode_blank:
                    try:
                        if not line.decode().strip():
                            continue
                    except UnicodeDecodeError:
                        errors.append(self._no_record(i, rows, "invalid_utf8", messages.INVALID_UTF8))
                        continue
                elif not line.strip(ASCII_BLANK):
                    continue
                rows.append(record.decode(line, iso=iso))
                at.append(i)
            except JsonError as e:
                errors.append(self._no_record(i, rows, "parse_error", str(e)))
        return rows, at

    def _no_record(self, line: int, rows: list[Record], kind: str, text: str) -> Error:
        last = (rows[-1].sequence, rows[-1].timestamp_ns) if rows else self.before[1:] if self.before else None
        return line, self.record + len(rows), PARSE, 0, None, last[1] if last else None, kind, text, str(last[0]) if last else None

    def feed(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        c = self.c
        errors: list[Error] = []
        rows, at = self.decoded(lines, errors)
        n = len(rows)
        chosen = [i for i, r in enumerate(rows) if r.signature is not None and r.public_key is not None and c.policy.selects(r.sequence) and (c.pin is None or record.unhex(r.public_key, 32) == c.pin)]
        digests = blake3.hash_many([record.entry_message(r) for r in rows] + [record.sign_message(rows[i]) for i in chosen])
        hashes, signed = digests[:n], blake3.hexes(digests[n:])
        hexes = blake3.hexes(hashes)
        sig_ok = dict(zip(chosen, self._signatures([rows[i] for i in chosen], signed), strict=True))
        flags, warnings, streams = np.zeros(n, np.uint8), [], set()
        receipts: list[int] = []
        before = self.before
        for i, r in enumerate(rows):
            seq, ts = r.sequence, r.timestamp_ns
            here = at[i], self.record + i
            mark = KEPT if c.keeps(ts) else 0
            if before is not None:
                link, last, then = before
                if r.prev_hash != link:
                    errors.append((*here, LINK, 0, str(seq), ts, "chain_break", messages.CHAIN_BREAK.format(expected=link, found=r.prev_hash)))
                expected = min(last + 1, record.U64[1])
                if seq != expected:
                    errors.append((*here, SEQUENCE, 0, str(seq), ts, "sequence_gap", messages.SEQUENCE_GAP.format(expected=expected, previous=last, found=seq)))
                if ts < then:
                    errors.append((*here, TIMESTAMP, 0, str(seq), ts, "timestamp_regression", messages.TIMESTAMP_REGRESSION.format(found=ts, previous=then)))
            before = hexes[i], seq, ts
            has_sig, has_key = r.signature is not None, r.public_key is not None
            if has_sig:
                mark |= HAS_SIGNATURE
            if r.event_id is not None or r.stream_id is not None:
                mark |= SDK
            if r.stream_id is not None:
                streams.add(r.stream_id)
            if r.receipt is not None:
                mark |= HAS_RECEIPT
            known = sig_ok.get(i)
            if known is not None:
                if known:
                    mark |= SIG_OK
                else:
                    errors.append((*here, SIGNATURE, 0, str(seq), ts, "invalid_signature", messages.INVALID_SIGNATURE))
            elif c.policy.selects(seq):
                if has_sig and has_key:
                    errors.append((*here, SIGNATURE, 0, str(seq), ts, "untrusted_pubkey", messages.UNTRUSTED_PUBKEY))
                    flags[i] = mark
                    continue  # nothing more is said of such a record
                if has_sig or has_key:
                    errors.append((*here, SIGNATURE, 0, str(seq), ts, "unsigned_record", messages.HALF_SIGNED))
                elif c.pin is not None:
                    errors.append((*here, SIGNATURE, 0, str(seq), ts, "unsigned_record", messages.UNSIGNED_PINNED))
            elif has_sig or has_key:
                mark |= SIG_SKIPPED
            if r.hash_alg is not None and r.hash_alg != record.HASH_ALG:
                warnings.append((here[1], messages.W_ALG.format(seq=seq, alg=quoted(r.hash_alg))))
            if r.receipt is not None:
                mark |= RECEIPT_SEEN
                receipts.append(i)
            for k, text in enumerate(record.hash_problems(r)):
                errors.append((*here, FORMAT, k, str(seq), ts, "invalid_hash_format", text))
            flags[i] = mark
        if c.keystore is not None and receipts:
            found = receipt_checks([(str(r.sequence), r.receipt, r.payload_hash, r.event_id) for r in (rows[i] for i in receipts)], c.keystore)
            for i, problem in zip(receipts, found, strict=True):
                if problem is None:
                    flags[i] |= RECEIPT_OK
                else:
                    errors.append((at[i], self.record + i, RECEIPT, 0, str(rows[i].sequence), rows[i].timestamp_ns, *problem))
        side = lambda k, h: {"line": at[k], "sequence": str(rows[k].sequence), "ts": rows[k].timestamp_ns, "hash": h}
        head, tail = (side(0, rows[0].prev_hash), side(-1, hexes[-1])) if n else (None, None)
        yield self._row(len(lines), n, hashes, flags, head, tail, errors, warnings, streams)
        self.line += len(lines)
        self.record += n
        self.kept += int(np.count_nonzero(flags & KEPT))
        self.before = before

    @staticmethod
    def _signatures(rows: list[Record], signed: list[str]) -> list[bool]:
        keys = [record.unhex(r.public_key, 32) or b"" for r in rows]
        return ed25519.verify_many(keys, [s.encode() for s in signed], [record.unhex(r.signature, 64) or b"" for r in rows])

    def _row(self, lines, n, hashes, flags, head, tail, errors, warnings, streams) -> pa.RecordBatch:
        names = ("line", "record", "rank", "sub", "sequence", "ts", "error_type", "details", "last")
        values = {
            "name": pa.array([self.name], pa.string()),
            "block": pa.array([self.block], pa.int64()),
            "first_line": pa.array([self.line], pa.int64()),
            "lines": pa.array([lines], pa.int64()),
            "first_record": pa.array([self.record], pa.int64()),
            "records": pa.array([n], pa.int64()),
            "first_kept": pa.array([self.kept], pa.int64()),
            "hashes": pa.array([hashes.tobytes()], pa.binary()),
            "flags": pa.array([flags.tobytes()], pa.binary()),
            "head": pa.array([head], _P_SIDE),
            "tail": pa.array([tail], _P_SIDE),
            "errors": pa.array([[dict(zip(names, e, strict=False)) for e in sorted(errors, key=lambda e: (e[0], e[2], e[3]))]], _P_ERROR),
            "warnings": pa.array([[{"record": r, "text": t} for r, t in warnings]], pa.list_(pa.struct([("record", pa.int64()), ("text", pa.string())]))),
            "streams": pa.array([sorted(streams)], pa.list_(pa.string())),
        } | {c: pa.array([int(np.count_nonzero(flags & bit))], pa.int64()) for c, bit in COUNTERS.items()}
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))


def _seams(head: Column, before: Column) -> Column:
    """Errors of a block's first record: of the genesis, or of what it makes of the record before."""
    u64 = lambda c: c.cast("decimal(20,0)")
    seq, last = u64(head["sequence"]), u64(before["sequence"])
    expected = F.least(last.cast("decimal(21,0)") + 1, F.lit(str(record.U64[1])).cast("decimal(21,0)")).cast("decimal(20,0)")

    def error(rank: int, kind: str, details: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("error_type"), details.alias("details"))

    found = head["sequence"]
    first = before.isNull()
    link = (
        F.when(first & (seq != 1), error(LINK, "invalid_genesis", messages.column(messages.GENESIS_SEQUENCE, found=found)))
        .when(first & (head["hash"] != record.GENESIS_PREV_HASH), error(LINK, "invalid_genesis", messages.column(messages.GENESIS_HASH, expected=record.GENESIS_PREV_HASH[:16], found=head["hash"])))
        .when(before["hash"] != head["hash"], error(LINK, "chain_break", messages.column(messages.CHAIN_BREAK, expected=before["hash"], found=head["hash"])))
    )
    gap = F.when(~first & (seq != expected), error(SEQUENCE, "sequence_gap", messages.column(messages.SEQUENCE_GAP, expected=expected, previous=before["sequence"], found=found)))
    time = F.when(head["ts"] < before["ts"], error(TIMESTAMP, "timestamp_regression", messages.column(messages.TIMESTAMP_REGRESSION, found=head["ts"], previous=before["ts"])))
    return F.when(head.isNull(), F.array().cast("array<struct<rank int, error_type string, details string>>")).otherwise(F.filter(F.array(link, gap, time), lambda x: x.isNotNull()))


#: Blocks up to which their places are computed by a loop on the driver.
DRIVER_BLOCKS = 5_000


@dataclass
class Origin:
    """What came before the scan: lines and records, and the last record's side."""

    lines: int = 0
    records: int = 0
    tail: dict | None = None


@dataclass
class Digest:
    """The digests of a log, kept for the steps that follow, and the places of its blocks."""

    parts: DataFrame
    blocks: DataFrame
    #: blocks, lines, records, errors, seams, warnings, kept and the counters of the whole; head and tail
    totals: Row | dict

    @property
    def n_blocks(self) -> int:
        return self.totals["blocks"]

    @property
    def n_errors(self) -> int:
        return self.totals["errors"] + self.totals["seams"]

    def located(self, parts: DataFrame) -> DataFrame:
        """parts with line_at, record_at, name_line_at and before of their blocks."""
        return parts.join(splits.small(self.blocks.select("name", "block", "line_at", "record_at", "kept_at", "name_line_at", "before"), self.n_blocks), ["name", "block"])

    def runs(self) -> DataFrame:
        """(start, hashes, flags, records) in log positions."""
        return self.located(self.parts.where("records > 0").select("name", "block", "first_record", "hashes", "flags", "records")).select((F.col("record_at") + F.col("first_record")).alias("start"), "hashes", "flags", "records")

    def kept_runs(self) -> DataFrame:
        """(start, hashes) of the kept records, in positions among these."""

        def only_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, hashes, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = np.frombuffer(hashes, np.uint8).reshape(-1, 32)[np.frombuffer(flags, np.uint8) & KEPT > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["start", "hashes"])

        own = self.located(self.parts.where("kept > 0").select("name", "block", "first_kept", "hashes", "flags"))
        return own.select((F.col("kept_at") + F.col("first_kept")).alias("start"), "hashes", "flags").mapInArrow(only_kept, "start long, hashes binary")

    def release(self) -> None:
        self.blocks.unpersist()
        self.parts.unpersist()


def digest(scan: DataFrame, checks: Checks, origin: Origin = Origin()) -> Digest:
    """Runs the pass, in one job. The digests are persisted, about 33 bytes a record; what an executor loses is made again from its blocks."""
    parts = splits.split_map(scan, lambda: Digester(checks), DIGEST).persist()
    first = lambda f, c: F.expr(f"{f}({c}, first_record) FILTER (WHERE records > 0)").alias(c)
    sizes = [F.sum(F.size(c)).alias(f"n_{c}") for c in ("errors", "warnings")]
    sums = parts.groupBy("name", "block").agg(F.sum("lines").alias("lines"), F.sum("records").alias("records"), first("min_by", "head"), first("max_by", "tail"), *sizes, *[F.sum(c).alias(c) for c in COUNTERS])
    few = sums.limit(DRIVER_BLOCKS + 1).collect()
    if len(few) <= DRIVER_BLOCKS:
        blocks, totals = _placed_here(sums, few, origin)
    else:
        blocks, totals = _placed_there(sums, origin)
    return Digest(parts, blocks, totals)


def _placed_there(sums: DataFrame, origin: Origin) -> tuple[DataFrame, Row]:
    """The blocks with their places and seams, and the log's totals; by windows."""
    blocks = splits.placed(sums, ("lines", "records", "kept"))
    if origin.tail is not None:
        side = F.struct(*[F.lit(origin.tail.get(k)).cast(t).alias(k) for k, t in (("line", "long"), ("sequence", "string"), ("ts", "long"), ("hash", "string"))])
        blocks = blocks.withColumn("before", F.coalesce("before", side))
    blocks = blocks.withColumn("line_at", F.col("line_at") + origin.lines).withColumn("record_at", F.col("record_at") + origin.records)
    blocks = blocks.withColumn("seams", _seams(F.col("head"), F.col("before"))).persist()
    total = lambda c, name=None: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name or c)
    filled = "FILTER (WHERE records > 0)"
    totals = blocks.agg(F.count("*").alias("blocks"), total("lines"), total("records"), total("n_errors", "errors"), total("n_warnings", "warnings"), total(F.size("seams"), "seams"), *[total(c) for c in COUNTERS], F.expr(f"min_by(head, record_at) {filled}").alias("head"), F.expr(f"max_by(tail, record_at) {filled}").alias("tail"), F.min("name").alias("first_name"), F.max("name").alias("last_name")).first()
    return blocks, totals


def _seams_here(head: Row, before: Mapping | None) -> list[tuple[int, str, str]]:
    """As _seams(), of one block."""
    out = []
    seq, m = int(head["sequence"]), messages
    if before is None:
        if seq != 1:
            out.append((LINK, "invalid_genesis", m.GENESIS_SEQUENCE.format(found=seq)))
        elif head["hash"] != record.GENESIS_PREV_HASH:
            out.append((LINK, "invalid_genesis", m.GENESIS_HASH.format(expected=record.GENESIS_PREV_HASH[:16], found=head["hash"])))
        return out
    last = int(before["sequence"])
    expected = min(last + 1, record.U64[1])
    if before["hash"] != head["hash"]:
        out.append((LINK, "chain_break", m.CHAIN_BREAK.format(expected=before["hash"], found=head["hash"])))
    if seq != expected:
        out.append((SEQUENCE, "sequence_gap", m.SEQUENCE_GAP.format(expected=expected, previous=last, found=seq)))
    if head["ts"] < before["ts"]:
        out.append((TIMESTAMP, "timestamp_regression", m.TIMESTAMP_REGRESSION.format(found=head["ts"], previous=before["ts"])))
    return out


def _placed_here(sums: DataFrame, rows: list[Row], origin: Origin) -> tuple[DataFrame, dict]:
    """As _placed_there(), for blocks so few that a loop over them is quicker than the shuffles."""
    counts = ("lines", "records", "kept")
    sides = ("line", "sequence", "ts", "hash")
    at = dict.fromkeys(counts, 0)
    before = {k: origin.tail.get(k) for k in sides} if origin.tail is not None else None
    side = lambda x: None if x is None else tuple(x[k] for k in sides)
    out, name, name_line_at, seams = [], None, 0, 0
    names = sums.columns
    for r in sorted(rows, key=lambda r: (r["name"].encode(), r["block"])):
        if r["name"] != name:
            name, name_line_at = r["name"], 0
        own = _seams_here(r["head"], before) if r["head"] is not None else []
        seams += len(own)
        out.append((*(side(r[c]) if c in ("head", "tail") else r[c] for c in names), at["lines"] + origin.lines, at["records"] + origin.records, at["kept"], name_line_at, side(before), own))
        name_line_at += r["lines"]
        for c in counts:
            at[c] += r[c]
        if r["tail"] is not None:
            before = r["tail"].asDict()
    kinds = {"name": pa.string(), "head": _P_SIDE, "tail": _P_SIDE, "before": _P_SIDE, "seams": pa.list_(pa.struct([("rank", pa.int32()), ("error_type", pa.string()), ("details", pa.string())]))}
    columns = [*names, "line_at", "record_at", "kept_at", "name_line_at", "before", "seams"]
    fields = {"before": sides, "head": sides, "tail": sides}
    cell = lambda c, x: dict(zip(fields[c], x, strict=True)) if c in fields and x is not None else [dict(zip(("rank", "error_type", "details"), e, strict=True)) for e in x] if c == "seams" else x
    table = pa.table({c: pa.array([cell(c, r[k]) for r in out], kinds.get(c, pa.int64())) for k, c in enumerate(columns)})
    blocks = sums.sparkSession.createDataFrame(table)  # a local relation, which needs no job
    total = lambda c: sum(r[c] for r in rows)
    filled = [r for r in out if r[names.index("records")]]
    end = lambda k, c: dict(zip(sides, filled[k][names.index(c)], strict=True)) if filled else None
    totals = {"blocks": len(rows), "lines": total("lines"), "records": total("records"), "errors": total("n_errors"), "warnings": total("n_warnings"), "seams": seams, **{c: total(c) for c in COUNTERS}, "head": end(0, "head"), "tail": end(-1, "tail"), "first_name": out[0][names.index("name")] if out else None, "last_name": out[-1][names.index("name")] if out else None}
    return blocks, totals
