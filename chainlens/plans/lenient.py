"""The lenient profile: every problem of a log is listed; keys, roots and receipts are checked as far as they are given.

Lines are read once (operators.digest). The checks across blocks and all positions come from a table with one row a block,
the root from a tree reduction; so nothing is sorted, and records are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, record
from ..operators import digest as dg
from ..operators.digest import ALL, Checks, Digest, Policy
from ..operators.root import chain_root
from ..sources import segments
from .reports import LenientReport, blank_is_none, envelope

#: Errors that a report lists, and warnings of records.
LISTED = 100_000


@dataclass(frozen=True)
class Options:
    expected_root: str | None = None
    keystore: Mapping[str, bytes] | None = None
    fail_fast: bool = False
    trusted_pubkey: str | None = None
    policy: Policy = ALL
    iso_timestamps: bool = True


def pin_of(text: str | None) -> tuple[bytes | None, list[str]]:
    """The pinned key, and a warning if it isn't one."""
    if text is None:
        return None, []
    size = len(text.encode())
    key = record.unhex(text, 32)
    if key is not None:
        return key, []
    return None, [messages.W_BAD_PIN.format(why=f"expected 64 hex chars, got {size}" if size != 64 else "invalid hex digit")]


def errors_of(digest: Digest) -> DataFrame:
    """(line, record, rank, sub, sequence, ts, error_type, details, ...) of all errors; line and record count from 0 in the whole log."""
    own = digest.parts.where(F.size("errors") > 0).select("name", "block", F.explode("errors").alias("e")).select("name", "block", "e.*")
    head = F.col("head")
    seams = digest.blocks.where(F.size("seams") > 0).select("name", "block", "head", F.explode("seams").alias("e"))
    seams = seams.select("name", "block", head["line"].alias("line"), F.lit(0).cast("long").alias("record"), "e.rank", F.lit(0).alias("sub"), head["sequence"].alias("sequence"), head["ts"].alias("ts"), "e.error_type", "e.details", F.lit(None).cast("string").alias("last"))
    both = digest.located(own.unionByName(seams))
    line = F.col("line_at") + F.col("line")
    details = F.when(F.col("error_type") == "parse_error", messages.column(messages.PARSE_ERROR, line=line + 1, details=F.col("details"))).otherwise(F.col("details"))
    return both.select(line.alias("line"), (F.col("record_at") + F.col("record")).alias("record"), "rank", "sub", "sequence", "ts", "error_type", details.alias("details"), "last", "before", "name", (F.col("name_line_at") + F.col("line")).alias("name_line"))


def prefix_of(digest: Digest, halt) -> tuple[dict[str, int], DataFrame]:
    """Counts and runs of hashes up to the error that halts a run. Of the halting record counts what was checked before its error."""
    m = halt["record"]
    runs = digest.runs()
    inside = (F.col("start") <= m) & (F.col("start") + F.col("records") > m)
    cut = runs.where(inside).first()  # one run at most
    flags = np.frombuffer(cut["flags"], np.uint8) if cut else np.zeros(0, np.uint8)
    n = m - cut["start"] if cut else 0
    covered = digest.located(digest.parts.where("records > 0").drop("hashes", "flags")).where(F.col("record_at") + F.col("first_record") + F.col("records") <= m)
    sums = covered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dg.COUNTERS]).first()
    counts = {c: sums[c] + int(np.count_nonzero(flags[:n] & bit)) for c, bit in dg.COUNTERS.items()}
    rows = runs.where(F.col("start") + F.col("records") <= m).select("start", "hashes")
    if n:
        rows = rows.unionByName(rows.sparkSession.createDataFrame([(cut["start"], bytearray(cut["hashes"][: 32 * n]))], "start long, hashes binary"))
    if len(flags) > n:
        for c, bit, rank in (("signatures_ok", dg.SIG_OK, dg.SIGNATURE), ("signatures_skipped", dg.SIG_SKIPPED, dg.SIGNATURE), ("receipts_seen", dg.RECEIPT_SEEN, dg.ALG), ("receipts_ok", dg.RECEIPT_OK, dg.RECEIPT)):
            counts[c] += int(halt["rank"] > rank and bool(flags[n] & bit))
    return counts, rows


def last_before(halt):
    """Sequence and time of the last record that was decoded when the run halted: the halting one, or the one before a line that is none."""
    if halt["rank"] > dg.PARSE:
        return {"sequence": halt["sequence"], "ts": halt["ts"]}
    if halt["last"] is not None:
        return {"sequence": halt["last"], "ts": halt["ts"]}
    return halt["before"]


def warnings_of(digest: Digest, halt=None) -> DataFrame:
    """(record, text) of the records' warnings, up to the error that halts the run."""
    own = digest.parts.where(F.size("warnings") > 0).select("name", "block", F.explode("warnings").alias("w")).select("name", "block", "w.record", "w.text")
    out = digest.located(own).select((F.col("record_at") + F.col("record")).alias("record"), "text")
    if halt is None:
        return out
    return out.where(F.col("record") <= (halt["record"] if halt["rank"] > dg.ALG else halt["record"] - 1))


class LenientVerification:
    """A verification whose parts can be looked at as frames; report() puts them together."""

    def __init__(self, scan: DataFrame, options: Options = Options()):
        self.options = options
        self.pin, self._pin_warnings = pin_of(options.trusted_pubkey)
        checks = Checks(policy=options.policy, pin=self.pin, keystore=options.keystore, iso=options.iso_timestamps)
        self.digest = dg.digest(scan, checks)
        self.errors = errors_of(self.digest)

    def report(self, most: int = LISTED) -> LenientReport:
        """most: how many errors, and warnings, the report lists, the first ones in the log's order; a warning tells if there are more, and the errors frame has all."""
        o, digest, out = self.options, self.digest, LenientReport()
        totals = digest.totals
        found = self.errors if digest.n_errors else None
        halt = found.orderBy("line", "rank", "sub").first() if found is not None and o.fail_fast else None
        if halt is None:
            n, counts = totals["records"], {c: totals[c] for c in dg.COUNTERS}
            rows, last = digest.runs().select("start", "hashes"), totals["tail"]
            listed = found.orderBy("line", "rank", "sub").limit(most).collect() if found is not None else []
        else:
            n, listed, last = halt["record"], [halt], last_before(halt)
            counts, rows = prefix_of(digest, halt)
            out.halted_early = True
        warned = warnings_of(digest, halt).orderBy("record").limit(most).collect() if totals["warnings"] else []
        out.valid = found is None
        out.errors = [error_of(e) for e in listed]
        out.events_verified, out.signatures_verified, out.signatures_skipped, out.receipts_verified = n, counts["signatures_ok"], counts["signatures_skipped"], counts["receipts_ok"]
        if totals["head"] is not None and last is not None:
            out.first_sequence, out.first_timestamp = int(totals["head"]["sequence"]), totals["head"]["ts"]
            out.last_sequence, out.last_timestamp = int(last["sequence"]), last["ts"]
        out.chain_root = chain_root(rows, n)
        out.warnings = [*self._pin_warnings, *(w["text"] for w in warned)]
        if len(listed) == most and halt is None and (total := found.count()) > most:
            out.warnings.append(messages.W_MORE.format(listed=most, total=total))
        conclude(out, o, self.pin is None, counts["receipts_seen"])
        return out


def error_of(e) -> dict:
    """A row of errors as reports list it."""
    return {"sequence": None if e["sequence"] is None else int(e["sequence"]), "error_type": e["error_type"], "details": e["details"]}


def conclude(out: LenientReport, o: Options, unpinned: bool, receipts_seen: int) -> None:
    """The root gate and the closing warnings."""
    if not out.events_verified:
        out.warnings.append(messages.W_EMPTY)
    anchor = record.normalized_anchor(o.expected_root) if o.expected_root is not None else ""
    if anchor:
        if out.chain_root != anchor:
            out.valid = False
            out.errors.append({"sequence": None, "error_type": "root_mismatch", "details": messages.ROOT_MISMATCH.format(expected=anchor, found=out.chain_root)})
    elif out.events_verified:
        out.warnings.append(messages.W_NO_ROOT)
    if o.policy.kind == "none" and out.events_verified:
        out.warnings.append(messages.W_NO_SIGNATURES)
    if o.policy.kind == "sample":
        out.warnings.append(messages.W_SAMPLED.format(n=o.policy.one_in, checked=out.signatures_verified, skipped=out.signatures_skipped))
    if o.trusted_pubkey is None and unpinned and out.signatures_verified:
        out.warnings.append(messages.W_UNPINNED.format(n=out.signatures_verified))
    if o.keystore is None and receipts_seen:
        out.warnings.append(messages.W_RECEIPTS.format(n=receipts_seen))


def profile_hint(out: LenientReport) -> None:
    """A warning if every record failed its signature, as those of a log for the strict profile do."""
    failed = sum(e["error_type"] == "invalid_signature" for e in out.errors)
    if not out.valid and failed and failed == out.events_verified:
        out.warnings.append(messages.W_PROFILE)


def verify_scan(scan: DataFrame, options: Options = Options()) -> LenientReport:
    v = LenientVerification(scan, options)
    try:
        return v.report()
    finally:
        v.digest.release()


def verify_directory(spark: SparkSession, directory: str, options: Options = Options()) -> LenientReport:
    return verify_scan(segments.scan_directory(spark, directory), options)


def verify_bytes(spark: SparkSession, data: bytes, options: Options = Options(), parts: int = 1) -> LenientReport:
    """Bytes in memory; the policy is always all."""
    return verify_scan(segments.scan_bytes(spark, data, parts), Options(options.expected_root, options.keystore, options.fail_fast, options.trusted_pubkey, ALL, options.iso_timestamps))


def verify_bytes_json(spark: SparkSession, data: bytes, expected_root: str | None = None) -> str:
    """The report in the envelope of host pages, whose times are integers."""
    return envelope(verify_bytes(spark, data, Options(expected_root=blank_is_none(expected_root), iso_timestamps=False)))
