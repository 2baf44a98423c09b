"""The lenient profile over a growing directory, by Structured Streaming.

Each micro-batch runs the same pass as a whole log does; what it needs of the log so far is one small state: the last
record's hash, sequence and time, the counters, and the chain root's open tree (a node for each bit of the record count, and
the hashes of the last open chunk). The state of a batch is written under its number by rename, and a batch that is run
again begins from the state before it; so each line counts once. Errors go to a table, by batch.

Segments must arrive in the order of their names, whole, and names must be sortable. A segment whose name sorts before one
that was read raises. There is no watermark: a time that goes back is an error of the log, not late data. With fail_fast,
the stream ends at the first error.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import blake3, messages
from ..operators import digest as dg
from ..operators.digest import Checks
from ..operators.root import nodes_of
from ..plans import lenient
from ..plans.lenient import Options
from ..plans.reports import LenientReport
from ..sources import segments


@dataclass
class State:
    batch: int = -1
    last_name: str = ""
    lines: int = 0
    records: int = 0
    tail: dict[str, Any] | None = None
    first: dict[str, Any] | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(dg.COUNTERS, 0))
    root: list[Any] = field(default_factory=lambda: [0, "", []])
    halted: bool = False

    def hash(self) -> blake3.ListHash:
        count, pending, nodes = self.root
        return blake3.ListHash(count, base64.b64decode(pending), [(lv, i, base64.b64decode(b)) for lv, i, b in nodes])

    def keep(self, h: blake3.ListHash) -> None:
        count, pending, nodes = h.state()
        self.root = [count, base64.b64encode(pending).decode(), [(lv, i, base64.b64encode(b).decode()) for lv, i, b in nodes]]


class OrderError(ValueError):
    """A segment came after one whose name sorts behind it."""


class StreamHalted(RuntimeError):
    """fail_fast met an error."""


class StreamVerifier:
    """Verifies what is added to a directory. home: a folder for states and errors, which every run of the stream shares."""

    def __init__(self, spark: SparkSession, directory: str, home: str, options: Options = Options()):
        self.spark, self.directory, self.home, self.options = spark, directory, home.rstrip("/"), options
        self.pin, self._pin_warnings = lenient.pin_of(options.trusted_pubkey)

    # states

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.home}/state")
        return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self, before: int | None = None) -> State:
        """The newest state, or the newest of a batch under before."""
        path, fs = self._fs()
        top = path(f"{self.home}/state")
        if not fs.exists(top):
            return State()
        numbers = [int(n[:-5]) for s in fs.listStatus(top) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return State()
        stream = fs.open(path(f"{self.home}/state/{max(numbers)}.json"))
        try:
            return State(**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()

    def _save(self, s: State) -> None:
        path, fs = self._fs()
        tmp, final = path(f"{self.home}/state/_{s.batch}.tmp"), path(f"{self.home}/state/{s.batch}.json")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(s.__dict__).encode()))
        finally:
            out.close()
        if fs.exists(final):
            fs.delete(final, False)
        fs.rename(tmp, final)
        for n in range(max(0, s.batch - 100), s.batch - 10):  # some older states stay, for runs from an earlier checkpoint
            fs.delete(path(f"{self.home}/state/{n}.json"), False)

    # batches

    def process(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of scan rows."""
        s = self.state(before=number)
        if s.halted:
            return
        checks = Checks(policy=self.options.policy, pin=self.pin, keystore=self.options.keystore, iso=self.options.iso_timestamps)
        digest = dg.digest(batch, checks, dg.Origin(s.lines, s.records, s.tail))
        try:
            self._advance(s, digest, number)
        finally:
            digest.release()
        s.batch = number
        self._save(s)
        if s.halted:
            raise StreamHalted(f"batch {number}: an error ends the stream")

    def _advance(self, s: State, digest: dg.Digest, number: int) -> None:
        totals = digest.totals
        if totals["first_name"] is None:
            return
        if s.last_name and totals["first_name"] <= s.last_name:
            raise OrderError(f"segment {totals['first_name']} came after {s.last_name}")
        if self.directory:
            seen = segments.list_segments(self.spark, self.directory)  # also checks that names can be sorted
            here = {r["name"] for r in digest.blocks.select("name").distinct().collect()}
            if late := [x.name for x in seen if s.last_name < x.name < totals["last_name"] and x.size and x.name not in here]:
                raise OrderError(f"segment {late[0]} has not been read, but {totals['last_name']} has")
        errors = lenient.errors_of(digest)
        halt = errors.orderBy("line", "rank", "sub").first() if self.options.fail_fast and digest.n_errors else None
        if halt is not None:
            errors = self.spark.createDataFrame([tuple(halt)], errors.schema)
            s.halted = True
        shown = errors.select("line", "rank", "sub", "sequence", "error_type", "details")
        shown.write.mode("overwrite").parquet(f"{self.home}/errors/batch={number}")
        lenient.warnings_of(digest, halt).write.mode("overwrite").parquet(f"{self.home}/warnings/batch={number}")
        if halt is None:
            counts, rows, added, last = {c: totals[c] for c in dg.COUNTERS}, digest.runs(), totals["records"], totals["tail"]
        else:
            (counts, rows), added, last = lenient.prefix_of(digest, halt), halt["record"] - s.records, lenient.last_before(halt)
        if totals["head"] is not None and last is not None:
            s.first = s.first or {k: totals["head"][k] for k in ("line", "sequence", "ts", "hash")}
            s.tail = {k: last[k] if k in ("sequence", "ts") or halt is None else None for k in ("line", "sequence", "ts", "hash")}
        if added:
            h = s.hash()
            h.absorb([tuple(r) for r in nodes_of(rows, None).collect()], added)
            s.keep(h)
        s.lines += totals["lines"]
        s.records += added
        s.last_name = totals["last_name"]
        for c in dg.COUNTERS:
            s.counts[c] += counts[c]

    # running

    def start(self, checkpoint: str | None = None, *, max_files: int = 1000, once: bool = False) -> StreamingQuery:
        source = self.spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.{" + ",".join(segments.EXTENSIONS) + "}")
        lines = segments.lines_of(source.text(self.directory))
        for n in segments.SIDECARS:
            lines = lines.where(F.col("name") != n)
        out = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint or f"{self.home}/checkpoint")
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime="5 seconds")).start()

    def errors(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.home}/errors").parquet(f"{self.home}/errors")

    def report(self, most: int = lenient.LISTED) -> LenientReport:
        """The report of all that has been read; it lists the first errors and warnings, errors() has all."""
        s, out = self.state(), LenientReport()
        listed = self.errors().orderBy("line", "rank", "sub").limit(most).collect() if s.batch >= 0 else []
        out.errors = [lenient.error_of(e) for e in listed]
        out.valid, out.halted_early = not listed, s.halted
        out.events_verified, out.signatures_verified, out.signatures_skipped, out.receipts_verified = s.records, s.counts["signatures_ok"], s.counts["signatures_skipped"], s.counts["receipts_ok"]
        if s.first and s.tail:
            out.first_sequence, out.first_timestamp, out.last_sequence, out.last_timestamp = int(s.first["sequence"]), s.first["ts"], int(s.tail["sequence"]), s.tail["ts"]
        out.chain_root = s.hash().digest().hex()
        warned = [r["text"] for r in self.spark.read.parquet(f"{self.home}/warnings").orderBy("record").limit(most).collect()] if s.batch >= 0 else []
        out.warnings = [*self._pin_warnings, *warned]
        if len(listed) == most and (total := self.errors().count()) > most:
            out.warnings.append(messages.W_MORE.format(listed=most, total=total))
        lenient.conclude(out, self.options, self.pin is None, s.counts["receipts_seen"])
        return out

