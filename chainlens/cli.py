"""python -m chainlens.cli verify | inspect | export | seed. Exit codes: 0 all well, 1 done with issues, 2 the command could not run."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from .functions import messages, record
from .functions.seeds import seed_of
from .operators import digest as dg
from .operators import export as ex
from .operators import inspect as ins
from .plans import demo, lenient, reports, strict
from .sources import segments
from .sources.keystore import Keystore, KeystoreError


class UsageError(ValueError):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chainlens", description="Verify, inspect and export hash-chained audit logs.")
    p.add_argument("-f", "--format", choices=("json", "text", "quiet"), default="text")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-f", "--format", choices=("json", "text", "quiet"), default=argparse.SUPPRESS)
    shared.add_argument("-w", "--wal", required=True, help="directory of segments")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify", parents=[shared])
    v.add_argument("--expected-root")
    v.add_argument("-o", "--output")
    v.add_argument("--fail-fast", action="store_true")
    v.add_argument("--keystore")
    v.add_argument("--trusted-pubkey")
    v.add_argument("--strict", action="store_true")
    v.add_argument("--chain-only", action="store_true")
    v.add_argument("--sample-signatures", type=int, metavar="N")
    v.add_argument("--manifest-version", type=int, default=1)
    e = sub.add_parser("export", parents=[shared])
    e.add_argument("-o", "--output")
    e.add_argument("--export-format", choices=ex.FORMATS, default="jsonl")
    e.add_argument("--from", dest="from_")
    e.add_argument("--to")
    e.add_argument("--include-proofs", action="store_true")
    e.add_argument("--syslog-facility", type=int, default=ex.FACILITY)
    i = sub.add_parser("inspect", parents=[shared])
    i.add_argument("-n", "--last", type=int, default=10)
    i.add_argument("--sequence", type=int)
    i.add_argument("--stats", action="store_true")
    d = sub.add_parser("seed", help="write the demonstration log")
    d.add_argument("-f", "--format", choices=("json", "text", "quiet"), default=argparse.SUPPRESS)
    d.add_argument("--output-dir", default="out")
    d.add_argument("--non-interactive", action="store_true")
    d.add_argument("--deterministic-seed", type=int)
    return p


def _conflicts(a: argparse.Namespace) -> None:
    reduced = a.chain_only or a.sample_signatures is not None
    anchors = a.trusted_pubkey is not None or a.keystore is not None
    refused = [
        (a.strict and reduced, messages.U_STRICT_POLICY),
        (a.chain_only and a.sample_signatures is not None, messages.U_TWO_POLICIES),
        (a.chain_only and anchors, messages.U_CHAIN_ONLY),
        (a.sample_signatures is not None and a.sample_signatures < 1, messages.U_SAMPLE_0),
        (a.strict and a.keystore is not None, messages.U_STRICT_KEYSTORE),
        (a.strict and a.trusted_pubkey is None, messages.U_STRICT_PIN),
        (a.strict and a.expected_root is None, messages.U_STRICT_ROOT),
    ]
    for wrong, text in refused:
        if wrong:
            raise UsageError(text)


def verify(spark: SparkSession, a: argparse.Namespace) -> bool:
    _conflicts(a)
    if a.strict:
        report = strict.verify_directory(spark, a.wal, a.trusted_pubkey, a.expected_root, a.manifest_version)
        _emit(report, a)
        if report.status == "error":
            raise UsageError(report.error or "strict verification could not run")
        return report.status == "valid"
    pin = a.trusted_pubkey
    if pin is not None:
        pin = record.normalized_anchor(pin)
        if record.unhex(pin, 32) is None:
            raise UsageError(messages.U_PIN.format(given=json.dumps(a.trusted_pubkey)))
    policy = dg.NONE if a.chain_only else dg.sample(a.sample_signatures) if a.sample_signatures is not None else dg.ALL
    keystore = Keystore.load(spark, a.keystore) if a.keystore is not None else None
    report = lenient.verify_directory(spark, a.wal, lenient.Options(a.expected_root, keystore, a.fail_fast, pin, policy))
    lenient.profile_hint(report)
    _emit(report, a)
    return report.valid


def _emit(report: reports.LenientReport | reports.StrictReport, a: argparse.Namespace) -> None:
    """To a file always as JSON."""
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(reports.pretty(report))
    elif a.format != "quiet":
        print(reports.pretty(report) if a.format == "json" else report.text())


def inspect(spark: SparkSession, a: argparse.Namespace) -> bool:
    loud = a.format != "quiet"
    if a.stats:
        s = ins.stats(spark, a.wal)
        if loud:
            print(reports.pretty(s))
        return True
    if a.sequence is not None:
        if not 0 <= a.sequence <= record.U64[1]:
            raise UsageError("--sequence must fit 64 bits")
        event = ins.find_event(spark, a.wal, a.sequence)
        if loud:
            print(reports.pretty(event)) if event is not None else print(f"Event with sequence {a.sequence} not found", file=sys.stderr)
        return event is not None
    events = ins.last_events(spark, a.wal, a.last)
    if loud:
        if not events:
            print("No events found in WAL", file=sys.stderr)
        else:
            print(reports.pretty(events) if a.format == "json" else ins.events_table(events))
    return bool(events)


def export(spark: SparkSession, a: argparse.Namespace) -> bool:
    made = ex.Export(spark, a.wal, a.export_format, from_=a.from_, to=a.to, proofs=a.include_proofs, facility=a.syslog_facility)
    sidecar = made.write(a.output) if a.output else None
    if not a.output:
        for line in made:
            sys.stdout.write(line + "\n")
        sys.stdout.flush()
    if a.format != "quiet":
        m = made.manifest
        out = [f"Exported {m.exported_count} records", f"  source_chain_root:      {m.source_chain_root}", f"  filtered_export_digest: {m.filtered_export_digest}"]
        print("\n".join(out + [f"  manifest sidecar:       {sidecar}"] * bool(sidecar)), file=sys.stderr)
    return True


def seed(spark: SparkSession, a: argparse.Namespace) -> bool:
    """A key of one's own is shown once, on the terminal, and written nowhere; so it needs somebody there."""
    if a.non_interactive and a.deterministic_seed is None:
        raise UsageError("--non-interactive requires --deterministic-seed")
    own = os.urandom(32) if a.deterministic_seed is None else seed_of(a.deterministic_seed)
    if not a.non_interactive:
        input(f"The demonstration log goes to {a.output_dir}. Press Enter to continue, Ctrl-C to abort.")
    root = demo.write(spark, a.output_dir, own)
    if not a.non_interactive:
        print(f"Private key, shown once: {own.hex()}", file=sys.stderr)
        input("Press Enter once you have it.")
    if a.format != "quiet":
        print(f"Generated {len(demo.SCENARIO)} records in {a.output_dir}\nChain root: {root}", file=sys.stderr)
    return True


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], bool]] = {"verify": verify, "inspect": inspect, "export": export, "seed": seed}


def run(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    loud = a.format != "quiet"
    try:
        session = spark or SparkSession.builder.appName("chainlens").getOrCreate()
        good = COMMANDS[a.command](session, a)
    except (UsageError, KeystoreError, segments.SegmentError, ins.LogReadError, ex.ExportError, OSError) as e:
        if loud:
            print(f"Error: {e}", file=sys.stderr)
        return 2
    if loud:
        print("OK" if good else "Completed with issues. See output for details.", file=sys.stderr)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
