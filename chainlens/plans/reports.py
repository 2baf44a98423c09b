"""Reports as plain values, and their texts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any


@dataclass
class LenientReport:
    """Fields are in the order of the JSON report."""

    valid: bool = True
    events_verified: int = 0
    signatures_verified: int = 0
    signatures_skipped: int = 0
    receipts_verified: int = 0
    chain_root: str = ""
    first_sequence: int | None = None
    last_sequence: int | None = None
    first_timestamp: int | None = None
    last_timestamp: int | None = None
    errors: list[dict[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    halted_early: bool = False

    def as_dict(self) -> dict[str, Any]:
        return dict(self.__dict__)

    def text(self) -> str:
        out = [f"Status: {'VALID' if self.valid else 'INVALID'}"]
        if self.halted_early:
            out.append("(stopped early under --fail-fast; subsequent records were not inspected)")
        out += [f"Events verified:     {self.events_verified}", f"Signatures verified: {self.signatures_verified}"]
        if self.signatures_skipped:
            out.append(f"Signatures skipped:  {self.signatures_skipped}")
        out.append(f"Receipts verified:   {self.receipts_verified}")
        if self.first_sequence is not None and self.last_sequence is not None:
            out.append(f"Sequence range:      {self.first_sequence}..={self.last_sequence}")
        if self.chain_root:
            out.append(f"Chain root:          {self.chain_root[:16]}...")
        if self.errors:
            out += ["", "Errors:", *(f"  [seq {'-' if e['sequence'] is None else e['sequence']}] {e['error_type']}: {e['details']}" for e in self.errors)]
        if self.warnings:
            out += ["", "Warnings:", *(f"  {w}" for w in self.warnings)]
        return "\n".join(out)


class Outcomes(Sequence):
    """An entry a record: valid ones, which are made as they are asked for, however many there are, and the failure that ends a run."""

    def __init__(self, valid: int = 0, failure: dict[str, Any] | None = None):
        self.valid, self.failure = valid, failure

    def __len__(self) -> int:
        return self.valid + (self.failure is not None)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        i = range(len(self))[at]
        return {"sequence": i + 1, "outcome": "valid"} if i < self.valid else self.failure

    def __eq__(self, other: object) -> bool:
        if isinstance(other, Outcomes):
            return (self.valid, self.failure) == (other.valid, other.failure)
        return isinstance(other, Sequence) and list(self) == list(other)

    def __repr__(self) -> str:
        return f"Outcomes({self.valid}, {self.failure})"


@dataclass
class StrictReport:
    status: str = "valid"
    verifier_version: str = ""
    wal_format_version_seen: int = 0
    manifest_version_used: int = 1
    events_verified: int = 0
    signatures_verified: int = 0
    expected_pubkey_fp: str = ""
    chain_root: str = ""
    records: Sequence[dict[str, Any]] = field(default_factory=Outcomes)
    error: str | None = None

    def as_dict(self) -> dict[str, Any]:
        return self.__dict__ | {"records": list(self.records)}

    def text(self) -> str:
        out = [f"Status: {self.status.upper()}", "Profile:             strict", f"Verifier version:    {self.verifier_version}", f"Events verified:     {self.events_verified}", f"Signatures verified: {self.signatures_verified}", f"Expected pubkey fp:  {self.expected_pubkey_fp}"]
        if self.chain_root:
            out.append(f"Chain root:          {self.chain_root[:16]}...")
        if self.error:
            out += ["", f"Error: {self.error}"]
        if problems := [r for r in self.records if r["outcome"] != "valid"]:
            out += ["", "Records with issues:", *(f"  [seq {r['sequence']}] {outcome_text(r)}" for r in problems)]
        return "\n".join(out)


def outcome_text(entry: dict[str, Any]) -> str:
    """outcome: kind of its reason."""
    kind = (entry.get("reason") or {}).get("kind")
    return f"{entry['outcome']}: {kind}" if kind else entry["outcome"]


def compact(report: LenientReport | StrictReport) -> str:
    return json.dumps(report.as_dict(), ensure_ascii=False, separators=(",", ":"))


def pretty(value: Any) -> str:
    return json.dumps(value.as_dict() if hasattr(value, "as_dict") else value, ensure_ascii=False, indent=2)


def blank_is_none(root: str | None) -> str | None:
    """A root as a host page gives it: blank text means that there is none."""
    return root.strip() or None if root is not None else None


def envelope(report: LenientReport | StrictReport) -> str:
    """The report in the envelope that a host page takes."""
    try:
        return f'{{"ok":true,"report":{compact(report)}}}'
    except (TypeError, ValueError) as e:
        return f'{{"ok":false,"error":{{"kind":"ReportSerializationFailed","message":{json.dumps(str(e), ensure_ascii=False)}}}}}'
