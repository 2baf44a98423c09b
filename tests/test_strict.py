import json

import pytest

from chainlens import cli
from chainlens.functions import seeds
from chainlens.functions.ed25519 import SigningKey
from chainlens.operators import seal
from chainlens.plans import demo, lenient, queries, reports, strict
from chainlens.sources import manifest

KEY = SigningKey(queries.SEED)
PIN = KEY.public.hex()


def test_damaged_logs(spark):
    rows = {r["name"]: r for r in queries.strict_tamper_matrix(spark, "").collect()}
    for name, status, records, last in queries._STRICT:
        assert (rows[name]["status"], rows[name]["records"], rows[name]["last"]) == (status, records, last), name


def test_blocks_change_nothing(spark):
    log, root = queries.small_log(30, "strict")
    for at, change in ((None, {}), (17, {"timestamp_ns": 1}), (9, {"sequence": 3}), (12, {"prev_hash": "A" * 64}), (20, {"payload_hash": "0" * 64}), (29, {"source": "x"})):
        rows = [r | change if i == at else r for i, r in enumerate(log)]
        found = [strict.verify_bytes(spark, queries.to_bytes(rows), PIN, root, 1, parts) for parts in (1, 4, 31)]
        assert found[0] == found[1] == found[2]
        assert found[0].events_verified == (30 if at is None else at)
        assert [r["sequence"] for r in found[0].records[:-1]] == list(range(1, len(found[0].records)))


def test_root_equals_the_lenient_one(spark):
    log, root = queries.small_log(20, "strict")
    data = queries.to_bytes(log)
    s = strict.verify_bytes(spark, data, PIN, root, 7)
    assert s.status == "valid" and s.manifest_version_used == 7 and s.wal_format_version_seen == 1
    assert s.chain_root == lenient.verify_bytes(spark, data).chain_root == root


def test_reasons(spark):
    log, root = queries.small_log(3, "strict")
    run = lambda rows: strict.verify_bytes(spark, queries.to_bytes(rows), PIN, root).records[-1]
    assert run([log[0], "", "{", log[2]]) == {"sequence": 2, "outcome": "rejected", "reason": {"kind": "parse_error", "line": 3, "details": "Expecting property name enclosed in double quotes at column 2"}}
    assert run([log[1]])["reason"] == {"kind": "invalid_genesis", "expected": "sequence=1", "found": "sequence=2"}
    assert run([log[0] | {"format_version": 999}])["reason"] == {"kind": "unsupported_format_version", "found": 999}
    assert run([log[0] | {"signature": "ab"}])["reason"] == {"kind": "signature_malformed", "details": "expected 128 hex chars, got 2"}
    assert run([log[0] | {"public_key": "g" * 64}])["reason"]["kind"] == "pubkey_malformed"
    assert run([log[0] | {"seq": 1}])["reason"]["kind"] == "parse_error"


def test_wrong_root_and_bad_arguments(spark):
    log, root = queries.small_log(2, "strict")
    data = queries.to_bytes(log)
    r = strict.verify_bytes(spark, data, PIN, "1" * 64)
    assert r.error == f"chain_root mismatch: expected {'1' * 64}, computed {root}"
    r = strict.verify_bytes(spark, data, PIN[:10], root)
    assert (r.status, r.error, r.expected_pubkey_fp) == ("error", "expected_pubkey not valid 32-byte hex: expected 64 hex chars, got 10", PIN[:10] + "000000")
    r = strict.verify_bytes(spark, data, "02" + "00" * 31, root)
    assert r.error == "expected_pubkey is not a valid Ed25519 verifying key"
    assert strict.verify_bytes(spark, data, PIN, "ab").error == "expected_root must be 64 hex chars (with optional 0x prefix), got 2 chars after stripping"


def test_time_text_is_an_option(spark):
    log, root = queries.small_log(1, "strict")
    rows = [{"timestamp_ns" if k == "timestamp_ns" else k: "2023-11-14T22:13:21Z" if k == "timestamp_ns" else v for k, v in log[0].items()}]
    assert strict.verify_bytes(spark, queries.to_bytes(rows), PIN, root).status == "valid"
    assert strict.verify_bytes(spark, queries.to_bytes(rows), PIN, root, iso=False).records[-1]["reason"]["kind"] == "parse_error"


def test_too_many_records(spark, monkeypatch):
    monkeypatch.setattr(strict, "MAX_RECORDS", 10)
    log, root = queries.small_log(13, "strict")
    for parts in (1, 4, 14):
        r = strict.verify_bytes(spark, queries.to_bytes(log), PIN, root, 1, parts)
        assert r.status == "invalid" and r.events_verified == 10
        assert r.records[-1] == {"sequence": 11, "outcome": "rejected", "reason": {"kind": "too_many_records", "limit": 10}}
    assert strict.verify_bytes(spark, queries.to_bytes(log[:10]), PIN, root, 1, 3).events_verified == 10


def test_caps_and_envelope(spark):
    got = {r["name"]: (r["status"], r["kind"]) for r in queries.strict_caps(spark, "").collect()}
    assert got == {n: (s, k) for n, s, k in queries._CAPS}
    log, root = queries.small_log(1, "strict")
    report = strict.verify_bytes(spark, queries.to_bytes(log), PIN, root)
    assert json.loads(reports.envelope(report)) == {"ok": True, "report": report.as_dict()}
    assert list(report.as_dict()) == ["status", "verifier_version", "wal_format_version_seen", "manifest_version_used", "events_verified", "signatures_verified", "expected_pubkey_fp", "chain_root", "records", "error"]
    assert "Status: VALID" in report.text()


def test_sealing_many_chains(spark):
    rows = [(f"c{c}", t, "e", None, json.dumps({"t": t})) for c in range(5) for t in (3, 1, 2)]
    events = spark.createDataFrame(rows, "chain string, ts long, event_type string, source string, payload string")
    got = seal.seal_chains(events, queries.SEED, "strict").orderBy("chain", "sequence").collect()
    for c in range(5):
        own = [r for r in got if r["chain"] == f"c{c}"]
        assert [json.loads(r["line"])["payload"]["t"] for r in own] == [1, 2, 3]
        root = seal.Sealer().root
        import numpy as np

        root.extend(np.frombuffer(b"".join(bytes.fromhex(r["entry_hash"]) for r in own), np.uint8).reshape(-1, 32))
        report = strict.verify_bytes(spark, "\n".join(r["line"] for r in own).encode(), PIN, root.digest().hex())
        assert report.status == "valid", report


def test_seeds_have_32_bytes():
    with pytest.raises(ValueError):
        SigningKey(b"short")


def test_seeds_from_numbers():
    # Fixed values of RFC 8439, 2.3.2, whose counter and nonce are laid out as here.
    block = seeds.chacha20_block(bytes(range(32)), 1 | 0x09000000 << 32, 0x4A000000)
    assert block[:16].hex() == "10f1e7e4d13b5915500fdd1fa32071c4"
    assert seeds.seed_of(42) != seeds.seed_of(43) and len(seeds.seed_of(2**64 - 1)) == 32


def test_demonstration_log(spark, tmp_path, capsys):
    d = tmp_path / "out"
    assert cli.run(["seed", "--output-dir", str(d), "--non-interactive"], spark) == 2
    assert cli.run(["seed", "--output-dir", str(d), "--non-interactive", "--deterministic-seed", "42"], spark) == 0
    assert sorted(p.name for p in d.iterdir() if p.name[0] != ".") == ["demo-manifest.json", "demo.expected_root", "demo.jsonl", "demo.pubkey"]
    root = (d / "demo.expected_root").read_text().strip()
    assert root.startswith("c36bd135f17fbd48")  # Fixed value: the published fixture's root
    assert demo.verify(spark, str(d / "demo-manifest.json"), str(d / "demo.jsonl")).status == "valid"
    (d / ".demo.jsonl.crc").unlink()  # else the local file system itself refuses changed bytes
    (d / "demo.jsonl").write_text((d / "demo.jsonl").read_text().replace("100.00", "900.00"))
    with pytest.raises(manifest.ManifestError, match="pins"):
        demo.verify(spark, str(d / "demo-manifest.json"), str(d / "demo.jsonl"))
    for bad in (b"{", b"{}", b'{"schema_version":2}', b'{"schema_version":1}'):
        with pytest.raises(manifest.ManifestError):
            manifest.Manifest.from_json(bad)
    capsys.readouterr()


def test_envelopes_of_host_pages(spark):
    log, root = queries.small_log(2, "strict")
    data = queries.to_bytes(log)
    assert json.loads(strict.verify_bytes_json(spark, data, PIN, root))["report"]["status"] == "valid"
    for blank in (None, "", "  "):
        assert json.loads(lenient.verify_bytes_json(spark, data, blank))["report"]["warnings"]
    assert json.loads(lenient.verify_bytes_json(spark, data, "1" * 64))["report"]["errors"][-1]["error_type"] == "root_mismatch"
