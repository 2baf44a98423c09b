import json
import random

import pytest

from chainlens.functions import messages, record
from chainlens.functions.ed25519 import SigningKey
from chainlens.operators import digest as dg
from chainlens.operators import seal
from chainlens.plans import lenient, queries
from chainlens.plans import vectors as V
from chainlens.sources.keystore import Keystore
from sequential import as_loop, verify

KEY = SigningKey(queries.SEED)


def same(spark, data, *, parts=1, policy=dg.ALL, pin=None, keystore=None, fail_fast=False):
    options = lenient.Options(keystore=keystore, fail_fast=fail_fast, trusted_pubkey=pin, policy=policy)
    from chainlens.sources import segments

    report = lenient.verify_scan(segments.scan_bytes(spark, data, parts), options)
    want = verify(data, selects=policy.selects, pin=bytes.fromhex(pin) if pin else None, keystore=keystore, fail_fast=fail_fast)
    got = as_loop(report)
    assert got == {k: want[k] for k in got}
    return report


def test_damaged_logs(spark):
    rows = {r["name"]: r for r in queries.lenient_tamper_matrix(spark, "").collect()}
    for name, valid, events, kinds in queries._LENIENT:
        assert (rows[name]["valid"], rows[name]["events"], rows[name]["error_types"]) == (valid, events, kinds), name


def damaged(rng, n):
    """A log with damages of all kinds here and there, and receipts."""
    rows, _ = queries.small_log(n)
    out = []
    for r in rows:
        r = dict(r)
        if rng.random() < 0.3:
            r["event_id"] = "e"
            r["receipt"] = queries._receipt(KEY) | ({"payload_hash": r["payload_hash"]} if rng.random() < 0.5 else {})
            if rng.random() < 0.5:
                r["receipt"]["receipt_sig"] = KEY.sign(record.receipt_message(r["receipt"])).hex()
            if rng.random() < 0.2:
                r["receipt"][rng.choice(["server_key_id", "sig_alg", "receipt_sig"])] = "zz"
        kind = rng.choice(["", "", "", "", "", "link", "gap", "time", "sig", "nokey", "upper", "alg", "unsigned", "line", "blank"])
        if kind == "link":
            r["prev_hash"] = "f" * 64
        elif kind == "gap":
            r["sequence"] += 5
        elif kind == "time":
            r["timestamp_ns"] -= 5 * 10**9
        elif kind == "sig":
            r["signature"] = "0" * 128
        elif kind == "nokey":
            del r["public_key"]
        elif kind == "upper":
            r["payload_hash"] = r["payload_hash"].upper()
        elif kind == "alg":
            r["hash_alg"] = "sha256"
        elif kind == "unsigned":
            r["signature"] = r["public_key"] = None
        out.append("not json" if kind == "line" else "" if kind == "blank" else r)
    return queries.to_bytes(out)


@pytest.mark.parametrize("driver_blocks", [dg.DRIVER_BLOCKS, 0])
@pytest.mark.parametrize("seed", range(6))
def test_as_the_loop_does(spark, seed, driver_blocks, monkeypatch):
    monkeypatch.setattr(dg, "DRIVER_BLOCKS", driver_blocks)  # places by the loop, and by windows
    rng = random.Random(seed)
    data = damaged(rng, 40)
    if seed % 2:
        data = data.replace(b"\n", b"\r\n")
    options = [{}, {"policy": dg.NONE}, {"policy": dg.sample(3)}, {"pin": KEY.public.hex()}, {"keystore": Keystore.from_keys([("k", KEY.public)])}, {"pin": V.PUBLIC}][seed]
    reports = [same(spark, data, parts=p, **options) for p in (1, 9)]
    assert reports[0] == reports[1]
    same(spark, data, parts=5, fail_fast=True, **options)


def test_fail_fast_counts_what_was_checked_before(spark):
    log, _ = queries.small_log(4)
    keys = Keystore.from_keys([("k", KEY.public)])
    log[2]["receipt"] = queries._receipt(KEY)
    r = same(spark, queries.to_bytes(log), parts=2, fail_fast=True, keystore=keys)
    assert (r.events_verified, r.signatures_verified, r.last_sequence) == (2, 3, 3)
    r = same(spark, queries.to_bytes([*log[:2], "", "bad", *log[2:]]), parts=6, fail_fast=True)
    assert (r.events_verified, r.last_sequence, r.errors[0]["details"][:7]) == (2, 2, "line 4:")
    r = same(spark, b"bad\n", fail_fast=True)
    assert (r.events_verified, r.first_sequence) == (0, None)


def test_largest_sequence(spark):
    line = lambda s: {"seq": s, "ts": 1, "prev": "0" * 64, "hash": "a" * 64}
    r = same(spark, queries.to_bytes([line(2**64 - 1), line(5)]), parts=3)
    assert [e["error_type"] for e in r.errors] == ["invalid_genesis", "chain_break", "sequence_gap"]
    assert r.first_sequence == 2**64 - 1
    assert "expected sequence 18446744073709551615 after 18446744073709551615, found 5" == r.errors[2]["details"]


def test_anchors_and_warnings(spark):
    log, root = queries.small_log(2)
    data = queries.to_bytes(log)
    run = lambda **o: lenient.verify_bytes(spark, data, lenient.Options(**o))
    assert run(expected_root=f" 0X{root.upper()} ").valid
    for blank in ("   ", "\t", "0x", "  0X  "):
        r = run(expected_root=blank)
        assert r.valid and r.warnings[0] == messages.W_NO_ROOT
    r = run(trusted_pubkey="zz", expected_root=root)
    assert r.valid and r.warnings == [messages.W_BAD_PIN.format(why="expected 64 hex chars, got 2")]
    r = lenient.verify_bytes(spark, b"", lenient.Options(expected_root=root))
    assert not r.valid and r.errors[0]["error_type"] == "root_mismatch" and r.warnings == [messages.W_EMPTY]


def test_strict_log_under_lenient_has_a_hint(spark):
    log, _ = queries.small_log(3, "strict")
    r = lenient.verify_bytes(spark, queries.to_bytes(log))
    assert not any("--strict" in w for w in r.warnings)
    lenient.profile_hint(r)
    assert r.warnings[-1] == messages.W_PROFILE


def write(directory, rows, cuts, newline=True):
    lines = [json.dumps(r) if not isinstance(r, str) else r for r in rows]
    for name, (a, b) in cuts.items():
        (directory / name).write_text("\n".join(lines[a:b]) + "\n" * newline)


def test_segments_and_splits_change_nothing(spark, tmp_path):
    rows = (seal.payload_record(i, i * 10**9, {"k": i, "t": "é" * (i % 7)}, event_type="e") for i in range(1, 402))
    data, root = seal.seal_log(rows, None)
    log = data.decode().splitlines()
    log[200] = log[200].replace('"k":201', '"k": 201')  # the payload is not in the hash
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir(), many.mkdir()
    write(one, log, {"a.jsonl": (0, 401)})
    write(many, log, {"01.wal": (0, 3), "02.wal": (3, 3), "03.jsonl": (3, 300), "04.wal": (300, 401)}, newline=False)
    (many / "batch_ledger.jsonl").write_text("not a segment")
    (many / "readme.txt").write_text("nor this")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    reports = []
    try:
        for size in ("128m", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            reports += [lenient.verify_directory(spark, str(d), lenient.Options(expected_root=root)) for d in (one, many)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r == reports[0] for r in reports) and reports[0].valid and reports[0].events_verified == 401


def test_parse_errors_have_the_line_in_the_whole_log(spark, tmp_path):
    write(tmp_path, ["", "x", ""], {"01.wal": (0, 3)})
    write(tmp_path, ["y"], {"02.wal": (0, 1)})
    r = lenient.verify_directory(spark, str(tmp_path))
    assert [e["details"].split(":")[0] for e in r.errors] == ["line 2", "line 4"]
    assert r.warnings == [messages.W_EMPTY]


def test_errors_as_a_frame(spark):
    from chainlens.sources import segments

    v = lenient.LenientVerification(segments.scan_bytes(spark, b"x\n" * 50, 7))
    r = v.report(most=3)
    assert not r.valid and [e["details"].split(":")[0] for e in r.errors] == ["line 1", "line 2", "line 3"]
    assert messages.W_MORE.format(listed=3, total=50) in r.warnings
    assert v.errors.where("error_type = 'parse_error'").count() == 50
    assert sorted(e["line"] for e in v.errors.collect()) == list(range(50))
    v.digest.release()
