"""Inspection, export, the command line, and reading logs as tables."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from chainlens import cli
from chainlens.functions import blake3, record, text
from chainlens.functions.ed25519 import SigningKey
from chainlens.operators import export, inspect, records, root, seal
from chainlens.plans import queries
from chainlens.sources import keystore, segments

KEY = SigningKey(queries.SEED)


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """Ten signed records in three segments, with what is hard to export."""
    kinds = ["pay", '=cmd|"x"', "+SUM(1)", "a\nb", "a b", "q\"u\\o", None, "\ttab", "x\x01y", "-1,2"]
    rows = (seal.payload_record(i + 1, 1_700_000_000_000_000_000 + i * 10**9 + (i % 3) * 1000, {"k": i, "f": "é"}, event_type=kinds[i], source=["s 1", "", None, "@x"][i % 4], event_id=f"e{i}", stream_id=["b", "a"][i % 2]) for i in range(10))
    data, expected = seal.seal_log(rows, KEY)
    d = tmp_path_factory.mktemp("log")
    lines = data.decode().split("\n")[:-1]
    for n, (a, b) in enumerate([(0, 4), (4, 5), (5, 10)]):
        (d / f"{n:02d}.jsonl").write_text("\n".join(lines[a:b]))
    return d, [json.loads(x) for x in lines], expected


def run(spark, capsys, *argv):
    code = cli.run([str(a) for a in argv], spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_stats(spark, log, capsys):
    d, rows, _ = log
    code, out, _ = run(spark, capsys, "inspect", "-w", d, "--stats")
    s = json.loads(out)
    assert code == 0
    assert s == {"segment_count": 3, "total_events": 10, "first_sequence": 1, "last_sequence": 10, "first_timestamp_ns": rows[0]["timestamp_ns"], "last_timestamp_ns": rows[-1]["timestamp_ns"], "total_size_bytes": sum(p.stat().st_size for p in d.iterdir()), "has_signatures": True, "integrity": {"prev_hash_links_ok": True, "sequence_contiguous": True, "timestamps_monotonic": True, "all_signed": True}, "stream_ids": ["a", "b"], "events_with_receipt": 0, "events_without_receipt": 10, "is_sdk_format": True}


def test_stats_of_other_logs(spark, log, tmp_path, capsys):
    empty = tmp_path / "empty"
    empty.mkdir()
    s = inspect.stats(spark, str(empty))
    assert (s["total_events"], s["first_sequence"], s["has_signatures"], set(s["integrity"].values())) == (0, None, False, {False})
    (empty / "a.wal").write_text("\n" + json.dumps({"seq": 2, "ts": 5, "prev": "0" * 64, "hash": "h"}) + "\n" + json.dumps({"seq": 1, "ts": 4, "prev": "x", "hash": "h"}))
    s = inspect.stats(spark, str(empty))
    assert (s["total_events"], list(s["integrity"].values()), s["stream_ids"]) == (2, [False, False, False, False], [])
    (empty / "b.wal").write_text("\n\nnope\n")
    code, _, err = run(spark, capsys, "inspect", "-w", empty, "--stats")
    assert code == 2 and "b.wal line 3" in err


def test_find(spark, log, capsys, tmp_path):
    d, rows, _ = log
    code, out, _ = run(spark, capsys, "inspect", "-w", d, "--sequence", 6)
    assert code == 0 and json.loads(out) == rows[5]
    assert run(spark, capsys, "inspect", "-w", d, "--sequence", 999)[0] == 1
    line = lambda s: json.dumps({"seq": s, "ts": 1, "prev": "p", "hash": "h"})
    (tmp_path / "a.wal").write_text("\n".join(map(line, (1, 5, 3))))
    assert inspect.find_event(spark, str(tmp_path), 3) is None  # a greater one comes first
    assert inspect.find_event(spark, str(tmp_path), 5)["sequence"] == 5
    (tmp_path / "b.wal").write_text("nope")
    with pytest.raises(inspect.LogReadError, match="line 1"):
        inspect.find_event(spark, str(tmp_path), 5)


def test_last(spark, log, capsys):
    d, rows, _ = log
    code, out, _ = run(spark, capsys, "--format", "json", "inspect", "-w", d, "-n", 6)
    shown = json.loads(out)
    assert code == 0 and [e["sequence"] for e in shown] == [5, 6, 7, 8, 9, 10]
    assert shown[2]["event_type"] == "-" and shown[2]["payload_hash_short"] == rows[6]["payload_hash"][:16] + "..."
    assert shown[1]["timestamp"] == "2023-11-14T22:13:25.000002+00:00"
    table = inspect.display(records.read_log(spark, str(d)).where("sequence >= 5")).orderBy("sequence").collect()
    assert [r.asDict() | {"sequence": int(r["sequence"])} for r in table] == shown
    assert inspect.last_events(spark, str(d), 0) == []
    assert run(spark, capsys, "inspect", "-w", d)[1].splitlines()[1].startswith("     SEQ |")


def test_jsonl(spark, log, tmp_path, capsys):
    d, rows, expected = log
    out = tmp_path / "out.jsonl"
    code, _, err = run(spark, capsys, "export", "-w", d, "-o", out)
    lines = [json.loads(x) for x in out.read_text().splitlines()]
    assert code == 0 and "Exported 10 records" in err
    assert lines[:-1] == rows and list(lines[0]) == sorted(lines[0])
    assert lines[-1] == {"kind": export.KIND, "exported_count": 10, "source_chain_root": expected, "filtered_export_digest": expected, "from": None, "to": None}
    assert json.loads((tmp_path / "out.jsonl.manifest.json").read_text()) == lines[-1]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out.jsonl", "out.jsonl.manifest.json"]


def test_filter_and_proofs(spark, log, capsys):
    d, rows, expected = log
    code, out, _ = run(spark, capsys, "export", "-w", d, "--from", "2023-11-14T22:13:22Z", "--to", "2023-11-14T23:13:27+01:00", "--include-proofs")
    lines = [json.loads(x) for x in out.splitlines()]
    hashes = [blake3.hexdigest(record.entry_message(record.Record(**r))) for r in rows]
    assert [x["sequence"] for x in lines[:-1]] == [3, 4, 5, 6, 7]
    assert [x["entry_hash"] for x in lines[:-1]] == hashes[2:7]
    assert lines[-1]["source_chain_root"] == expected
    assert lines[-1]["filtered_export_digest"] == blake3.hexdigest("".join(hashes[2:7]).encode())
    assert lines[-1]["from"] == "2023-11-14T22:13:22Z"


def test_csv(spark, log, tmp_path, capsys):
    d, rows, _ = log
    out = tmp_path / "out.csv"
    assert run(spark, capsys, "export", "-w", d, "-o", out, "--export-format", "csv")[0] == 0
    got = list(csv.reader(io.StringIO(out.read_text(), newline="")))
    safe = lambda x: ("'" if x[:1] in tuple("=+-@\t\r") and x else "") + x
    assert got == [[str(r["sequence"]), safe(str(r["timestamp_ns"])), safe(r["event_type"] or ""), safe(r["source"] or ""), r["payload_hash"], r["prev_hash"], "yes"] for r in rows]
    assert (tmp_path / "out.csv.manifest.json").exists()


def test_syslog(spark, log, tmp_path, capsys):
    d, rows, _ = log
    code, out, _ = run(spark, capsys, "export", "-w", d, "--export-format", "syslog", "--syslog-facility", 1)
    lines = out.split("\n")[:-1]
    assert code == 0 and len(lines) == 10
    assert lines[3] == f'<14>1 2023-11-14T22:13:23+00:00 @x chainlens 4 a_b - msg="seq=4 type=a\\nb hash={rows[3]["payload_hash"][:16]}"'
    assert 'chainlens 6 quo - msg="seq=6 type=q\\"u\\\\o' in lines[5] and " 7 - - msg" in lines[6] and "type=x\\x01y" in lines[8]
    assert lines[1].split()[2] == "-"
    target = tmp_path / "out.log"
    run(spark, capsys, "export", "-w", d, "--export-format", "syslog", "--syslog-facility", 1, "-o", target)
    assert target.read_text() == out


@pytest.mark.parametrize("argv", [["--from", "2024-01-02T00:00:00Z", "--to", "2024-01-01T00:00:00Z"], ["--syslog-facility", "99"], ["--from", "yesterday"], ["--from", "2024-01-01T00:00:00"]])
def test_export_refuses(spark, log, capsys, argv):
    assert run(spark, capsys, "export", "-w", log[0], *argv)[0] == 2


def test_nothing_is_published_for_a_bad_log(spark, tmp_path, capsys):
    (tmp_path / "a.wal").write_text(json.dumps({"seq": 1, "ts": 1, "prev": "p", "hash": "h"}) + "\nnope\n")
    code, _, err = run(spark, capsys, "export", "-w", tmp_path, "-o", tmp_path / "out.jsonl")
    assert code == 2 and "a.wal line 2" in err and not list(tmp_path.glob("out*"))
    (tmp_path / "a.wal").write_bytes(b'{"seq":1,"ts":1,"prev":"p","hash":"\xff"}')
    code, _, err = run(spark, capsys, "export", "-w", tmp_path)
    assert code == 2 and "did not contain valid UTF-8" in err


@pytest.mark.parametrize("argv", [["--strict", "--chain-only"], ["--strict", "--sample-signatures", "2"], ["--chain-only", "--sample-signatures", "2"], ["--chain-only", "--trusted-pubkey", "ab" * 32], ["--chain-only", "--keystore", "k"], ["--sample-signatures", "0"], ["--strict", "--keystore", "k"], ["--strict"], ["--strict", "--trusted-pubkey", "ab" * 32], ["--trusted-pubkey", "zz"], ["--keystore", "/nowhere.json"], ["--strict", "--trusted-pubkey", "zz", "--expected-root", "ab" * 32]])
def test_verify_usage_errors(spark, log, capsys, argv):
    code, _, err = run(spark, capsys, "verify", "-w", log[0], *argv)
    assert code == 2 and err.startswith("Error: ")


def test_verify_command(spark, log, tmp_path, capsys):
    d, _, expected = log
    code, out, err = run(spark, capsys, "verify", "-w", d, "--expected-root", "0x" + expected, "--trusted-pubkey", KEY.public.hex())
    assert (code, err) == (0, "OK\n") and "Status: VALID" in out and "Sequence range:      1..=10" in out
    target = tmp_path / "r.json"
    code, out, err = run(spark, capsys, "-f", "quiet", "verify", "-w", d, "--expected-root", "1" * 64, "-o", target)
    assert (code, out, err) == (1, "", "") and not json.loads(target.read_text())["valid"]
    code, out, _ = run(spark, capsys, "-f", "json", "verify", "-w", d, "--chain-only")
    report = json.loads(out)
    assert (code, report["signatures_verified"], report["signatures_skipped"]) == (0, 0, 10)
    assert run(spark, capsys, "verify", "-w", d / "missing")[0] == 2
    assert run(spark, capsys, "verify")[0] == 2
    code, out, _ = run(spark, capsys, "verify", "-w", d, "--strict", "--trusted-pubkey", KEY.public.hex(), "--expected-root", expected)
    assert code == 1 and "invalid: signature_verification_failed" in out


def test_keystores(spark, tmp_path):
    f = tmp_path / "k.json"
    good = {"schema": keystore.SCHEMA, "keys": {"b": KEY.public.hex(), "a": KEY.public.hex().upper()}}
    f.write_text(json.dumps(good))
    k = keystore.Keystore.load(spark, str(f))
    assert list(k) == ["a", "b"] and len(k) == 2 and not k.is_empty() and k["a"] == KEY.public
    assert k.frame(spark).count() == 2
    for bad in ({"schema": "v2", "keys": {}}, {"keys": {}}, good | {"keys": {"a": "ab"}}, good | {"keys": {"a": "zz" * 32}}, good | {"keys": {"a": "02" + "00" * 31}}, good | {"keys": {"a": 1}}, "x"):
        with pytest.raises(keystore.KeystoreError):
            keystore.Keystore.from_json(json.dumps(bad).encode())
    with pytest.raises(keystore.KeystoreError):
        keystore.Keystore.from_json(b"{")


def test_segment_names():
    assert segments.select_segments(["b.wal", "a.jsonl", "c.txt", "batch_ledger.jsonl", "d"]) == ["a.jsonl", "b.wal"]
    assert segments.select_segments(["001.wal", "010.wal", "100.wal"]) == ["001.wal", "010.wal", "100.wal"]
    for names in (["1.wal", "10.wal"], ["_a.wal"], [".a.jsonl"]):
        with pytest.raises(segments.SegmentError):
            segments.select_segments(names)


def test_odd_paths(spark, tmp_path):
    d = tmp_path / "a b[1]{x}"
    d.mkdir()
    (d / "s p?.wal").write_text(json.dumps({"seq": 1, "ts": 1, "prev": "0" * 64, "hash": "h"}))
    assert inspect.stats(spark, str(d))["total_events"] == 1


def test_read_log_as_a_table(spark, log):
    d, rows, expected = log
    t = records.read_log(spark, str(d), hashes=True)
    assert t.where(F.get_json_object("payload", "$.k").cast("int") > 6).count() == 3
    assert root.chain_root_of(t, "sequence", "entry_hash") == expected
    assert root.chain_root_of(t, "sequence", "entry_hash", rows=3) == expected
    with pytest.raises(ValueError, match="not consecutive"):
        root.chain_root_of(t.where("sequence <> 4"), "sequence", "entry_hash")


def test_times_do_not_depend_on_the_zone(spark):
    ns = [0, -1, -(2**63), 2**63 - 1, 1_500_000_000, 1_700_000_000_123_456_789, -999_000_000]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = spark.createDataFrame([(n,) for n in ns], "n long").select(text.rfc3339(F.col("n")).alias("t")).collect()
            assert [r["t"] for r in got] == [inspect.rfc3339(n) for n in ns]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got[0]["t"] == "1970-01-01T00:00:00+00:00" and got[1]["t"] == "1969-12-31T23:59:59.999999999+00:00"


def test_amounts(spark):
    line = '{"a":{"amount":"1.00"},"amount":"2.00"}'
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(text.rewrite_amount(F.col("l"), "9$\\1")).first()[0] == '{"a":{"amount":"9$\\1"},"amount":"2.00"}'
    with pytest.raises(Exception, match="amount"):
        df.select(text.rewrite_amount(F.lit("{}"), "9")).collect()
