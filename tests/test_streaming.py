import json
import os

import pytest

from chainlens.functions.ed25519 import SigningKey
from chainlens.operators import digest as dg
from chainlens.operators import seal
from chainlens.plans import lenient, queries
from chainlens.streaming.verifier import OrderError, StreamVerifier


def lines(n, damage=False):
    rows = (seal.payload_record(i, i * 10**9, {"k": i}, event_type="e", hash_alg="blake3" if i != 5 else "other") for i in range(1, n + 1))
    data, root = seal.seal_log(rows, SigningKey(queries.SEED))
    out = data.decode().splitlines()
    if damage:
        out[30] = "not json"
        out[60] = out[60].replace('"event_type":"e"', '"event_type":"x"')
    return out, root


def put(d, name, rows, age):
    (d / name).write_text("\n".join(rows))
    os.utime(d / name, (1_700_000_000 - age, 1_700_000_000 - age))


@pytest.mark.parametrize("damage, fail_fast", [(False, False), (True, False), (True, True)])
def test_stream_equals_batch(spark, tmp_path, damage, fail_fast):
    rows, root = lines(100, damage)
    log = tmp_path / "log"
    log.mkdir()
    options = lenient.Options(expected_root=root, fail_fast=fail_fast, policy=dg.sample(7))
    v = StreamVerifier(spark, str(log), str(tmp_path / "home"), options)
    halted = False
    for k, (name, a, b) in enumerate([("01.wal", 0, 20), ("02.wal", 20, 21), ("03.wal", 21, 70), ("04.jsonl", 70, 100)]):
        put(log, name, rows[a:b], 100 - k)
        if name != "02.wal" and not halted:  # two segments come at once
            try:
                v.start(once=True, max_files=1).awaitTermination()
            except Exception as e:
                assert fail_fast and "StreamHalted" in str(e)
                halted = True
    assert v.report() == lenient.verify_directory(spark, str(log), options)
    assert halted == fail_fast
    assert v.report() == StreamVerifier(spark, str(log), str(tmp_path / "home"), options).report()


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    rows, root = lines(40)
    v = StreamVerifier(spark, "", str(tmp_path), lenient.Options(expected_root=root))
    from chainlens.sources import segments
    from pyspark.sql import functions as F

    batch = lambda name, a, b: segments.scan_bytes(spark, "\n".join(rows[a:b]).encode()).withColumn("name", F.lit(name))
    v.process(batch("a", 0, 17), 0)
    v.process(batch("b", 17, 33), 1)
    v.process(batch("b", 17, 33), 1)
    v.process(batch("c", 33, 40), 2)
    r = v.report()
    assert r.valid and r.events_verified == 40 and r.chain_root == root
    with pytest.raises(OrderError):
        v.process(batch("b", 0, 1), 3)
    assert json.loads(json.dumps(v.state().__dict__))["records"] == 40


def test_a_segment_that_comes_late(spark, tmp_path):
    rows, _ = lines(10)
    log = tmp_path / "log"
    log.mkdir()
    put(log, "02.wal", rows[5:], 5)
    v = StreamVerifier(spark, str(log), str(tmp_path / "home"))
    v.start(once=True).awaitTermination()
    put(log, "01.wal", rows[:5], 1)
    with pytest.raises(Exception, match="came after"):
        v.start(once=True).awaitTermination()
