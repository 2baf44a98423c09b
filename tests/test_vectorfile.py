import pytest
from pyspark.sql import functions as F

from chainlens.functions import sql
from chainlens.plans import vectorfile
from chainlens.plans import vectors as V
from chainlens.sources import vectors


@pytest.fixture(scope="module")
def sections(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors") / "vectors.json"
    path.write_bytes(vectorfile.make())
    return vectors.load(spark, str(path))


def test_made_vectors_are_the_published_ones(sections):
    rows = {k: v.collect() for k, v in sections.items()}
    assert [(r.name, r.expected_canonical_json_utf8, r.expected_payload_hash_blake3) for r in rows["canonical_json"]] == [(n, c, h) for n, _, c, h in V.CANONICAL]
    assert [(r.name, r.expected_entry_hash) for r in rows["entry_hash"]] == [(r[0], r[9]) for r in V.ENTRY]
    assert [(r.name, r.expected_sign_hash) for r in rows["sign_hash"]] == [(r[0], r[9]) for r in V.SIGN]
    assert [(r.expected_entry_hashes, r.expected_root) for r in rows["chain_root"]] == [([r[4] for r in V.CHAIN], V.CHAIN_ROOT)]
    assert [(r.name, r.expected_canonical_message_hex) for r in rows["receipt_canonical_message"]] == [(r[0], r[8].encode().hex()) for r in V.RECEIPT]
    assert [(r.profile, r.signature_hex) for r in rows["signature"]] == [(p, s) for p, _, s in V.SIGNATURES]
    assert {r.public_key_hex for r in rows["signature"]} == {V.PUBLIC}


def test_vectors_are_made_alike_each_time():
    assert vectorfile.make() == vectorfile.make()


def test_functions_over_read_vectors(sections):
    canonical = sections["canonical_json"].select((sql.canonical_json("input") == F.col("expected_canonical_json_utf8")).alias("a"), (sql.payload_hash("input") == F.col("expected_payload_hash_blake3")).alias("b"))
    assert {tuple(r) for r in canonical.collect()} == {(True, True)}


@pytest.mark.parametrize("data", [b"[", b"[]", b'{"schema_version":2}', b'{"schema_version":1,"entry_hash":{"cases":[]}}'])
def test_other_files_are_no_vectors(spark, data):
    with pytest.raises(vectors.VectorError):
        vectors.parse(spark, data)
