import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlens.functions import blake3, canonical, ed25519, record, strict_json
from chainlens.operators.root import nodes_of, row_nodes  # noqa: F401
from chainlens.plans import vectors as V


def test_blake3_vectors():
    for _, _, form, want in V.CANONICAL:
        assert blake3.hexdigest(form.encode()) == want
    assert blake3.EMPTY.hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


def test_blake3_lanes_and_integers_agree_with_another_implementation(spark):
    hash_of = spark._jvm.org.apache.commons.codec.digest.Blake3.hash
    rng = np.random.default_rng(3)
    messages = [rng.bytes(n) for n in [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5000, 8192, 8193, 20_000]]
    for m, lane in zip(messages, blake3.hash_many(messages), strict=True):
        want = bytes(hash_of(bytearray(m)))
        assert lane.tobytes() == want
        assert blake3.digest(m) == want


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=700), st.lists(st.binary(max_size=400), min_size=1, max_size=3))
def test_blake3_begun(beginning, endings):
    begun = blake3.Begun(beginning)
    for e in endings:
        assert begun.digest(e) == blake3.digest(beginning + e)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 48, 256, 257, 1025, 5003])
def test_list_hash_in_any_parts(n):
    rng = np.random.default_rng(n)
    digests = rng.integers(0, 256, (n, 32)).astype(np.uint8)
    want = blake3.digest("".join(blake3.hexes(digests)).encode())
    grown, absorbed, at = blake3.ListHash(), blake3.ListHash(), 0
    while at < n:
        k = int(rng.integers(1, max(2, n // 3)))
        part = digests[at : at + k]
        grown.extend(part)
        absorbed.absorb(row_nodes(at, part, None), len(part))
        at += k
        grown, absorbed = blake3.ListHash(*grown.state()), blake3.ListHash(*absorbed.state())
    assert grown.digest() == absorbed.digest() == want


def test_ed25519_vectors():
    key = ed25519.SigningKey(bytes.fromhex(V.SEED))
    assert key.public.hex() == V.PUBLIC
    for name, domain, signature in V.SIGNATURES:
        message = domain.encode() + V.SIGNED_HASH.encode()
        assert key.sign(message).hex() == signature, name
        assert ed25519.verify(key.public, message, bytes.fromhex(signature))
        assert not ed25519.verify(key.public, message + b".", bytes.fromhex(signature))


def test_ed25519_rfc_8032():
    # Fixed values of RFC 8032, 7.1.
    cases = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]
    for seed, public, message, signature in cases:
        key = ed25519.SigningKey(bytes.fromhex(seed))
        assert key.public.hex() == public
        assert key.sign(bytes.fromhex(message)).hex() == signature


def test_ed25519_many_in_step_and_alone_agree():
    keys = [ed25519.SigningKey(bytes([i]) * 32) for i in range(3)]
    rows = [(keys[0 if i < 100 else i % 3], b"m%d" % i) for i in range(130)]
    sigs = [bytearray(k.sign(m)) for k, m in rows]
    bad = {3, 57, 101, 129}
    for i in bad:
        sigs[i][i % 64] ^= 1
    ok = ed25519.verify_many([k.public for k, _ in rows], [m for _, m in rows], [bytes(s) for s in sigs])
    assert {i for i, x in enumerate(ok) if not x} == bad
    s = int.from_bytes(sigs[0][32:], "little") + ed25519.ORDER
    assert not ed25519.verify(keys[0].public, b"m0", bytes(sigs[0][:32]) + s.to_bytes(32, "little"))  # not canonical
    assert not ed25519.verify(b"\x02" + b"\0" * 31, b"", bytes(64))  # not a point
    assert not ed25519.verify(b"short", b"", bytes(64))
    assert ed25519.decompress(b"\xcc" * 32) is not None


def test_canonical_vectors_and_key_order():
    for name, text, form, want in V.CANONICAL:
        assert canonical.canonical_json_from_bytes(text.encode()).decode() == form, name
        assert canonical.payload_hash(json.loads(text)) == want
    a = canonical.canonical_json({"b": 1, "a": [True, None], "é": "x"})
    assert a == canonical.canonical_json({"é": "x", "a": [True, None], "b": 1})


@pytest.mark.parametrize("text, kind", [("1.5", "non_integer_number"), ("-0", "non_integer_number"), ("1E3", "non_integer_number"), ("[9007199254740992]", "number_out_of_range"), ("18446744073709551615", "number_out_of_range"), ("18446744073709551616", "non_integer_number"), ("-9223372036854775809", "non_integer_number"), ('{"café":1,"café":2}', "duplicate_key_after_nfc"), ("{]", "invalid_json"), ("[Infinity]", "invalid_json"), ('"\\uD800"', "invalid_json"), ("[" * 200 + "]" * 200, "invalid_json")])
def test_canonical_refuses(text, kind):
    with pytest.raises(canonical.CanonicalError) as e:
        canonical.canonical_json_from_bytes(text.encode())
    assert e.value.kind == kind


def test_canonical_accepts_the_safe_range():
    assert canonical.canonical_json_from_bytes(b"[9007199254740991,-9007199254740991,-0.0e]".replace(b",-0.0e", b"")) == b"[9007199254740991,-9007199254740991]"


_json = st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.text(st.characters(exclude_categories=("Cs",))), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=("Cs",)), max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(_json)
def test_canonical_round_trip(value):
    try:
        form = canonical.canonical_json(value)
    except canonical.CanonicalError as e:
        assert e.kind == "duplicate_key_after_nfc"
        return
    assert canonical.canonical_json_from_bytes(form) == form
    assert canonical.canonical_json_from_bytes(json.dumps(value, indent=1).encode()) == form


def test_strict_json_writes_what_it_read():
    for text in ('{"a":1.0,"b":1e16,"c":1e-7,"d":-0.0}', '{"a":[1,"x\\n",null,true]}', '{"é":"日本"}'):
        assert strict_json.dumps(strict_json.parse(text.encode())) == text
    assert strict_json.dumps(strict_json.parse(b"99999999999999999999")) == "1e20"


def test_hash_vectors():
    for make, cases in ((record.entry_message, V.ENTRY), (record.sign_message, V.SIGN)):
        for name, *values, want in cases:
            r = record.Record(**dict(zip(("sequence", "timestamp_ns", "prev_hash", "payload_hash", "event_type", "source", "signature", "public_key"), values, strict=True)))
            assert blake3.hexdigest(make(r)) == want, name


def test_every_hashed_field_changes_the_hash():
    base = {"sequence": 1, "timestamp_ns": 1, "prev_hash": "a", "payload_hash": "b", "event_type": "c", "source": "d", "signature": "e", "public_key": "f"}
    h = lambda **c: blake3.hexdigest(record.entry_message(record.Record(**(base | c))))
    seen = {h(), *(h(**{k: (v + 1 if isinstance(v, int) else v + "x")}) for k, v in base.items()), *(h(**{k: None}) for k in ("event_type", "source", "signature", "public_key")), h(event_type="")}
    assert len(seen) == 1 + 8 + 4 + 1
    assert h(key_id="k", payload={"x": 1}, hash_alg="z") == h()


def test_receipt_messages():
    for _, event, payload, time, seq, key, alg, batch, want in V.RECEIPT:
        assert record.receipt_message({"event_id": event, "payload_hash": payload, "server_time": time, "server_seq": seq, "server_key_id": key, "sig_alg": alg, "batch_id": batch}) == want.encode()


@pytest.mark.parametrize("text, ns", [("1970-01-01T00:00:00Z", 0), ("1970-01-01T01:00:00.5+01:00", 500_000_000), ("2026-05-27T10:00:00.123456789123Z", 1779876000123456789), ("1969-12-31t23:59:59z", -(10**9)), ("2016-12-31T23:59:60Z", 1483228800 * 10**9)])
def test_rfc3339(text, ns):
    assert record.ns_of_rfc3339(text) == ns


@pytest.mark.parametrize("text", ["2026-05-27T10:00:00", "2026-05-27", "2300-01-01T00:00:00Z", "1600-01-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-05-27T25:00:00Z", "0000-01-01T00:00:00Z", "٢٠٢٦-05-27T10:00:00Z"])
def test_rfc3339_refuses(text):
    with pytest.raises(ValueError):
        record.ns_of_rfc3339(text)


def test_repeated_fields():
    line = b'{"seq":1,"ts":1,"prev":"p","hash":"h","seq":2}'
    with pytest.raises(strict_json.JsonError, match="duplicate field sequence"):
        record.decode(line)
    assert record.record_of(strict_json.parse(line), repeats=True).sequence == 2
    with pytest.raises(strict_json.JsonError, match="duplicate field sequence"):
        record.record_of(strict_json.parse(b'{"seq":1,"sequence":1,"ts":1,"prev":"p","hash":"h"}'), repeats=True)
    assert record.decode(b'{"seq":1,"ts":1,"prev":"p","hash":"h","x":1,"x":2,"payload":{"a":1,"a":2}}').payload == {"a": 2}


def test_hash_problem_texts():
    assert record.hash_problem("f", "a" * 64) is None
    assert record.hash_problem("f", "a" * 63) == "f invalid length: expected 64 chars, got 63"
    assert record.hash_problem("f", "a" * 5 + "g" + "A" * 58) == "f contains invalid char 'g' at position 5"
    assert record.hash_problem("f", "A" + "a" * 63) == "f uses uppercase 'A' at position 0; lowercase hex required"
    assert record.hash_problem("f", "é" + "a" * 62) == "f contains invalid char 'é' at position 0"


def test_anchors():
    for text in (" 0xAB ", "0Xab\n", "ab", "\tAB"):
        assert record.normalized_anchor(text) == "ab"
    assert [record.normalized_anchor(t) for t in ("   ", "0x", "  0X  ")] == ["", "", ""]
    assert record.fingerprint("AbZ1") == "ab1" + "0" * 13
