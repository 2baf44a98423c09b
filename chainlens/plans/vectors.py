"""Published values that implementations of the record format agree on."""

from __future__ import annotations

from ..functions import record

RECEIPT_DOMAIN, STRICT_DOMAIN = record.RECEIPT_DOMAIN.decode(), record.STRICT_DOMAIN.decode()

# Golden vectors of the format.

ZEROS, AB, CD = "0" * 64, "ab" * 32, "cd" * 32
SIG, KEY = "a" * 128, "b" * 64

#: name, JSON text, canonical form, payload hash
CANONICAL = [
    ("empty_object", "{}", "{}", "6e46dd10defc9b56c29a6ec56b508c21f54c08192194e4df25bf36f0c9c3c279"),
    ("empty_array", "[]", "[]", "d53d18c23212ea7b6300594bb89bce60218f6eff2b9d628b8cc42d3e79bbd5ab"),
    ("flat_object_unsorted_keys", '{"a":2,"b":1,"c":3}', '{"a":2,"b":1,"c":3}', "ec8e5e6668a389412d94279e141e98b4eb35b7c5bff48056a2e8b0d0df7061b1"),
    ("nested_object", '{"a":1,"outer":{"c":3,"d":4}}', '{"a":1,"outer":{"c":3,"d":4}}', "20825a737502c95a33f8b2fa8348cce572db04e5a1972d905ad84f58540a2d8c"),
    ("array_preserves_order", "[3,1,2]", "[3,1,2]", "fdb95223ff0257469111b94c88189d23ad29b22a3ecd3059fdd169c09ea9d123"),
    ("ascii_string", '{"s":"hello world"}', '{"s":"hello world"}', "4d1ac1142ee9831048231a1ba1d0ea75a74b87af88055e9380cc0f49d456cf40"),
    ("named_escapes", '{"s":"tab\\there\\nnewline\\\\back\\"quote"}', '{"s":"tab\\there\\nnewline\\\\back\\"quote"}', "ad5d9cd0612aca0e047e128a1c53edec1f0889286e6b3e147dc142d6206fba57"),
    ("unicode_literal_utf8", '{"s":"café 日本 emoji\U0001f389"}', '{"s":"café 日本 emoji\U0001f389"}', "9ac363d1aea742c3fbf6d0c6aa3ddf1641d7a3300768d2e14ca8e89d4fc569d7"),
    ("nfc_normalization", '{"cafe\u0301":1,"key":"cafe\u0301"}', '{"caf\u00e9":1,"key":"caf\u00e9"}', "c5491df8d758b908dcd81942c10f7a88d1c9548d8350afb487b78dcaa8ea7306"),
    ("supplementary_sort", '{"\uffff":2,"\U00010000":1}', '{"\U00010000":1,"\uffff":2}', "9e0ea52591b544bc9e818f25ffb6fb1e368da7e4cf764b221b14600c1b798242"),
    ("banking_payload", '{"amount":"100.00","currency":"EUR","from":"acct-1","to":"acct-2","ts":"2026-05-27T10:00:00Z"}', '{"amount":"100.00","currency":"EUR","from":"acct-1","to":"acct-2","ts":"2026-05-27T10:00:00Z"}', "dab234d573803614e9292183960da7be5c30cd1169d73af8dc6e2b3993795998"),
]

#: name, sequence, time, prev_hash, payload_hash, event_type, source, signature, public_key, hash
ENTRY = [
    ("genesis_all_optional_none", 1, 1700000000000000000, ZEROS, AB, None, None, None, None, "5be52ea29daebf24a9807048a6df5c26ccbb8885d7b545c15ba13406e25167f0"),
    ("event_type_some_empty_distinct_from_none", 1, 1700000000000000000, ZEROS, AB, "", None, None, None, "5a85bb7b353993888b968582a61e628154481fb550895a7d1404e1669610403a"),
    ("event_type_some_value", 1, 1700000000000000000, ZEROS, AB, "user.login", None, None, None, "28def972265ee049614b24d224584607460887972fc53e4ff210ce058fa613b1"),
    ("source_some_value", 1, 1700000000000000000, ZEROS, AB, None, "auth-service", None, None, "e280d5d772b32f8d9daaaf0f659da9effb8c07488e0c1df95f9b149ea0b30917"),
    ("signed_record_all_four_optional_set", 1, 1700000000000000000, ZEROS, AB, None, None, SIG, KEY, "6430d1b56a6f3cadf827caac021c7b2dbb2e6b69ffa1de253daf34f728ced68e"),
    ("subsequent_chain_link", 2, 1700000001000000000, "5be52ea29daebf24a9807048a6df5c26ccbb8885d7b545c15ba13406e25167f0", CD, None, None, None, None, "29bc0aec5f493c153b50084c4354c3c206065daa86b969e8967caaf84cb9da87"),
]
SIGN = [
    ("unsigned_entry_matches_chain_hash", 1, 1700000000000000000, ZEROS, AB, "user.login", "auth-service", None, None, "0ad2015edb01f6f3aa87c222e66cbe1d259e47b11d487d70177bb149bfcc67d9"),
    ("signed_entry_invariant_under_sig_and_pubkey", 1, 1700000000000000000, ZEROS, AB, "user.login", "auth-service", SIG, KEY, "0ad2015edb01f6f3aa87c222e66cbe1d259e47b11d487d70177bb149bfcc67d9"),
]

#: sequence, time, prev_hash, payload_hash, entry hash
CHAIN = [
    (1, 1700000001000000000, ZEROS, "c9957ad92f8b1e90e130589518c853958f2f084daa283876e07e080bbe5bbe52", "d6cb0c6b5b95b55c2b7d22627ce2e1afecdd57bf8d14a6d073c37628287fba3f"),
    (2, 1700000002000000000, "d6cb0c6b5b95b55c2b7d22627ce2e1afecdd57bf8d14a6d073c37628287fba3f", "e10e8dcd3d8e4dc38bd261123c385af5b9faa118ecc251c88eb1924990a5fd1a", "9a9fedb03250e50435f2399277917990caeb1d4ffbd0a9586f08c7b9ef3169c5"),
    (3, 1700000003000000000, "9a9fedb03250e50435f2399277917990caeb1d4ffbd0a9586f08c7b9ef3169c5", "48eb20ce7855b30d754e3fa015bbab95f428f1e5f1611eafb531e9365cde7966", "cb424d972710efbdf8124e0eab56c62861c95df70e9aa39ea067e7545da02380"),
]
CHAIN_ROOT = "d69d6d10fdee5f314a2d4f80d5ad8a29e02374f39951746a7388b9cc72088169"

#: name, event_id, payload_hash, server_time, server_seq, server_key_id, sig_alg, batch_id, what is signed
RECEIPT = [
    ("with_batch_id", "evt-42", AB, "2026-05-27T10:00:00Z", 7, "primary-2025", "ed25519", "batch-9", RECEIPT_DOMAIN + '{"batch_id":"batch-9","event_id":"evt-42","payload_hash":"' + AB + '","server_key_id":"primary-2025","server_seq":7,"server_time":"2026-05-27T10:00:00Z","sig_alg":"ed25519"}'),
    ("batch_id_null", "evt-43", CD, "2026-05-27T10:00:01Z", 8, "primary-2025", "ed25519", None, RECEIPT_DOMAIN + '{"batch_id":null,"event_id":"evt-43","payload_hash":"' + CD + '","server_key_id":"primary-2025","server_seq":8,"server_time":"2026-05-27T10:00:01Z","sig_alg":"ed25519"}'),
]

SEED, PUBLIC = "42" * 32, "2152f8d19b791d24453242e15f2eab6cb7cffa7b6a5ed30097960e069881db12"
SIGNED_HASH = "0ad2015edb01f6f3aa87c222e66cbe1d259e47b11d487d70177bb149bfcc67d9"
#: name, domain before the hash's text, signature
SIGNATURES = [
    ("lenient", "", "77ab8d765df147a99b8ac99e05715e2590af434b02ebcc6c1d1bc51474d0155207917d4e6a02491594e6a8fd6bd1f613d27dbd44ad474915c72240e868f2ea01"),
    ("strict", STRICT_DOMAIN, "0b55bb479ca0c835b864b6426710f0ad69ede1bdadfe552887346f959678b157f33483a9fca5e5c4e22778e0c33343f4aee789e23284cc0e11cd0d7816bcc90d"),
]
