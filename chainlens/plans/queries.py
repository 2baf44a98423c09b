"""The queries of the engine over the tables, and the same in SQL for an independent engine.

Queries over literal inputs (vectors, damaged logs) have the expected rows as SQL. Those over whole sealed logs run the library's
operators, and their SQL says what these must find in the table the log was made from: counts, times, errors of planted
damage. As SQL has no BLAKE3, hashes appear as what follows for them (a root equals that of the sealing loop); tests
hold the hashes themselves against a sequential verifier.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import record, sql, text
from ..functions.ed25519 import SigningKey
from ..functions.seeds import seed_of
from ..operators import adjacency, export, inspect, records, seal
from ..operators.digest import NONE, receipt_checks
from ..operators.root import chain_root_of
from ..sources import keystore, scratch, segments, tables
from ..streaming.verifier import StreamVerifier
from . import demo, lenient, reports, strict
from . import vectors as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEED = bytes([9]) * 32
ZEROS = "0" * 64


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _cell(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(schema: str, rows: Sequence[Sequence[object]]) -> str:
    """SQL of literal rows. schema: names and SQL types."""
    cols = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in cols)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in cols)})"


# Rows of tables as records

_NS = "(epoch_us(ts) * 1000)"
_EVENTS = f"SELECT event_id + 1 AS sequence, {_NS} AS timestamp_ns, event_type, 'user-' || user_id AS source, props AS payload FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_as_records(tables.table(spark, sf_dir, "events"))


@query(_EVENTS)
def wal_adapter_projection(spark, sf_dir):
    return _events(spark, sf_dir)


_RENDER = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00'"""


@query(f"SELECT event_id + 1 AS sequence, {_RENDER} AS timestamp FROM events")
def rfc3339_render(spark, sf_dir):
    return _events(spark, sf_dir).select("sequence", text.rfc3339(F.col("timestamp_ns")).alias("timestamp"))


def _hashed(rows: DataFrame) -> DataFrame:
    """With hashes that SQL has too, in place of BLAKE3."""
    return rows.withColumn("payload_hash", F.sha2("payload", 256)).withColumn("prev_hash", F.when(F.col("sequence") == 1, F.lit(ZEROS)).otherwise(F.sha2((F.col("sequence") - 1).cast("string"), 256)))


_HASHED = f"SELECT *, sha256(payload) AS payload_hash, CASE WHEN sequence = 1 THEN '{ZEROS}' ELSE sha256((sequence - 1)::VARCHAR) END AS prev_hash FROM ({_EVENTS})"


@query(f"""
SELECT sequence, {_RENDER} AS timestamp, event_type, source, true AS signed, NULL::VARCHAR AS event_id, false AS has_receipt
FROM (SELECT h.*, e.ts FROM ({_EVENTS}) h JOIN events e ON e.event_id + 1 = h.sequence) ORDER BY sequence DESC LIMIT 10""")
def event_display_last_n(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    shown = inspect.last_events(spark, directory, 10)
    return spark.createDataFrame([(e["sequence"], e["timestamp"], e["event_type"], e["source"], e["signed"], e["event_id"], e["has_receipt"]) for e in shown], "sequence long, timestamp string, event_type string, source string, signed boolean, event_id string, has_receipt boolean")


_ASKED = "SELECT 1 AS asked UNION ALL SELECT count(*) // 2 FROM events UNION ALL SELECT count(*) FROM events UNION ALL SELECT count(*) + 1 FROM events"


@query(f"SELECT asked, e.sequence IS NOT NULL AS found, e.event_type, e.source, e.timestamp_ns FROM ({_ASKED}) LEFT JOIN ({_EVENTS}) e ON e.sequence = asked")
def find_by_sequence(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    n = tables.table(spark, sf_dir, "events").count()
    rows = []
    for asked in (1, n // 2, n, n + 1):
        e = inspect.find_event(spark, directory, asked)
        rows.append((asked, e is not None, *((e["event_type"], e["source"], e["timestamp_ns"]) if e else (None, None, None))))
    return spark.createDataFrame(rows, "asked long, found boolean, event_type string, source string, timestamp_ns long")


@query(f"SELECT sequence, timestamp_ns, event_type FROM ({_EVENTS}) WHERE timestamp_ns BETWEEN {record.ns_of_rfc3339('2024-01-03T00:00:00Z')} AND {record.ns_of_rfc3339('2024-01-05T12:00:00+02:00')}")
def time_range_filter(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    lines = export.Export(spark, directory, "jsonl", from_="2024-01-03T00:00:00Z", to="2024-01-05T12:00:00+02:00").lines
    return lines.select(F.from_json("text", "sequence long, timestamp_ns long, event_type string").alias("r")).select("r.*")


@query(f"""
SELECT policy, count(*) AS events, sum(chosen)::BIGINT AS signatures, (count(*) - sum(chosen))::BIGINT AS skipped, true AS valid
FROM (SELECT 'all' AS policy, 1 AS chosen FROM ({_EVENTS}) UNION ALL SELECT 'none', 0 FROM ({_EVENTS}) UNION ALL SELECT 'sample 7', CASE WHEN sequence % 7 = 0 THEN 1 ELSE 0 END FROM ({_EVENTS})) GROUP BY policy""")
def sample_policy_rows(spark, sf_dir):
    """How many signatures each policy checks on the sealed log."""
    directory, root = tables.sealed_events(spark, sf_dir, SEED)
    P, rows = lenient.Policy, []
    for name, policy in (("all", P()), ("none", P("none")), ("sample 7", P("sample", 7))):
        r = lenient.verify_directory(spark, directory, lenient.Options(expected_root=root, policy=policy))
        rows.append((name, r.events_verified, r.signatures_verified, r.signatures_skipped, r.valid))
    return spark.createDataFrame(rows, "policy string, events long, signatures long, skipped long, valid boolean")


# Neighbouring rows

_ORDERS = "SELECT o_orderkey, epoch_us(o_orderdate) * 1000 AS ns, sha256(o_orderkey::VARCHAR) AS digest, sha256((o_orderkey - 1)::VARCHAR) AS declared FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", tables.ns_of(F.col("o_orderdate")).alias("ns"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest"), F.sha2((F.col("o_orderkey") - 1).cast("string"), 256).alias("declared"))


def _by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.with_previous(_orders(spark, sf_dir), [F.col("ns"), F.col("o_orderkey")], ["o_orderkey", "ns", "digest"])


@query(f"SELECT o_orderkey AS sequence, p + 1 AS expected, p AS previous FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY ns, o_orderkey) AS p FROM ({_ORDERS})) WHERE o_orderkey <> p + 1")
def sequence_gaps(spark, sf_dir):
    return adjacency.sequence_gaps(_by_date(spark, sf_dir), "o_orderkey")


@query(f"SELECT o_orderkey AS sequence, ns AS timestamp_ns, p AS previous_ns FROM (SELECT o_orderkey, ns, lag(ns) OVER (ORDER BY o_orderkey) AS p FROM ({_ORDERS})) WHERE ns < p")
def timestamp_regressions(spark, sf_dir):
    return adjacency.time_regressions(adjacency.with_previous(_orders(spark, sf_dir), [F.col("o_orderkey")], ["ns"]), "o_orderkey", "ns")


@query(f"SELECT o_orderkey AS sequence, e AS expected, declared AS found FROM (SELECT o_orderkey, declared, coalesce(lag(digest) OVER (ORDER BY ns, o_orderkey), '{ZEROS}') AS e FROM ({_ORDERS})) WHERE declared <> e")
def link_check_sha256_standin(spark, sf_dir):
    """The link check's shape, with SHA-256 in place of the entry hash, which SQL lacks."""
    return adjacency.link_breaks(_by_date(spark, sf_dir), "o_orderkey", "declared", "digest", ZEROS)


_FLAGS = """SELECT coalesce(bool_and(CASE WHEN p IS NULL THEN {declared} = '{z}' ELSE {declared} = d END), false) AS prev_hash_links_ok, coalesce(bool_and(CASE WHEN p IS NULL THEN {seq} = 1 ELSE {seq} = p + 1 END), false) AS sequence_contiguous, coalesce(bool_and(p IS NULL OR {ns} >= n), false) AS timestamps_monotonic, coalesce(bool_and({signed}), false) AS all_signed
FROM (SELECT *, lag({seq}) OVER w AS p, lag({digest}) OVER w AS d, lag({ns}) OVER w AS n FROM ({source}) WINDOW w AS (ORDER BY {order}))"""


@query(
    "SELECT 'events' AS log, * FROM (" + _FLAGS.format(declared="prev_hash", z=ZEROS, seq="sequence", digest="sha256(sequence::VARCHAR)", ns="timestamp_ns", signed="true", source=_HASHED, order="sequence") + ") UNION ALL SELECT 'orders', * FROM (" + _FLAGS.format(declared="declared", z=ZEROS, seq="o_orderkey", digest="digest", ns="ns", signed="o_orderkey < 0", source=_ORDERS, order="ns, o_orderkey") + ") UNION ALL SELECT 'none', false, false, false, false"
)
def integrity_flags(spark, sf_dir):
    events = _hashed(_events(spark, sf_dir)).withColumn("digest", F.sha2(F.col("sequence").cast("string"), 256))
    flags = lambda rows, seq, ns, declared, signed: adjacency.integrity(rows, sequence=seq, ns=ns, declared=declared, digest="digest", genesis=ZEROS, signed=signed)
    one = flags(adjacency.with_previous(events, [F.col("sequence")], ["sequence", "timestamp_ns", "digest"]), "sequence", "timestamp_ns", "prev_hash", F.lit(True))
    two = flags(_by_date(spark, sf_dir), "o_orderkey", "ns", "declared", F.col("o_orderkey") < 0)
    none = flags(adjacency.with_previous(events.limit(0), [F.col("sequence")], ["sequence", "timestamp_ns", "digest"]), "sequence", "timestamp_ns", "prev_hash", F.lit(True))
    return one.select(F.lit("events").alias("log"), "*").unionByName(two.select(F.lit("orders").alias("log"), "*")).unionByName(none.select(F.lit("none").alias("log"), "*"))


@query("SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_o_orderkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_o_totalprice, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_o_totalprice FROM orders")
def first_last(spark, sf_dir):
    return adjacency.ends(tables.table(spark, sf_dir, "orders"), F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_totalprice"])


@query(f"SELECT count(*) AS total_events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, arg_min(timestamp_ns, sequence) AS first_timestamp_ns, arg_max(timestamp_ns, sequence) AS last_timestamp_ns, true AS has_signatures, false AS is_sdk_format, 0::BIGINT AS events_with_receipt, count(*) AS events_without_receipt, true AS prev_hash_links_ok, true AS sequence_contiguous, (SELECT coalesce(bool_and(timestamp_ns >= p), true) FROM (SELECT timestamp_ns, lag(timestamp_ns) OVER (ORDER BY sequence) AS p FROM ({_EVENTS})) WHERE p IS NOT NULL) AS timestamps_monotonic, true AS all_signed, 0::BIGINT AS streams FROM ({_EVENTS})")
def wal_stats(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    s = inspect.stats(spark, directory)
    names = ("total_events", "first_sequence", "last_sequence", "first_timestamp_ns", "last_timestamp_ns", "has_signatures", "is_sdk_format", "events_with_receipt", "events_without_receipt")
    return _row(spark, **{n: s[n] for n in names}, **s["integrity"], streams=len(s["stream_ids"]))


def _as_segments(lines: DataFrame, label: str) -> str:
    """Writes lines (value) as a log of a segment a partition, in their order; returns its directory."""
    spark = lines.sparkSession
    out = scratch.new_dir(spark, label)
    lines.write.mode("overwrite").text(f"{out}/raw")
    at, fs = scratch.file_system(spark, out)
    fs.mkdirs(at(f"{out}/log"))
    parts = sorted(s.getPath().getName() for s in fs.listStatus(at(f"{out}/raw")) if s.getPath().getName().startswith("part-"))
    for n, part in enumerate(parts):
        fs.rename(at(f"{out}/raw/{part}"), at(f"{out}/log/{n:08d}.jsonl"))
    return f"{out}/log"


@query(f"SELECT DISTINCT source AS stream_id FROM ({_EVENTS})")
def stream_ids_sorted(spark, sf_dir):
    """Of a log whose records have stream ids; its lines are the sealed ones with that field set."""
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    lines = spark.read.text(directory).select(F.to_json(F.struct(F.lit("s").alias("event_id"), F.get_json_object("value", "$.source").alias("stream_id"))).alias("more"), "value")
    log = _as_segments(lines.select(F.concat(F.expr("substring(more, 1, length(more) - 1)"), F.lit(","), F.expr("substring(regexp_replace(value, '\"(event_id|stream_id)\":null,?', ''), 2)")).alias("value")), "streams")
    return spark.createDataFrame([(s,) for s in inspect.stats(spark, log)["stream_ids"]], "stream_id string")


@query(f"""SELECT sequence, rank, error_type FROM (
SELECT o_orderkey AS sequence, 2 AS rank, 'sequence_gap' AS error_type FROM (SELECT *, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM ({_ORDERS})) WHERE o_orderkey <> p + 1
UNION ALL SELECT o_orderkey, 3, 'timestamp_regression' FROM (SELECT *, lag(ns) OVER (ORDER BY o_orderkey) AS p FROM ({_ORDERS})) WHERE ns < p) ORDER BY sequence, rank LIMIT 1""")
def first_failure(spark, sf_dir):
    rows = adjacency.with_previous(_orders(spark, sf_dir), [F.col("o_orderkey")], ["o_orderkey", "ns"])
    kinds = {"sequence_gap": (2, adjacency.sequence_gaps(rows, "o_orderkey")), "timestamp_regression": (3, adjacency.time_regressions(rows, "o_orderkey", "ns"))}
    found = [df.select("sequence", F.lit(rank).alias("rank"), F.lit(kind).alias("error_type")) for kind, (rank, df) in kinds.items()]
    return adjacency.first_failure(found[0].unionByName(found[1]), ["sequence", "rank"])


# Text

_SHAPES = """SELECT event_id + 1 AS sequence, CASE event_type WHEN 'click' THEN sha256(props) WHEN 'error' THEN upper(sha256(props)) WHEN 'view' THEN sha256(props)[1:40] WHEN 'signup' THEN 'g' || sha256(props)[2:64] ELSE sha256(props)[1:10] || 'É' || sha256(props)[13:64] END AS h FROM events"""


@query(f"""SELECT sequence, CASE WHEN octet_length(encode(h)) <> 64 THEN 'payload_hash invalid length: expected 64 chars, got ' || octet_length(encode(h))
WHEN NOT regexp_full_match(h, '[0-9a-f]*') THEN CASE WHEN regexp_full_match(h[length(regexp_extract(h, '^[0-9a-f]*')) + 1:length(regexp_extract(h, '^[0-9a-f]*')) + 1], '[A-F]')
  THEN 'payload_hash uses uppercase ''' || h[length(regexp_extract(h, '^[0-9a-f]*')) + 1:length(regexp_extract(h, '^[0-9a-f]*')) + 1] || ''' at position ' || length(regexp_extract(h, '^[0-9a-f]*')) || '; lowercase hex required'
  ELSE 'payload_hash contains invalid char ''' || h[length(regexp_extract(h, '^[0-9a-f]*')) + 1:length(regexp_extract(h, '^[0-9a-f]*')) + 1] || ''' at position ' || length(regexp_extract(h, '^[0-9a-f]*')) END END AS problem FROM ({_SHAPES})""")
def hex_hash_validation(spark, sf_dir):
    h = F.sha2("props", 256)
    kind = F.col("event_type")
    shaped = F.when(kind == "click", h).when(kind == "error", F.upper(h)).when(kind == "view", F.substring(h, 1, 40)).when(kind == "signup", F.concat(F.lit("g"), F.substring(h, 2, 63))).otherwise(F.concat(F.substring(h, 1, 10), F.lit("É"), F.substring(h, 13, 52)))
    return tables.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), text.hash_problem("payload_hash", shaped).alias("problem"))


@query("SELECT event_id + 1 AS sequence, sha256(props) AS anchor, sha256(props)[1:16] AS fingerprint, CASE WHEN event_type = 'view' THEN props[7:7] || '000000000000000' ELSE sha256(props)[1:16] END AS padded FROM events")
def anchor_normalization(spark, sf_dir):
    h = F.sha2("props", 256)
    given = F.when(F.col("event_type") == "error", F.concat(F.lit(" \t0X"), F.upper(h), F.lit("\n"))).when(F.col("event_type") == "click", F.concat(F.lit("0x"), h)).otherwise(h)
    short = F.when(F.col("event_type") == "view", F.concat(F.lit("zz"), F.substring("props", 7, 1))).otherwise(h)
    return tables.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), text.normalized_anchor(given).alias("anchor"), text.fingerprint(text.normalized_anchor(given)).alias("fingerprint"), text.fingerprint(short).alias("padded"))


_ODD = """SELECT doc_id, coalesce(lang, '') AS lang, CASE WHEN lang = 'en' THEN '=' || coalesce(text, '') WHEN lang = 'de' THEN '-1,"' || coalesce(text, '') WHEN lang = 'fr' THEN chr(9) || coalesce(text, '') ELSE coalesce(text, '') END AS t FROM documents"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, lang = F.coalesce("text", F.lit("")), F.col("lang")
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(lang, F.lit("")).alias("lang"), F.when(lang == "en", F.concat(F.lit("="), t)).when(lang == "de", F.concat(F.lit('-1,"'), t)).when(lang == "fr", F.concat(F.lit("\t"), t)).otherwise(t).alias("t"))


def _quoted_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[,\"\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END"


def _safe_sql(x: str) -> str:
    return f"CASE WHEN substr({x}, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || {x} ELSE {x} END"


@query(f"""SELECT doc_id, (doc_id + 1) || ',' || s.ts || ',' || {_quoted_sql('s.t')} || ',' || s.lang || ',{'ab' * 32},{ZEROS},' || CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END AS line
FROM (SELECT doc_id, lang, {_safe_sql('t')} AS t, {_safe_sql('(doc_id - 100)::VARCHAR')} AS ts FROM ({_ODD})) s""")
def csv_export_rows(spark, sf_dir):
    line = text.csv_line(sequence=F.col("doc_id") + 1, timestamp_ns=F.col("doc_id") - 100, event_type=F.col("t"), source=F.col("lang"), payload_hash=F.lit("ab" * 32), prev_hash=F.lit(ZEROS), signed=F.col("lang") == "en")
    return _odd(spark, sf_dir).select("doc_id", line.alias("line"))


def _escape_sql(x: str) -> str:
    out = x
    for raw, shown in (("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), ("chr(133)", "chr(92) || 'u0085'"), ("chr(8232)", "chr(92) || 'u2028'"), ("chr(8233)", "chr(92) || 'u2029'")):
        out = f"replace({out}, {raw}, {shown})"
    for code in [*range(1, 9), 11, 12, *range(14, 32)]:
        out = f"replace({out}, chr({code}), chr(92) || 'x{code:02x}')"
    return out


_SPACES = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _token_sql(x: str) -> str:
    cleaned = f"""replace(replace(regexp_replace({x}, '{_SPACES}', '_', 'g'), '"', ''), chr(92), '')"""
    return f"CASE WHEN {cleaned} = '' THEN '-' ELSE {cleaned} END"


@query(f"""SELECT doc_id, '<134>1 ' || strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00 ' || {_token_sql('lang')} || ' chainlens ' || doc_id || ' ' || {_token_sql('t')} || ' - msg="seq=' || doc_id || ' type=' || {_escape_sql('t')} || ' hash={'ab' * 8}"' AS line FROM ({_ODD})""")
def syslog_export_lines(spark, sf_dir):
    line = text.syslog_line(export.FACILITY, sequence=F.col("doc_id"), timestamp_ns=F.col("doc_id") * F.lit(10**9), event_type=F.col("t"), source=F.col("lang"), payload_hash=F.lit("ab" * 32))
    return _odd(spark, sf_dir).select("doc_id", line.alias("line"))


@query("""SELECT o_orderkey, '{"seq":' || o_orderkey || ',"payload":{"amount":"1 EUR","note":"amount"}}' AS line FROM orders""")
def amount_rewrite(spark, sf_dir):
    raw = F.concat(F.lit('{"seq":'), F.col("o_orderkey").cast("string"), F.lit(',"payload":{"amount":"'), F.col("o_totalprice").cast("string"), F.lit('","note":"amount"}}'))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", text.rewrite_amount(raw, "1 EUR").alias("line"))


@query("SELECT page_id, sha256(html) AS digest, sha256(html) = sha256(html || '') AS matches FROM pages WHERE html IS NOT NULL")
def asset_digests(spark, sf_dir):
    """The gate on assets: the bytes' SHA-256 against the manifest's."""
    pages = tables.table(spark, sf_dir, "pages").where("html IS NOT NULL")
    return pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), (F.sha2(F.col("html").cast("binary"), 256) == F.sha2(F.concat("html", F.lit("")).cast("binary"), 256)).alias("matches"))


@query("SELECT e.event_id + 1 AS sequence, 'server-' || (e.user_id % 25) AS server_key_id, s.s_name AS key_name, CASE WHEN s.s_suppkey IS NULL THEN 'receipt_key_unknown' END AS error_type FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id % 25 AND s.s_acctbal > 0")
def keystore_join(spark, sf_dir):
    """Receipts against known keys, by a broadcast of the keystore."""
    keys = tables.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("server-"), F.col("s_suppkey").cast("string")).alias("server_key_id"), F.col("s_name").alias("key_name"))
    receipts = tables.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), F.concat(F.lit("server-"), (F.col("user_id") % 25).cast("string")).alias("server_key_id"))
    return receipts.join(keys, "server_key_id", "left").select("sequence", "server_key_id", "key_name", F.when(F.col("key_name").isNull(), F.lit("receipt_key_unknown")).alias("error_type"))


# Literal lines

_LINES: list[tuple[str, bytes]] = [
    ("canonical names", b'{"format_version":1,"sequence":1,"timestamp_ns":5,"prev_hash":"p","payload_hash":"h"}'),
    ("defaults", b'{"sequence":2,"timestamp_ns":5,"prev_hash":"p","payload_hash":"h","extra":[1]}'),
    ("short names", b'{"seq":3,"ts":6,"prev":"p","hash":"h","sig":"s","pk":"k"}'),
    ("other names", b'{"seq":4,"ts_client":7,"previous_hash":"p","event_hash":"h","sig_client":"s","pubkey":"k"}'),
    ("time text", b'{"seq":5,"timestamp":"1970-01-01T00:00:01.5+00:00","prev":"p","hash":"h"}'),
    ("largest", b'{"seq":18446744073709551615,"ts_ns":-9223372036854775808,"prev":"p","hash":"h"}'),
]


def _literal(spark: SparkSession, lines: Sequence[bytes]) -> DataFrame:
    return segments.scan_bytes(spark, b"\n".join(lines))


@query(
    values(
        "line BIGINT, format_version BIGINT, sequence VARCHAR, timestamp_ns BIGINT, prev_hash VARCHAR, payload_hash VARCHAR, signature VARCHAR, public_key VARCHAR",
        [(0, 1, "1", 5, "p", "h", None, None), (1, 1, "2", 5, "p", "h", None, None), (2, 1, "3", 6, "p", "h", "s", "k"), (3, 1, "4", 7, "p", "h", "s", "k"), (4, 1, "5", 1500000000, "p", "h", None, None), (5, 1, "18446744073709551615", -9223372036854775808, "p", "h", None, None)],
    )
)
def alias_default_resolution(spark, sf_dir):
    rows = records.records(_literal(spark, [x for _, x in _LINES]))
    return rows.select("line", "format_version", F.col("sequence").cast("string").alias("sequence"), "timestamp_ns", "prev_hash", "payload_hash", "signature", "public_key")


@query(values("line BIGINT, sequence BIGINT", [(1, 1), (4, 2), (6, 3)]))
def blank_and_crlf_lines(spark, sf_dir):
    line = lambda n: b'{"seq":%d,"ts":1,"prev":"p","hash":"h"}' % n
    rows = records.records(_literal(spark, [b"", line(1) + b"\r", b" \t\x0c", b"\r", b" " + line(2) + b" ", b"", line(3)]))
    return rows.select("line", F.col("sequence").cast("long").alias("sequence"))


_BAD: list[tuple[bytes, bool]] = [
    (b"not-json", False),
    (b'{"seq":1.0,"ts":1,"prev":"p","hash":"h"}', False),
    (b'{"seq":"1","ts":1,"prev":"p","hash":"h"}', False),
    (b'{"seq":-1,"ts":1,"prev":"p","hash":"h"}', False),
    (b'{"seq":18446744073709551616,"ts":1,"prev":"p","hash":"h"}', False),
    (b'{"seq":1,"ts":1,"prev":"p","hash":12}', False),
    (b'{"seq":1,"ts":1,"prev":"p"}', False),
    (b'{"seq":1,"sequence":1,"ts":1,"prev":"p","hash":"h"}', False),
    (b'{"seq":1,"ts":"2026-05-27T10:00:00","prev":"p","hash":"h"}', False),
    (b'{"seq":1,"ts":"2600-01-01T00:00:00Z","prev":"p","hash":"h"}', False),
    (b'{"seq":1,"ts":1,"prev":"p","hash":"h","payload":NaN}', False),
    (b'{"seq":1,"ts":1,"prev":"p","hash":"\xff"}', False),
    (b'{"seq":1,"ts":1,"prev":"p","hash":"h","receipt":{}}', False),
    (b"[1,1,1]", False),
    (b'{"seq":1,"ts":1,"prev":"p","hash":"h","payload":{"a":1.50},"source":null}', True),
]


@query(values("line BIGINT, readable BOOLEAN", [(i, ok) for i, (_, ok) in enumerate(_BAD)]))
def decode_errors(spark, sf_dir):
    return records.records(_literal(spark, [x for x, _ in _BAD])).select("line", F.col("problem").isNull().alias("readable"))


@query(values("names VARCHAR, outcome VARCHAR", [("1.wal 10.wal", "unsortable"), ("01.wal 10.wal x.txt", "01.wal 10.wal"), ("b.jsonl a.wal batch_ledger.jsonl", "a.wal b.jsonl"), ("1.wal a10.wal", "1.wal a10.wal"), ("B.wal a.wal", "B.wal a.wal")]))
def unsortable_segments(spark, sf_dir):
    def outcome(names: str) -> str:
        try:
            return " ".join(segments.select_segments(names.split()))
        except segments.SegmentError:
            return "unsortable"

    return spark.createDataFrame([(n, outcome(n)) for n in ("1.wal 10.wal", "01.wal 10.wal x.txt", "b.jsonl a.wal batch_ledger.jsonl", "1.wal a10.wal", "B.wal a.wal")], "names string, outcome string")


# Vectors

def _vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.CANONICAL, "name string, input string, c string, h string").select("name", "input")


@query(values("name VARCHAR, canonical VARCHAR", [(n, c) for n, _, c, _ in V.CANONICAL]))
def canonical_json_vectors(spark, sf_dir):
    return _vectors(spark).select("name", sql.canonical_json("input").alias("canonical"))


@query(values("name VARCHAR, payload_hash VARCHAR, direct VARCHAR", [(n, h, h) for n, _, _, h in V.CANONICAL]))
def payload_hash_vectors(spark, sf_dir):
    return _vectors(spark).select("name", sql.payload_hash("input").alias("payload_hash"), sql.blake3_hex(sql.canonical_json("input").cast("binary")).alias("direct"))


_REFUSED = [
    ("1.5", "non_integer_number"), ("2.0", "non_integer_number"), ("-0", "non_integer_number"), ("1e3", "non_integer_number"), ("9007199254740991.0", "non_integer_number"), ("9007199254740991", None), ("-9007199254740991", None), ("9007199254740992", "number_out_of_range"),
    ("-9223372036854775808", "number_out_of_range"), ("9223372036854775807", "number_out_of_range"), ("18446744073709551615", "number_out_of_range"), ("18446744073709551616", "non_integer_number"), ('{"caf\u00e9":1,"cafe\u0301":2}', "duplicate_key_after_nfc"), ('{"a":1,"a":2}', None), ("{", "invalid_json"), ("NaN", "invalid_json"), ('"\\ud800"', "invalid_json"),
]


@query(values("input VARCHAR, error VARCHAR", _REFUSED))
def canonical_json_rejections(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in _REFUSED], "input string").select("input", sql.canonical_error("input").alias("error"))


_HASH_COLUMNS = ("sequence", "timestamp_ns", "prev_hash", "payload_hash", "event_type", "source", "signature", "public_key")


def _hash_inputs(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([r[:9] for r in rows], "name string, sequence long, timestamp_ns long, prev_hash string, payload_hash string, event_type string, source string, signature string, public_key string")


@query(values("name VARCHAR, entry_hash VARCHAR", [(r[0], r[9]) for r in V.ENTRY]))
def entry_hash_vectors(spark, sf_dir):
    return _hash_inputs(spark, V.ENTRY).select("name", sql.entry_hash(*_HASH_COLUMNS).alias("entry_hash"))


@query(values("name VARCHAR, sign_hash VARCHAR", [(r[0], r[9]) for r in V.SIGN]))
def sign_hash_vectors(spark, sf_dir):
    return _hash_inputs(spark, V.SIGN).select("name", sql.sign_hash(*_HASH_COLUMNS[:6]).alias("sign_hash"))


@query(values("records BIGINT, chain_root VARCHAR", [(3, V.CHAIN_ROOT)]))
def chain_root_vector(spark, sf_dir):
    rows = _hash_inputs(spark, [("", *r[:4], None, None, None, None) for r in V.CHAIN]).withColumn("h", sql.entry_hash(*_HASH_COLUMNS))
    return spark.createDataFrame([(3, chain_root_of(rows, "sequence", "h"))], "records long, chain_root string")


@query(values("name VARCHAR, message VARCHAR", [(r[0], r[8].encode().hex()) for r in V.RECEIPT]))
def receipt_message_vectors(spark, sf_dir):
    rows = spark.createDataFrame([r[:8] for r in V.RECEIPT], "name string, event_id string, payload_hash string, server_time string, server_seq long, server_key_id string, sig_alg string, batch_id string")
    return rows.select("name", sql.receipt_message_hex("event_id", "payload_hash", "server_time", "server_seq", "server_key_id", "sig_alg", "batch_id").alias("message"))


@query(values("profile VARCHAR, under VARCHAR, ok BOOLEAN, signature VARCHAR", [(p, q, p == q, s) for p, _, s in V.SIGNATURES for q, _, _ in V.SIGNATURES]))
def signature_vectors(spark, sf_dir):
    key = SigningKey(bytes.fromhex(V.SEED))
    domain = {"lenient": b"", "strict": record.STRICT_DOMAIN}
    rows = [(p, q, bytearray(domain[q] + V.SIGNED_HASH.encode()), key.sign(domain[p] + V.SIGNED_HASH.encode()).hex()) for p in domain for q in domain]
    return spark.createDataFrame(rows, "profile string, under string, message binary, signature string").select("profile", "under", sql.ed25519_verify(F.lit(V.PUBLIC), "message", "signature").alias("ok"), "signature")


# Damaged logs

def _receipt(key: SigningKey, **changes) -> dict:
    r = {"event_id": "e", "payload_hash": V.AB, "server_time": "2026-05-27T10:00:00Z", "server_seq": 7, "receipt_sig": "", "server_key_id": "k", "sig_alg": "ed25519", "batch_id": None}
    r["receipt_sig"] = key.sign(record.receipt_message(r)).hex()
    return r | changes


_RECEIPTS = [
    ("good", {}, V.AB, "e", None),
    ("good without event", {}, V.AB, None, None),
    ("other payload", {}, V.CD, "e", "receipt_entry_mismatch"),
    ("other event", {}, V.AB, "f", "receipt_entry_mismatch"),
    ("changed", {"payload_hash": V.CD}, V.CD, "e", "receipt_signature_invalid"),
    ("unknown key", {"server_key_id": "z"}, V.AB, "e", "receipt_key_unknown"),
    ("algorithm", {"sig_alg": "schnorr-secp256k1"}, V.AB, "e", "receipt_unsupported_alg"),
    ("no hex", {"receipt_sig": "zz"}, V.AB, "e", "receipt_sig_malformed"),
    ("short", {"receipt_sig": "abcd"}, V.AB, "e", "receipt_sig_malformed"),
]


@query(values("name VARCHAR, error_type VARCHAR", [(n, e) for n, _, _, _, e in _RECEIPTS]))
def receipt_binding(spark, sf_dir):
    key = SigningKey(SEED)
    found = receipt_checks([("1", _receipt(key, **c), p, e) for _, c, p, e, _ in _RECEIPTS], keystore.Keystore.from_keys([("k", key.public)]))
    return spark.createDataFrame([(r[0], f[0] if f else None) for r, f in zip(_RECEIPTS, found, strict=True)], "name string, error_type string")


def small_log(n: int, profile: str = "lenient", seed: bytes | None = SEED) -> tuple[list[dict], str]:
    """n records as JSON values, and their root."""
    rows = (seal.payload_record(i, 1_700_000_000_000_000_000 + i * 10**9, {"amount": "100.00", "seq": i}, event_type="pay", source="s") for i in range(1, n + 1))
    data, root = seal.seal_log(rows, SigningKey(seed) if seed else None, profile)
    return [json.loads(x) for x in data.decode().splitlines()], root


def to_bytes(rows: Sequence[dict | str]) -> bytes:
    return "".join((r if isinstance(r, str) else json.dumps(r, separators=(",", ":"))) + "\n" for r in rows).encode()


def _changed(rows: list[dict], at: int, **values: object) -> list[dict]:
    return [r | values if i == at else r for i, r in enumerate(rows)]


def lenient_cases() -> dict[str, tuple[list, dict]]:
    """Damaged logs by name, with the options to verify them under."""
    log, _ = small_log(3)
    plain, _ = small_log(3, seed=None)
    key = SigningKey(SEED).public.hex()
    return {
        "intact": (log, {}),
        "broken link": (_changed(log, 1, prev_hash="f" * 64), {}),
        "no genesis": (log[1:], {}),
        "gap": ([log[0], log[2]], {}),
        "time goes back": (_changed(plain, 2, timestamp_ns=5), {}),
        "payload hash changed": (_changed(log, 2, payload_hash="e" * 64), {}),
        "no key": ([{k: v for k, v in r.items() if k != "public_key"} if i == 2 else r for i, r in enumerate(log)], {}),
        "other pin": (log, {"trusted_pubkey": V.PUBLIC}),
        "pin on unsigned": (plain, {"trusted_pubkey": key}),
        "wrong root": (log, {"expected_root": "0x" + "1" * 64}),
        "not json": ([log[0], "not-json", *log[1:]], {}),
        "fail fast": (_changed(log, 1, prev_hash="f" * 64), {"fail_fast": True}),
        "uppercase hash": (_changed(plain, 2, payload_hash="A" * 64), {}),
        "empty": ([], {}),
    }


_LENIENT = [
    ("intact", True, 3, ""),
    ("broken link", False, 3, "chain_break|invalid_signature|chain_break"),
    ("no genesis", False, 2, "invalid_genesis"),
    ("gap", False, 2, "chain_break|sequence_gap"),
    ("time goes back", False, 3, "timestamp_regression"),
    ("payload hash changed", False, 3, "invalid_signature"),
    ("no key", False, 3, "unsigned_record"),
    ("other pin", False, 3, "untrusted_pubkey|untrusted_pubkey|untrusted_pubkey"),
    ("pin on unsigned", False, 3, "unsigned_record|unsigned_record|unsigned_record"),
    ("wrong root", False, 3, "root_mismatch"),
    ("not json", False, 3, "parse_error"),
    ("fail fast", False, 1, "chain_break"),
    ("uppercase hash", False, 3, "invalid_hash_format"),
    ("empty", True, 0, ""),
]


@query(values("name VARCHAR, valid BOOLEAN, events BIGINT, error_types VARCHAR", _LENIENT))
def lenient_tamper_matrix(spark, sf_dir):
    out = []
    for name, (rows, options) in lenient_cases().items():
        r = lenient.verify_bytes(spark, to_bytes(rows), lenient.Options(**options))
        out.append((name, r.valid, r.events_verified, "|".join(e["error_type"] for e in r.errors)))
    return spark.createDataFrame(out, "name string, valid boolean, events long, error_types string")


def strict_cases() -> dict[str, tuple[list, str, str]]:
    """Damaged logs by name, with the pinned key and the root to verify them under."""
    log, root = small_log(3, "strict")
    loose, loose_root = small_log(3, "lenient")
    key = SigningKey(SEED).public.hex()
    less = lambda *names: [{k: v for k, v in r.items() if k not in names} if i == 1 else r for i, r in enumerate(log)]
    return {
        "intact": (log, key, root),
        "loose anchors": (log, f" 0x{key.upper()} ", f"0X{root.upper()}\n"),
        "no signature": (less("signature"), key, root),
        "other pin": (log, V.PUBLIC, root),
        "edited payload": (_changed(log, 1, payload={"amount": "999.00", "seq": 2}), key, root),
        "no payload": (less("payload"), key, root),
        "version 999": (_changed(log, 0, format_version=999), key, root),
        "no version": (less("format_version"), key, root),
        "algorithm": (_changed(log, 1, hash_alg="sha256"), key, root),
        "bad pin": (log, "zz", root),
        "bad root": (log, key, "abc"),
        "wrong root": (log, key, "1" * 64),
        "loose signatures": (loose, key, loose_root),
        "unknown key": (_changed(log, 1, hash_Alg="blake3"), key, root),
        "float payload": (_changed(log, 1, payload={"a": 1.5}), key, root),
        "not json": ([log[0], "{", log[2]], key, root),
        "gap": ([log[0], log[2]], key, root),
        "empty": ([], key, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
    }


_STRICT = [
    ("intact", "valid", 3, "valid"),
    ("loose anchors", "valid", 3, "valid"),
    ("no signature", "invalid", 2, "rejected: unsigned_record"),
    ("other pin", "invalid", 1, "rejected: pubkey_mismatch"),
    ("edited payload", "invalid", 2, "invalid: payload_hash_mismatch"),
    ("no payload", "invalid", 2, "rejected: no_payload"),
    ("version 999", "invalid", 1, "rejected: unsupported_format_version"),
    ("no version", "invalid", 2, "rejected: unsupported_format_version"),
    ("algorithm", "invalid", 2, "rejected: unsupported_hash_alg"),
    ("bad pin", "error", 0, ""),
    ("bad root", "error", 0, ""),
    ("wrong root", "invalid", 3, "valid"),
    ("loose signatures", "invalid", 1, "invalid: signature_verification_failed"),
    ("unknown key", "invalid", 2, "rejected: unknown_field"),
    ("float payload", "invalid", 2, "rejected: non_canonical_payload"),
    ("not json", "invalid", 2, "rejected: parse_error"),
    ("gap", "invalid", 2, "invalid: chain_break"),
    ("empty", "valid", 0, ""),
]


@query(values("name VARCHAR, status VARCHAR, records BIGINT, last VARCHAR", _STRICT))
def strict_tamper_matrix(spark, sf_dir):
    out = []
    for name, (rows, key, root) in strict_cases().items():
        r = strict.verify_bytes(spark, to_bytes(rows), key, root)
        out.append((name, r.status, len(r.records), reports.outcome_text(r.records[-1]) if r.records else ""))
    return spark.createDataFrame(out, "name string, status string, records long, last string")


_CAPS = [("at the line's limit", "invalid", "parse_error"), ("over the line's limit", "invalid", "line_too_large"), ("payload at its limit", "valid", ""), ("payload over its limit", "invalid", "payload_too_large")]


@query(values("name VARCHAR, status VARCHAR, kind VARCHAR", _CAPS))
def strict_caps(spark, sf_dir):
    key, out = SigningKey(SEED), []
    payload = lambda n: {"p": "x" * (n - 8)}
    logs = {name: seal.seal_log([seal.payload_record(1, 5, payload(n))], key, "strict") for name, n in (("payload at its limit", strict.MAX_PAYLOAD_BYTES), ("payload over its limit", strict.MAX_PAYLOAD_BYTES + 1))}
    logs = {"at the line's limit": (b"x" * strict.MAX_LINE_BYTES, ZEROS), "over the line's limit": (b"x" * (strict.MAX_LINE_BYTES + 1), ZEROS)} | logs
    for name, (data, root) in logs.items():
        r = strict.verify_bytes(spark, data, key.public.hex(), root)
        out.append((name, r.status, r.records[-1].get("reason", {}).get("kind", "")))
    return spark.createDataFrame(out, "name string, status string, kind string")


_KEYS = [("canonical", None), ("alias", None), ("typo", "hash_Alg"), ("two unknown", "aa"), ("nested unknown", None)]


@query(values("name VARCHAR, unknown VARCHAR", _KEYS))
def strict_unknown_keys(spark, sf_dir):
    lines = {"canonical": {"sequence": 1}, "alias": {"seq": 1, "sig_client": "s"}, "typo": {"seq": 1, "hash_Alg": "x"}, "two unknown": {"seq": 1, "zz": 1, "aa": 2}, "nested unknown": {"seq": 1, "payload": {"zz": 1}, "receipt": {"zz": 1}}}
    found = [(n, strict.decoded(json.dumps(v).encode(), True)[2]) for n, v in lines.items()]
    return spark.createDataFrame([(n, f[2].get("field") if f else None) for n, f in found], "name string, unknown string")


@query("SELECT CAST(unnest([20]) AS BIGINT) AS records, 'c36bd135f17fbd48' AS root, 'valid' AS status, 'invalid: payload_hash_mismatch' AS edited")
def demo_log(spark, sf_dir):
    """The demonstration log of the published fixture's key, verified as it is and with one amount changed."""
    key = SigningKey(seed_of(42))
    data, root = demo.sealed(key)
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(data.decode().splitlines(), 1)], "n int, line string")
    edited = lines.select("n", F.when(F.col("n") == demo.EDIT_TARGET, text.rewrite_amount(F.col("line"), "100000.00 EUR")).otherwise(F.col("line")).alias("line")).orderBy("n").collect()
    pin = key.public.hex()
    good, bad = strict.verify_bytes(spark, data, pin, root), strict.verify_bytes(spark, "\n".join(r["line"] for r in edited).encode(), pin, root)
    return _row(spark, records=good.events_verified, root=good.chain_root[:16], status=good.status, edited=reports.outcome_text(bad.records[-1]))


# Whole sealed logs: the events table as one chain

def _row(spark: SparkSession, **cells: object) -> DataFrame:
    kinds = {bool: "boolean", int: "long", str: "string"}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items()))


@query("SELECT count(*) AS records, true AS as_sealed FROM events")
def chain_root_events(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir)
    rows = records.read_log(spark, directory, hashes=True)
    return _row(spark, records=rows.count(), as_sealed=chain_root_of(rows.select("sequence", "entry_hash"), "sequence", "entry_hash") == root)


@query(f"SELECT sequence, timestamp_ns, event_type, source, true AS has_hash FROM ({_EVENTS})")
def log_records_events(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir)
    return records.read_log(spark, directory, hashes=True).select(F.col("sequence").cast("long").alias("sequence"), "timestamp_ns", "event_type", "source", F.coalesce(F.length("entry_hash") == 64, F.lit(False)).alias("has_hash"))


@query("SELECT true AS valid, count(*) AS events, 0::BIGINT AS signatures, count(*) AS skipped, true AS as_sealed FROM events")
def chain_only_verify_events(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir, SEED)
    r = lenient.verify_directory(spark, directory, lenient.Options(expected_root=root, policy=NONE))
    return _row(spark, valid=r.valid, events=r.events_verified, signatures=r.signatures_verified, skipped=r.signatures_skipped, as_sealed=r.chain_root == root)


@query("SELECT true AS valid, count(*) AS events, count(*) AS signatures, 0::BIGINT AS errors, true AS as_sealed FROM events")
def lenient_verify_events(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir, SEED)
    r = lenient.verify_directory(spark, directory, lenient.Options(expected_root=root, trusted_pubkey=SigningKey(SEED).public.hex()))
    return _row(spark, valid=r.valid, events=r.events_verified, signatures=r.signatures_verified, errors=len(r.errors), as_sealed=r.chain_root == root)


#: Records that are lost from, and records whose time is changed in, a sealed log.
_LOST, _EDITED = "sequence % 97 = 13", "sequence % 89 = 5"


@query(f"""
WITH e AS (SELECT sequence FROM ({_EVENTS}) WHERE NOT ({_LOST})),
p AS (SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS before FROM e)
SELECT sequence, 'sequence_gap' AS error_type FROM p WHERE sequence <> before + 1
UNION ALL SELECT sequence, 'chain_break' FROM p WHERE sequence <> before + 1 OR before % 89 = 5
UNION ALL SELECT sequence, 'invalid_signature' FROM e WHERE {_EDITED}""")
def damaged_log_errors(spark, sf_dir):
    """The errors of a log that lost some records, and in which others were edited."""
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    own = F.get_json_object("value", "$.sequence").cast("long").alias("sequence")
    lines = spark.read.text(directory).select(own, "value").where(f"NOT ({_LOST})").orderBy("sequence")
    edited = F.when(F.expr(_EDITED), F.regexp_replace("value", '"event_type":"', '"event_type":"x')).otherwise(F.col("value"))
    log = _as_segments(lines.select(edited.alias("value")), "damaged")
    v = lenient.LenientVerification(segments.scan_directory(spark, log), lenient.Options(trusted_pubkey=SigningKey(SEED).public.hex()))
    return v.errors.select(F.col("sequence").cast("long").alias("sequence"), "error_type")


@query("SELECT 'valid' AS status, count(*) AS events, count(*) AS records, true AS as_sealed FROM events")
def strict_verify_events(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir, SEED, "strict")
    r = strict.verify_directory(spark, directory, SigningKey(SEED).public.hex(), root, capped=False)
    return _row(spark, status=r.status, events=r.events_verified, records=len(r.records), as_sealed=r.chain_root == root)


@query("SELECT ((count(*) + 19999) // 20000)::BIGINT AS segments, count(*) AS events, 1::BIGINT AS first, count(*) AS last, true AS intact, true AS has_size FROM events")
def inspect_stats_events(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir, SEED)
    s = inspect.stats(spark, directory)
    return _row(spark, segments=s["segment_count"], events=s["total_events"], first=s["first_sequence"], last=s["last_sequence"], intact=all(s["integrity"].values()), has_size=s["total_size_bytes"] > 100 * s["total_events"])


@query(f"SELECT sequence, timestamp_ns, event_type, source, true AS has_proof FROM ({_EVENTS})")
def jsonl_export_lines(spark, sf_dir):
    directory, _ = tables.sealed_events(spark, sf_dir)
    lines = export.Export(spark, directory, "jsonl", proofs=True).lines
    return lines.select(F.from_json("text", "sequence long, timestamp_ns long, event_type string, source string, entry_hash string").alias("r")).select("r.sequence", "r.timestamp_ns", "r.event_type", "r.source", F.coalesce(F.length("r.entry_hash") == 64, F.lit(False)).alias("has_proof"))


@query(f"SELECT count(*) FILTER (timestamp_ns >= {record.ns_of_rfc3339('2024-01-03T00:00:00Z')}) AS exported, true AS of_whole_log, bool_and(timestamp_ns >= {record.ns_of_rfc3339('2024-01-03T00:00:00Z')}) AS digests_agree FROM ({_EVENTS})")
def export_manifest(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir)
    m = export.Export(spark, directory, "csv", from_="2024-01-03T00:00:00Z").manifest
    return _row(spark, exported=m.exported_count, of_whole_log=m.source_chain_root == root, digests_agree=m.source_chain_root == m.filtered_export_digest)


@query("SELECT true AS valid, count(*) AS events, true AS as_sealed FROM events")
def streaming_verify_events(spark, sf_dir):
    directory, root = tables.sealed_events(spark, sf_dir)
    v = StreamVerifier(spark, directory, scratch.new_dir(spark, "stream"), lenient.Options(expected_root=root, policy=NONE))
    v.start(once=True).awaitTermination()
    r = v.report()
    return _row(spark, valid=r.valid, events=r.events_verified, as_sealed=r.chain_root == root)


@query("SELECT conv_id::VARCHAR AS chain, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS sequence, true AS has_hash FROM conversations")
def seal_conversations(spark, sf_dir):
    """Every conversation as a chain of its own, sealed side by side."""
    turns = tables.table(spark, sf_dir, "conversations")
    payload = F.to_json(F.struct("role", F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn")))
    rows = turns.select(F.col("conv_id").cast("string").alias("chain"), F.col("turn").cast("long").alias("ts"), F.col("role").alias("event_type"), F.lit("chat").alias("source"), payload.alias("payload"))
    return seal.seal_chains(rows).select("chain", F.col("sequence").cast("long").alias("sequence"), F.coalesce(F.length("entry_hash") == 64, F.lit(False)).alias("has_hash"))
