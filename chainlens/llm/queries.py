"""The queries of this subpackage, with production parameters, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, html, langid, lines, mixing, near_dedup, sharding, topk, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Domains of the sources, and the weights of the mix; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"reference": 3, "web": 2, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2}}
SEED, SHARE, MAX_EPOCHS = 17, (3, 5), 3


def levels() -> dict[str, Column]:
    last = F.substring("source", -1, 1)
    domain = F.when(last.isin("0", "2", "4", "6", "8"), "reference").when(last.isin("1", "3", "5"), "web").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _crc(c: str, n: int) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


def _is(c: Column) -> Column:
    """c, false where it is null: a row without an id is not held out, and not learned from either."""
    return F.coalesce(c, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_crc("doc_id", 4) != 2))
    return langid.identify(docs, model).select("doc_id", _is(_crc("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(table(spark, sf_dir, "documents"), levels(), WEIGHTS, seed=SEED, share=SHARE, max_epochs=MAX_EPOCHS)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels.where(_crc("doc_id", 5) != 0))
    return toxicity.scored(docs, model, spans=True).select("doc_id", _is(_crc("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_fingerprints, op3_line_dedup, op4_mixing, op5_html_extract, op6_bpe, op7_topk, op8_near_dedup, op9_toxicity, op10_sharding)}

_LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, (r.key IS NOT NULL AND k.doc_id <> r.last) AS gone FROM k LEFT JOIN r ON k.key = r.key)
"""

_MIX_LEVEL = """
{n}n AS (SELECT {path}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL),
{n}w AS (SELECT n.*, {weight} AS w, {budget} AS budget FROM {n}n n {join}),
{n}r AS (SELECT *, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {n}w WINDOW r AS ({part} ORDER BY cap::DOUBLE / w, {level})),
{n}f AS (SELECT *, cap * rest <= (budget - before) * w AS is_full FROM {n}r),
{n}o AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS filled, coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER ({part}), 0) AS opened FROM {n}f),
{n} AS (SELECT {path}, (CASE WHEN is_full THEN cap ELSE least(cap, CASE WHEN opened > 0 THEN ((budget - filled)::HUGEINT * w::HUGEINT) // opened::HUGEINT ELSE 0 END) END)::BIGINT AS budget FROM {n}o)
"""


def _mixing_sql() -> str:
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if WEIGHTS.get(level) else "1"
    steps, names = [], ("domain", "lang", "source")
    for i, level in enumerate(names):
        steps.append(_MIX_LEVEL.format(n=f"v{i}", path=", ".join(names[: i + 1]), weight=case(level), level=level, part=f"PARTITION BY {', '.join(names[:i])}" if i else "", budget="u.budget" if i else "(SELECT goal FROM total)", join=f"JOIN v{i - 1} u USING ({', '.join(names[:i])})" if i else ""))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens,
    CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'reference' WHEN right(source, 1) IN ('1', '3', '5') THEN 'web' ELSE 'forum' END AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS avail, (sum(tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL),
total AS (SELECT (sum(avail)::BIGINT * {SHARE[0]} // {SHARE[1]})::BIGINT AS goal FROM leaves),
{",".join(steps)},
g AS (SELECT l.*, v2.budget AS alloc, CASE WHEN avail > 0 THEN v2.budget // avail ELSE 0 END AS whole FROM leaves l JOIN v2 USING (domain, lang, source)),
o AS (SELECT d.*, g.alloc, g.whole, g.alloc - g.avail * g.whole AS rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{SEED}|' || g.whole || '|' || d.doc_id)) AS upto FROM d JOIN g USING (domain, lang, source)),
e AS (SELECT *, unnest(generate_series(0, whole - CASE WHEN rest > 0 AND upto <= rest THEN 0 ELSE 1 END)) AS epoch FROM o)
SELECT doc_id, domain, lang, source, tokens, alloc, epoch::BIGINT AS epoch FROM e"""


ORACLES = {
    "op3_line_dedup": _LINES
    + """
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op4_mixing": _mixing_sql(),
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
