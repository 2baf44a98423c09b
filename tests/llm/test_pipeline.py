"""The pipeline's stages, each on what its predecessor kept, against plain versions; and run() against the stages."""

import base64
import os

import public_tokenizers
import tiktoken

import brute
import corpus_pipeline
import duckdb
from chainlens.llm import queries, toxicity


def rows(df, *names):
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


DATA = "/root/testdata/sf0.01"  # a smaller one has too few toxic documents to learn from


def test_stages(spark, tmp_path):
    data = DATA
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept.append((name, docs, out))
        docs = out
    assert [n for n, _, _ in kept] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(out.columns == columns for _, _, out in kept[:-1])

    # toxicity: what the model scores under 0.5 stays as it is
    _, before, after = kept[0]
    model = toxicity.learn(before, spark.read.parquet(f"{data}/labels.parquet"))
    texts = before.collect()
    scores = toxicity.Tagger(model).score([r["text"] or "" for r in texts])
    assert rows(after, *columns) == sorted(repr(tuple(r)) for r, s in zip(texts, scores, strict=True) if s < 0.5)
    assert 0 < sum(s >= 0.5 for s in scores) < len(texts) / 2

    # line dedup: every document stays
    _, before, after = kept[1]
    own = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert rows(after, "doc_id", "text", "n_chars") == sorted(repr((i, t, len(t))) for i, _, _, t in brute.lines(own))
    assert {r["doc_id"] for r in after.collect()} == {i for i, _ in own}

    # near dedup: one document of each group
    _, before, after = kept[2]
    found = brute.groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert rows(after, *columns) == rows(before.where(before["doc_id"].isin([i for i, (_, g) in found.items() if i == g])), *columns)

    # mixing: as its SQL says, with one epoch
    _, before, after = kept[3]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/near_dedup/*.parquet')")
    epochs = f"* {queries.MAX_EPOCHS})"
    assert epochs in queries.ORACLES["op4_mixing"]
    chosen = con.execute(queries.ORACLES["op4_mixing"].replace(epochs, "* 1)")).fetchall()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r[0] for r in chosen)
    assert rows(after, *columns) == rows(before.where(before["doc_id"].isin([r[0] for r in chosen])), *columns)

    # byte-level BPE
    _, before, after = kept[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.VOCABULARY), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r["doc_id"], other.encode_ordinary(r["text"] or "")) for r in before.collect()]
    assert rows(after, "doc_id", "ids", "n_tokens") == sorted(repr((i, ids, len(ids))) for i, ids in want)

    assert rows(corpus_pipeline.run(spark, data), "doc_id", "ids", "n_tokens") == rows(kept[4][2], "doc_id", "ids", "n_tokens")


def test_stages_take_odd_documents(spark, frame, data):
    docs = frame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (5, "word " * 30_000)]).select("doc_id", "text", "lang", "source", "n_chars", "id", "k")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, data)
            assert out.count() <= at.count()
            if "text" in out.columns:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
                at = out


def test_registered():
    assert set(queries.QUERIES) == {f"op{n}_{x}" for n, x in enumerate("language_id fingerprints line_dedup mixing html_extract bpe topk near_dedup toxicity sharding".split(), 1)}
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
