"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from chainlens.llm import bpe, common, fingerprints, html, langid, linkage, lines, mixing, near_dedup, queries, sharding, topk, toxicity
import public_tokenizers

PATH, PATTERN = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN
WORDS = [f"w{i}" for i in range(300)]
#: SHA-256 of the signatures of a few texts, as made one event at a time.
SIGNATURES = "2d47c4fc34502158737f87d847e6aa6eae0320d6aab0090f43778c42bf48d2ae"
LONG = " ".join(WORDS[i * i % 300] for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, LONG), (7, LONG + " more"), (8, "\n".join(["x" * 50] * 3)), (9, "é" * 30 + "日本"), (None, "no id"), (4, "again four")]


def same_columns(out, docs):
    return out.schema == docs.schema


@pytest.fixture()
def odd(frame):
    return frame(ROWS)


def test_langid(spark, odd, frame):
    model = langid.train({"a": "abc abd abe " * 50, "b": "xyz xyw xyv " * 50})
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) >= 9
    parser = langid.Parser(model)
    assert parser.predict(["abd abc abe abc" * 9, "xyw xyz" * 9, "123", "", "abc"])[0] == ["a", "b", "und", "und", "a"]
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.Parser(langid.train({})).predict(["x"]) == (["und"], [0.0])


def longest_matches(sample, text):
    """Phrases of the greedy parse, one match after the other."""
    norm = lambda x: "".join(c if c.isalpha() else "_" for c in x.lower())
    sample, text, at, n = norm(sample), norm(text), 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at, n = at + max(1, k - 1), n + 1
    return n


@pytest.mark.parametrize("cells", [langid.CELLS, 0])
def test_phrases_are_longest_matches(cells, monkeypatch):
    """Over blocks' ends too, in texts that repeat, with alphabets of thousands of letters, by both kinds of tables."""
    monkeypatch.setattr(langid, "CELLS", cells)
    rng = random.Random(11)
    samples = {"a": "ab" * 300, "l": "abracadabra, the raven; " + LONG[:5000], "z": "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000))}
    parser = langid.Parser(langid.train(samples))
    texts = ["", "ab" * 900, "abrab raven qqq cadaven" * 60, LONG[3000:6000], samples["z"][100:900], "½ 1", "a" * 700, "abbab" * 300, "é𝔞" * 40]
    assert parser.phrases(texts)[0].tolist() == [[longest_matches(samples[k], t) for k in sorted(samples)] for t in texts]
    assert parser.predict(["½", samples["z"][700:800]])[0] == ["und", "z"]


def test_languages_of_thousands_of_letters(spark, frame):
    rng = random.Random(12)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    own = [han(600) for _ in range(20)]
    rows = [(i, own[i]) for i in range(20)] + [(100 + i, " ".join(rng.choices(WORDS, k=100))) for i in range(20)]
    model = langid.fit(frame(rows, lang={i: "zh" for i in range(20)}))
    assert len(model.letters) > 2500
    assert {r["lang_pred"] for r in langid.identify(frame([(1, x[200:300]) for x in own]), model).collect()} == {"zh"}
    # the sample is dealt evenly to all documents, and isn't made of their beginnings
    assert langid.shares(["a" * 10, "b" * 1000, "c" * 30], 100) == ["a" * 10, "b" * 57, "c" * 30]


def test_fingerprints(spark, odd, frame):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["fingerprint"])
    assert by[1] == by[2] == by[3] and by[4][0] in by[5] and len(set(by[6] + by[7])) == 2
    report = fingerprints.edit_report(odd).collect()
    assert len(report) == len(ROWS)
    none = [r for r in report if r["doc_id"] is None]  # its own next one, and nobody else's
    assert [(r["n_chars"], r["near_next"], r["edited_sha256"]) for r in none] == [(5, 1.0, brute.sha("no in"))]
    order = sorted([(i, t or "") for i, t in ROWS if i is not None])
    want = {(i, brute.sha(fingerprints.edited(t, after))) for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True)}
    assert {(r["doc_id"], r["edited_sha256"]) for r in report if r["doc_id"] is not None} == want
    one = fingerprints.edit_report(frame([(3, "a b c d e f g h")])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 15
    assert fingerprints.edit_report(odd.limit(0)).count() == 0


def test_fingerprints_of_many_buckets(spark, frame, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choices(WORDS, k=rng.randrange(60)))) for i in range(83)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edit_report(frame(rows)).collect()}
    order = sorted(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        assert got[i] == brute.sha(fingerprints.edited(t, following))


def test_lines(spark, odd, frame, monkeypatch):
    rng = random.Random(2)
    pool = ["A long line that many of the documents hold, number %d" % k for k in range(6)] + ["short", "", "É" * 39 + "x", "É" * 38 + "x"]
    rows = [(rng.randrange(12) if rng.random() < 0.9 else None, "\n".join(rng.choice([str.lower, str.upper, lambda s: f" \t{s}\r"])(rng.choice(pool)) if rng.random() < 0.8 else "own" for _ in range(rng.randrange(9)))) for _ in range(40)] + ROWS
    docs = frame(rows)
    want = sorted(map(repr, brute.lines(rows)))
    for limit in (lines.INDEX_BYTES, 0):  # arrays broadcast, and shards probed where they are
        monkeypatch.setattr(lines, "SHARD_KEYS", 200_000 if limit else 3)
        out = lines.deduplicated(docs, index_bytes=limit, out="cut_")
        assert set(docs.columns) < set(out.columns)
        assert sorted(repr((r["doc_id"], r["cut_lines"], r["cut_dropped"], r["text"])) for r in out.collect()) == want
        assert lines.deduplicated(docs.limit(0), index_bytes=limit).count() == 0
    taken = lines.deduplicated(docs.withColumn("n_dropped", F.lit("own")))  # a caller's columns stay
    assert {"n_lines", "n_dropped", "n_lines_", "n_dropped_"} <= set(taken.columns) and {r["n_dropped"] for r in taken.collect()} == {"own"}


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)
    ph = lines.PerfectHash.build(keys)
    assert sorted(ph.index(keys)) == list(range(5000))
    assert len(lines.PerfectHash.build(keys[:0]).index(keys[:3])) == 3


def test_line_index_in_shards(spark, frame, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 7)
    rows = [(i, "\n".join(f"{k:050d}" for k in range(40))) for i in range(6)]
    out = lines.deduplicated(frame(rows), out="cut_").collect()
    assert {r["doc_id"]: r["cut_dropped"] for r in out} == {i: 40 if i < 5 else 0 for i in range(6)}


@pytest.mark.parametrize("operator, sets", [(near_dedup.near_groups, False), (fingerprints.near_duplicates, True)])
def test_near_groups(spark, frame, operator, sets, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 8)  # several blocks of a bucket
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = [(i, t) for i, t in ROWS if i not in (None, 4)]
    for i in range(40):  # near copies, of which not every two are alike
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(base)) for i in range(3)]
    got = {r["doc_id"]: (r["class_id"], r["group_id"]) for r in operator(frame(rows)).collect()}
    assert got == brute.groups(rows, sets=sets)
    assert operator(frame(rows).limit(0)).count() == 0


def test_dedup_keeps_one_of_each_group(spark, odd, frame):
    out = near_dedup.deduplicated(odd)
    assert same_columns(out, odd)
    got = out.collect()
    # null ids stay, as do texts that differ in white space alone; rows sharing an id are one document, of the least digest
    assert sorted((r["doc_id"] or -1) for r in got) == [-1, 1, 3, 4, 5, 6, 8, 9] and {r["doc_id"]: r["text"] for r in got}[4] == "again four"


def test_sketches_rule_out_with_stated_odds():
    for n, p in ((180, 0.8), (128, 0.8), (128, 0.5)):
        chance = lambda k: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k))  # noqa: B023, E731
        k = linkage.least_agreeing(n, p)
        assert chance(k) <= linkage.ODDS < chance(k + 1)


def test_planted_pairs_are_found(spark, frame):
    """Pairs whose likeness is 0.8 or little more: 0.99 of them at least."""
    rng = random.Random(13)
    rows, pairs = [], []
    for i in range(600):
        w = [f"p{i}q{k}" for k in range(300)]
        n = rng.randrange(28, 34)  # words replaced at one end: 28 to 33 of 296 shingles less on either side
        near = w[:-n] + [f"r{i}s{k}" for k in range(n)]
        if brute.likeness(brute.bag(" ".join(w)), brute.bag(" ".join(near))) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_groups(frame(rows)).collect()}
    assert len(pairs) > 400 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(got[2 * i] != got[2 * i + 1] for i in range(600) if (2 * i, 2 * i + 1) not in pairs)


def test_small_buckets_are_done_after_the_rounds(spark, frame, monkeypatch):
    """Pairs and triples that share buckets and are not alike don't have them settled again; a link that no least id has is found."""
    rng, rows, settled = random.Random(17), [], []
    for i in range(30):
        base = [f"s{i}w{k}" for k in range(120)]
        other = lambda n: [*base[:-n], *(f"s{i}r{rng.randrange(10**9)}" for _ in range(n))]  # noqa: B023, E731
        far = other(30)  # at a likeness of about 0.6
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(far))]
        if i % 2:
            rows.append((3 * i + 2, " ".join(far[:-2] + ["x", "y"])))
    real = linkage._settled
    monkeypatch.setattr(linkage, "_settled", lambda *a: settled.append(a[2]) or real(*a))
    got = {r["doc_id"]: (r["class_id"], r["group_id"]) for r in near_dedup.near_groups(frame(rows)).collect()}
    assert got == brute.groups(rows)
    assert sum(i != g for i, (_, g) in got.items()) == 15 and not settled


@pytest.mark.parametrize("at_a_time", [1, 5, 32])
def test_signatures_whatever_is_made_at_a_time(at_a_time, monkeypatch):
    """Of texts whose shingles repeat thousands of times, too: the first event of each register, made one after the other."""
    rng = random.Random(18)
    texts = ["a " * 3000 + "b c", "", "x y z", " ".join(rng.choices(WORDS, k=400)), ("p q r s t " * 700 + " ".join(WORDS[:50]))]
    monkeypatch.setattr(near_dedup, "AT_A_TIME", at_a_time)
    sig = near_dedup.signatures(*near_dedup.bags(*common.shingle_hashes(texts, 5)), len(texts))
    assert hashlib.sha256(sig.tobytes()).hexdigest() == SIGNATURES


def test_buckets_are_joined_with_salts(spark, frame, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    base = [f"b{k}" for k in range(80)]
    rows = [(i, " ".join([*base[: i % 7], "new", *base[i % 7 + 1 :]])) for i in range(60)] + [(100, "other text"), (100, "other text"), (101, "a b c"), (101, "other text")]
    found = near_dedup.near_groups(frame(rows)).collect()
    got = {r["doc_id"]: r["group_id"] for r in found}
    assert len(found) == len(rows) and {got[i] for i in range(60)} == {0} and got[100] == 100 and got[101] in (100, 101)


def test_bag_signatures_are_unbiased():
    rng = random.Random(5)
    errors = []
    for _ in range(30):
        a, b = (" ".join(rng.choice(["a b c d e", "f g h i j", "k l m n o p"]) for _ in range(40)) for _ in range(2))
        h, begin = common.shingle_hashes([a, b])
        sig = near_dedup.signatures(*near_dedup.bags(h, begin), 2)
        errors.append((sig[0] == sig[1]).mean() - near_dedup.likeness(h[: begin[1]], h[begin[1] :]))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["id"]: r["root"] for r in linkage.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_chains_of_components_whatever_joins_them(spark, monkeypatch, most):
    """A chain in no order, a star, a pair and a loop: few links take one table, not one for each round of labels; more give the same."""
    rng, tables, real = random.Random(19), [], linkage.stored
    order = rng.sample(range(30), 30)
    edges = [*zip(order, order[1:]), *((900 - i, 900) for i in range(1, 99)), (2000, 1000), (1000, 2000), (7000, 7000)]  # noqa: B905
    monkeypatch.setattr(linkage, "LINKS", most)
    monkeypatch.setattr(linkage, "stored", lambda *a: tables.append(a[1]) or real(*a))
    got = {r["id"]: r["root"] for r in linkage.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in order} | {i: 802 for i in range(802, 901)} | {1000: 1000, 2000: 1000, 7000: 7000}
    assert (len(tables) == 1) == (len(edges) <= most)
    assert linkage.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_take_bounded_pieces():
    """Texts are sketched about half a megabyte at a time, and all of them are."""
    seen = []
    sketch = lambda texts: seen.append(sum(map(len, texts))) or near_dedup.sketch(texts)
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(200))) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"i": [i for i, _ in rows], "d": [b""] * len(rows), "t": [t for _, t in rows]})
    out = list(linkage.sketch_batches(iter([batch]), sketch))
    assert sum(b.num_rows for b in out) == len(rows) and sum(seen) == sum(len(t) for _, t in rows)
    assert len(seen) > 2 and max(seen) <= 576 << 10


def test_mixing(spark, odd, frame):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    docs = frame([(i, "t " * 10) for i in range(100)] + [(200, None), (201, ""), (5, "t " * 10)], lang={i: "de" for i in range(50)}, source={i: f"s{i % 3}" for i in range(100)})
    out = mixing.mixed(docs, levels, {"lang": {"de": 3, "en": 1}}, share=(1, 2), max_epochs=1)
    assert same_columns(out, docs)
    got = out.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("t"))).alias("n")).collect()
    n = {r["lang"]: r["n"] for r in got}
    assert 340 <= n["de"] <= 510 and n["en"] >= 60 and sum(n.values()) <= 505  # a shortage goes to siblings
    nothing = mixing.mixed(docs, levels, {}, total=0, max_epochs=1)
    assert nothing.count() == 0 and mixing.mixed(docs.limit(0), levels, {}).count() == 0
    everything = mixing.chosen(docs, levels, {}, total=10**9, max_epochs=2)
    assert everything.where("tokens > 0").groupBy("doc_id").count().where("count < 2").count() == 0
    assert mixing.chosen(odd, levels, {}).count() > 0


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "a", 10), ("x", "b", 1000), ("y", "c", 1000)], "l0 string, l1 string, avail long")
    got = {r["l1"]: r["alloc"] for r in mixing.budgets(leaves, ["l0", "l1"], {}, 1000, 1).collect()}
    assert got == {"a": 10, "b": 490, "c": 500}  # what a can't take stays in x
    got = {r["l1"]: r["alloc"] for r in mixing.budgets(leaves, ["l0", "l1"], {"l0": {"x": 3, "y": 1}}, 1800, 1).collect()}
    assert got == {"a": 10, "b": 1000, "c": 790}  # and what x can't take goes to y


def test_html_cases():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies on this site and so on, and on, and on, for a long time.</div><article><h1>Head</h1><p>The first &amp; best   paragraph,\n which is long enough to be taken for text by anyone.</p><p>And a second one: it also ends with a full stop, as sentences do &#8211; mostly.</p></article><aside>Related: more</aside><footer>Imprint</footer><script>var x='<p>no</p>'</script></body></html>"
    assert html.main_text(page) == "Head\nThe first & best paragraph, which is long enough to be taken for text by anyone.\nAnd a second one: it also ends with a full stop, as sentences do – mostly."
    for cut in range(0, len(page), 7):
        html.main_text(page[:cut])
    assert html.main_text("") == ""
    assert html.main_text("<p>" * 5000 + "deep") is not None
    assert html.main_text("<!-- <p>hidden</p> -->") == ""


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 9)
        score = [rng.uniform(-2, 2) for _ in range(n)]
        joins = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda x: sum(abs(s) for s, v in zip(score, x, strict=True) if v != (s > 0)) + sum(w for i, j, w in joins if x[i] != x[j])  # noqa: B023, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(html.minimum_cut(score, joins)) - best) < 1e-9


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "v", "<article><p>Text of some length that is certainly the main one here, is it not.</p></article>", 2)], "page_id long, url string, html string, text int")
    got = html.extract(pages).collect()
    assert [(r["page_id"], r["url"], r["n_chars"] > 0) for r in got] == [(1, "u", False), (2, None, False), (None, "v", True)]
    assert html.extract(pages.limit(0)).count() == 0


def test_bpe(spark, odd):
    v = bpe.Vocabulary.read(PATH)
    e = bpe.Encoder(v, PATTERN)
    rng = random.Random(7)
    for _ in range(300):
        piece = bytes(rng.choices(b"abcdet hn  ing\xc3\xa9\xff", k=rng.randrange(1, 30)))
        want = tuple(v.merged(piece))
        p = bpe.Prefixes(v, piece)
        assert p.ids() == want and e._ids(piece) == want
        p.append(b"tion")
        assert p.ids() == tuple(v.merged(piece + b"tion"))
        a = rng.randrange(len(p.piece))
        b = rng.randrange(a, len(p.piece) + 1)
        changed = p.piece[:a] + b"xyz" + p.piece[b:]
        assert p.edit(a, b, b"xyz") <= len(changed) and p.ids() == tuple(v.merged(changed))
    coded = bpe.encode(odd, PATH, PATTERN)
    back = bpe.decode(coded, PATH, PATTERN)
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"]).decode()) for r in back.collect()) == sorted((i or 0, t or "") for i, t in ROWS)
    assert coded.where("doc_id <= 2").select(F.max(F.size("ids"))).first()[0] == 0
    assert bpe.encode(odd.limit(0), PATH, PATTERN).count() == 0


def test_encoders_go_before_other_work(spark):
    """A worker keeps the encoder from task to task, but not beside another operator's texts."""

    class Frame:
        """Gives what would run in a worker."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    same = lambda batch: batch
    batch = pa.RecordBatch.from_pydict({"i": [1], "d": [b""], "t": ["a text"]})
    others = [common.map_batches(Frame(), same, ""), lines._hashed(Frame(), 40, "t", "i"), linkage._sketched(Frame(), near_dedup.sketch, "t", "i")]
    for run in others:
        kept = bpe.encoder(PATH, PATTERN)
        list(common.map_batches(Frame(), same, "", keeps="bpe")(iter([batch])))
        assert bpe.encoder(PATH, PATTERN) is kept and kept.encode("thingummy") and "tails" not in vars(kept.v)
        next(run(iter([batch])))
        assert not bpe._ENCODERS


def test_topk(spark):
    rng = np.random.default_rng(8)
    vectors = [(int(i), [float(x) for x in v], "x") for i, v in zip(rng.permutation(400), rng.integers(-3, 4, (400, 6)) / 256, strict=True)]
    vectors += [(1000, None, "n"), (1001, [float("nan")] * 6, "n"), (1002, [1.0, None], "n"), (None, [1.0] * 6, "n"), (1050, [], "e"), (1003, [0.5], "s"), (50, [0.01] * 6, "again"), (1100, [float("inf")], "n")]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank string")
    usable = [(i, [int(np.floor(x * 256)) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in usable if i % 50 == 0}:
        best = []
        for own in [v for i, v in usable if i == q]:
            best += [(-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in usable if i != q]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(best)[:5], 1)}
    got = {tuple(r) for r in topk.search_every(table).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == want
    assert topk.search_every(table.limit(0)).count() == 0
    few = topk.search_every(table.where("vec_id IN (0, 1, 2)")).collect()
    assert len(few) == 2


@pytest.mark.parametrize("spread", [1, 5, 200, 1 << 29, 1 << 33])
def test_lists_give_the_best(spread):
    """Few dimensions and many, ties, repeated ids, floors, and components whose products pass a double's or a long's half."""
    rng = np.random.default_rng(spread)
    for dims, n in ((1, 300), (3, 800), (40, 300), (2, 3)):
        v = rng.integers(-spread, spread + 1, (n, dims))
        q = np.concatenate((v[:6], np.zeros((1, dims), np.int64)))[:n]
        ids = rng.integers(0, n, n)
        lists, own = topk.Lists(ids, v), ids[: len(q)]
        floor = np.where(np.arange(len(q)) % 2 == 0, topk._NEVER, 0)
        try:
            got = topk.ranked(*lists.best(q, own, 5, floor)[:3], 5)
        except ValueError:
            assert spread == 1 << 33
            continue
        for x in range(len(q)):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(q[x], w, strict=True)), int(i)) for i, w in zip(ids, v, strict=True) if i != own[x])[:5]
            have = [(-int(s), int(i)) for j, i, s in zip(*got, strict=True) if j == x]
            assert have == [w for w in want if -w[0] >= floor[x]]


def test_topk_stops_early():
    rng = np.random.default_rng(9)
    v = np.zeros((4000, 8), np.int64)
    v[:, 0], v[:, 1] = rng.permutation(4000), rng.permutation(4000)
    lists = topk.Lists(np.arange(4000), v)
    q = np.array([[1, 0, 0, 0, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0, 0, 0], [2, 1, 0, 0, 0, 0, 0, 0]])
    query, ids, score, scored = lists.best(q, np.full(3, -1), 5, np.full(3, topk._NEVER))
    query, ids, score = topk.ranked(query, ids, score, 5)
    assert score[query == 0].tolist() == [3999, 3998, 3997, 3996, 3995] and scored < 2000
    want = np.sort(v @ q[2])[::-1][:5]
    assert score[query == 2].tolist() == want.tolist()


def test_topk_in_many_blocks(spark, monkeypatch):
    for name, n in (("BLOCK", 40), ("QUERY_BLOCK", 3), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(10)
    v = rng.integers(-60, 61, (500, 5))
    v[100:300] = v[100]  # one vector many times
    table = spark.createDataFrame([(i, [float(x) / 256 for x in r]) for i, r in enumerate(v.tolist())] + [(50, [0.1] * 5)] * 100, "vec_id long, embedding array<double>")
    extra = [(50, (25, 25, 25, 25, 25))] * 100
    rows = list(enumerate(map(tuple, v.tolist()))) + extra
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search_every(table).collect()}
    assert len(got) == 50
    for q in range(0, 500, 50):
        best = sorted({(-sum(a * b for a, b in zip(x, w, strict=True)), n, i) for j, x in rows if j == q for n, (i, w) in enumerate(rows) if i != q})
        want, seen = [], set()
        for s, n, i in best if q != 50 else []:
            want.append((i, -s))
        if q != 50:  # the repeated id's own best are those of all its rows
            assert [got[q, r] for r in range(1, 6)] == sorted(want, key=lambda w: (-w[1], w[0]))[:5]
    with pytest.raises(Exception, match="fit a long"):
        topk.search_every(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_toxicity(spark, odd, frame):
    rng = random.Random(10)
    clean = [" ".join(rng.choices(WORDS, k=40)) for _ in range(300)]
    bad = [" ".join([*rng.choices(WORDS, k=20), "vileword", *rng.choices(WORDS, k=20)]) for _ in range(60)]
    model = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in bad])
    tagger = toxicity.Tagger(model)
    assert min(tagger.score(bad)) > 0.5 > max(tagger.score(clean))
    text = "w1 w2 Vileword w3"
    assert [text[a:b] for a, b, _ in tagger.spans(text)] == ["Vileword"] and tagger.spans("w1") == []
    got = toxicity.scored(odd, model, spans=True).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 and not r["spans"] for r in got)
    long = LONG + " vileword"
    assert tagger.score([long])[0] > 0.5
    assert same_columns(toxicity.without_toxic(frame([(1, bad[0]), (2, clean[0]), (None, None)]), model), odd)
    assert sorted(r["doc_id"] or 0 for r in toxicity.without_toxic(frame([(1, bad[0]), (2, clean[0]), (None, None)]), model).collect()) == [0, 2]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    low = toxicity.learn(odd, labels)
    assert all(s < 0.5 for s in toxicity.Tagger(low).score(["", "x", LONG]))
    assert all(s < 0.5 for s in toxicity.Tagger(toxicity.learn(odd.limit(0), labels.limit(0))).score(["", "x"]))


def test_marginals_as_enumerated():
    """Forward-backward against the sum over all labellings."""
    model = toxicity.Model({"a=": 3.0, "b=": -1.0, "c=": 0.5, "a=2": 0.8, "b=2": 9.0}, -1.5, -0.7, (1.0, 0.4, 0.6, 2.0))
    words = ["a", "b", "q", "c", "a"]
    got = toxicity.Tagger(model).odds([" ".join(words)])[0]
    weight, own = np.zeros((5, 2)), {"a": 3.8, "b": -1.0, "c": 0.5, "q": 0.0}  # a occurs twice
    for m in range(32):
        y = [m >> k & 1 for k in range(5)]
        w = np.exp(sum((model.bias + own[t]) * v for t, v in zip(words, y, strict=True)) + model.start * y[0])
        for p, q in zip(y, y[1:], strict=False):
            w *= model.trans[2 * p + q]
        for k in range(5):
            weight[k, y[k]] += w
    assert np.allclose(got, weight[:, 1] / weight[:, 0])


def test_sharding(spark, frame):
    rng = random.Random(12)
    rows = [(i, "x" * rng.randrange(300)) for i in range(500)] + [(1000 + i, "copy of one text") for i in range(300)] + [(None, None), (7, "y"), (7, "y"), (2000, "z" * 40_000), (2001, "")]
    got = [r.asDict() for r in sharding.sharded(frame(rows)).collect()]
    assert len(got) == len(rows)
    text = {}
    for r in got:
        text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in text.values())
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    rest = sorted(sizes)[:-1]
    assert max(rest) - min(rest) <= 6_000
    assert sharding.sharded(frame(rows).limit(0)).count() == 0
    assert {r["shard"] for r in sharding.sharded(frame([(1, "a")])).collect()} <= set(range(8))
    plan = sharding.sharded(frame(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scratch_tables_are_in_the_shared_folder(spark):
    t = common.stored(spark.range(3).toDF("a"), "x")
    assert t._chainlens_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert t.count() == 3
    common.dropped(t)
