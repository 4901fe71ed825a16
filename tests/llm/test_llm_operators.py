"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushframe.llm import bpe, langid, mixing, ngram_join, ngram_trie, pq, quality, simple8b, toxicity
from hushframe.llm import html_text as html
from hushframe.llm.components import components
from hushframe.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, n_words int, _id int"
W = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(60))


def rows():
    texts = [BASE, BASE, BASE.replace("word30", "other"), BASE + " more words follow here now", "", None, "one two", "one two", " \n\t", "lang " * 4000, "é漢 😀 " * 20, "a b c d e f g", "The cat sat. The dog ran.\nThe cat sat. The dog ran."]
    made = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], 1, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return [*made, made[0], made[11], (None, BASE, "en", "s1", 1, "x", 1, 2, 3), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_round_trip(docs, none):
    run = lambda d: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = Counter((r.doc_id, r.decoded_sha256) for r in run(docs).collect())
    assert got == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows())
    assert run(none).count() == 0
    coded = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    back = bpe.decode_documents(coded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert Counter(bytes(r.data) for r in back.collect()) == Counter((r[1] or "").encode() for r in rows())


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    simple8b.write_ids(docs, P.path("word_bpe_49k.json"), f"file://{tmp_path}/a", shard_rows=5, record_ids=3000)
    got = simple8b.read_ids(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    want = sorted(((r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh3_64_intdigest(np.array(x[1][:-1], np.uint16).tobytes()) >> 1))
    assert [r.key for r in got] == [k for k, _ in want] and [r.start for r in got] == np.cumsum([0, *(len(i) for _, i in want)])[:-1].tolist()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(i) for _, i in want)
    digest = simple8b.read_ids(spark, f"file://{tmp_path}/a", digest=True)
    assert {r.start: r.ids_crc32 for r in digest.collect()} == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    simple8b.write_ids(none, P.path("word_bpe_49k.json"), f"file://{tmp_path}/b")
    assert simple8b.read_ids(spark, f"file://{tmp_path}/b").count() == 0


def test_lm_scores(docs, none):
    learn = F.col("doc_id") % 4 != 1
    tokens = [([*W.findall((r[1] or "").translate({c: c + 32 for c in range(65, 91)})), None], r[0]) for r in rows()]
    c, pairs, contexts = Counter(), Counter(), Counter()
    for t, k in tokens:
        if k is not None and k % 4 != 1:
            c.update(t)
            before = ["<s>", *t[:-1]]
            pairs.update(zip(before, t, strict=True))
            contexts.update(before)
    n, v, mu = sum(c.values()), len(c), ngram_trie.MU
    want = []
    for t, k in tokens:
        p = [(c[w] + 1) / (n + v + 1) for w in t]
        s = sum(math.log10((pairs[b, w] + mu * q) / (contexts[b] + mu)) for b, w, q in zip(["<s>", *t[:-1]], t, p, strict=True))
        want.append((k, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p)), s))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram_trie.score(docs, learn).collect()), key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and abs(g[5] - w[5]) < 1e-3 * w[1]
    assert ngram_trie.score(none, learn).count() == 0


def brute_join(items):
    def grams(t):
        w = W.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in items]
    near = [[j for j in range(len(items)) if j != i and items[i][0] is not None and items[j][0] is not None and sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in range(len(items))]
    label = [k for k, _ in items]
    for _ in items:
        for i, js in enumerate(near):
            for j in js:
                label[i] = min(label[i], label[j])
    return sorted(((k, len(js), c) for (k, _), js, c in zip(items, near, label, strict=True)), key=str)


def test_ngram_join(spark, docs, none):
    got = ngram_join.join(docs).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=str) == brute_join([(r[0], r[1]) for r in rows()])
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([0, 4, 5, 6, 8, 9, 10, 11, 12, None, None])
    assert ngram_join.join(none).count() == 0 and ngram_join.representatives(none).count() == 0


def test_ngram_join_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    items = [(i, BASE.replace(f"word{i % 50}", f"new{i}")) for i in range(40)] + [(100 + i, BASE) for i in range(5)]
    got = ngram_join.join(spark.createDataFrame(items, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=str) == brute_join(items)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    x[20:30] = x[:10] + 0.02 * rng.normal(size=(10, 8))
    x[30] = 2 * x[0]
    values = [[float(v) for v in r] for r in x.astype(np.float32)]
    items = [(i, v) for i, v in enumerate(values)] + [(50, values[1]), (51, values[1]), (60, None), (61, [0.0] * 8), (62, [math.nan] * 8), (63, [None] * 8), (64, [1.0, 2.0]), (65, []), (1, values[1])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in items], "vec_id long, embedding array<float>, label int, n_links string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pq.link(df, block=16).collect())
    good = [k for k, (_, v) in enumerate(items) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(items[k][1], float) / np.linalg.norm(items[k][1]) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.95] for k in good}
    label = [i for i, _ in items]
    for _ in items:
        for k in good:
            label[k] = min([label[k], *(label[j] for j in near[k])])
    assert got == sorted((i, len(near.get(k, ())), label[k], i == label[k]) for k, (i, _) in enumerate(items))
    assert pq.link(df.limit(0)).count() == 0 and pq.link(df.filter("vec_id = 61")).first().n_links == 0


def test_quality(docs, none):
    got = quality.judge(docs, ["doc_id"]).collect()
    assert len(got) == len(rows()) and all(not r.kept for r in got if r.base_failed)
    assert {r.doc_id for r in got if r.kept} == {0, 1, 2, 3, None}
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality.judge(none, ["doc_id"]).count() == 0 and quality.kept_rows(none).count() == 0


def test_quality_thresholds_follow_the_source(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    marked = " ".join(f"w{i}#" for i in range(80))
    made = [(i, plain, "en", "prose") for i in range(150)] + [(1000 + i, marked, "en", "code") for i in range(150)] + [(5000, marked, "en", "prose")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert got[0] and got[1000] and not got[5000]
    # sketches merge by adding: of halves as of the whole
    m = quality.measure(spark.createDataFrame(made, "doc_id long, text string, lang string, source string"), ["lang", "source"])
    whole = sorted(map(tuple, quality.sketch(m).collect()))
    halves = quality.sketch(m.limit(120)).union(quality.sketch(m.exceptAll(m.limit(120)))).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n"))
    assert sorted(map(tuple, halves.collect())) == whole


def water(sizes, weights, most):
    total, caps = sum(sizes), [most * s for s in sizes]
    full = set()
    while True:
        left, open_ = total - sum(caps[i] for i in full), [i for i in range(len(sizes)) if i not in full]
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > caps[i]}
        if not over:
            return [caps[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_water_filling(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 20):
        sizes = [int(x) for x in rng.integers(0, 5000, n) ** rng.integers(1, 3)]
        names = [f"s{i:02}" for i in range(n - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3)
        assert [got[k] for k in names] == pytest.approx(want)


@pytest.mark.parametrize("most", [0, 20_000])
def test_mixing(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    made = [(i, "w " * (i % 37), f"s{i % 4}" if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    one, two = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    taken, target = Counter(), {}
    for r in one:
        taken[r.source] += r["copies"] * r["size"] + r["part"]
        target[r.source] = r["target"]
        assert r["copies"] * r["size"] + r["part"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert mixing.repeated(docs).columns == docs.columns and mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_language(docs, none):
    profiles = langid.fit(langid.training_sample(docs, F.col("doc_id") % 2 == 0))
    got = langid.predict(docs, profiles, ["doc_id"]).collect()
    assert len(got) == len(rows()) and all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 8, None}
    assert langid.told_rows(docs, profiles, 0.1).columns == docs.columns
    assert langid.predict(none, {}, ["doc_id"]).count() == 0 and {r.lang_pred for r in langid.predict(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (0, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, F.col("doc_id") >= 0)
    got = toxicity.score(docs, m, ["doc_id"], spans=True).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, m, ["doc_id"]).count() == 0 and toxicity.train(none, labels, F.lit(True)).score("x") < 0.5


def test_html(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some text. Here.</article>", "t"), (2, None, None, None), (None, "u", "", "t"), (1, "u", "<article><p>Some text. Here.</article>", "t")], "page_id long, url string, html string, text string")
    got = html.extract_pages(df, ["page_id", "url"]).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("Some text. Here.", 16), ("Some text. Here.", 16)]
    assert html.extract_pages(df.limit(0), ["page_id"]).count() == 0


def test_queries_are_one_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
