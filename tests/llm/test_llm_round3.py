"""Suffix-array dedup, filter audit and fill-in-middle: against brute force, on odd rows and on a whole table."""

import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import filter_audit, fim, html_text, ngram_trie, suffix_dedup
from hushframe.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, k0 int, n long, kept string"
LONG = "".join(f"sentence number {i} of a long passage; " for i in range(9))


def rows():
    texts = [LONG, "x " + LONG + "y", LONG[:150], LONG[60:170] * 2, "a" * 300, "ab" * 150, None, "", "é漢😀" * 40, "q" + "é漢😀" * 40, "<P> held", "The Cat 1#2\nsat DOWN", " \t\n", "LOUD " * 130, "z" * 99, "word " * 5000]
    made = [(i, t, ("en", "de", None, "")[i % 4], "s", 1, 2, "k") for i, t in enumerate(texts)]
    return [*made, made[1], made[4], (None, LONG, "en", "s", 1, 2, "k"), (None, None, None, None, None, None, None), (3, "other text of the same id " * 9, "en", "s", 1, 2, "k"), (2, LONG + "tail", "en", "s", 1, 2, "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(pairs):
    """(id, text) to (bytes, removed, spans, kept), by a dictionary of all runs."""
    key = lambda i: (i is None, i or 0)
    coded = [(key(i), (t or "").encode()) for i, t in pairs]
    first: dict = {}
    for k, t in coded:
        for i in range(len(t) - 99):
            first[t[i : i + 100]] = min(first.get(t[i : i + 100], (k, i)), (k, i))
    out = []
    for k, t in coded:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < (k, i):
                gone[i : i + 100] = True
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def test_cover():
    p, c = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_sorted(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 150))) for _ in range(6)] + ["a" * 200, "xyz" * 70]
    data = "".join(rng.choice(parts) for _ in range(25)).encode()
    places = np.arange(len(data) - 99)
    order, like = suffix_dedup.Suffixes(data).sorted(places)
    begin = [data[p : p + 100] for p in order]
    assert sorted(order) == places.tolist() and begin == sorted(begin)
    assert like.tolist() == [False, *(a == b for a, b in itertools.pairwise(begin))]


@pytest.mark.parametrize("seed", range(12))
def test_repeats_by_buckets(seed, monkeypatch):
    """Any slices, blocks, buckets and common windows give the same intervals."""
    rng = random.Random(seed)
    for name, values in (("BLOCK", (1, 60, 1 << 20)), ("SLICE", (90, 900, 1 << 22)), ("GATHER", (300, 1 << 25))):
        monkeypatch.setattr(suffix_dedup, name, rng.choice(values))
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 260))) for _ in range(8)] + ["a" * 250, "xy" * 90, "é漢😀" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(25)), pa.array([0] * 25), pa.array(texts)], names=["number", "digest", "t"])
    common = np.random.default_rng(seed).random(suffix_dedup.SLOTS) < rng.choice([0, 0.5])
    buckets: dict = {}
    for sent in suffix_dedup._sender(rng.choice([1, 5]), common)(iter([batch])):
        for r in sent.to_pylist():
            buckets.setdefault(r["bucket"], []).append(r)
    begins = [np.zeros(len(t.encode()), bool) for t in texts]
    for sent in buckets.values():
        found = suffix_dedup._sorter(pa.Table.from_pylist(sent, schema=suffix_dedup._batch([]).schema))
        for d, a, b in zip(*(found[c].to_pylist() for c in ("number", "start", "end")), strict=True):
            begins[d][a:b] = True
    seen: set = set()
    for t, got in zip((t.encode() for t in texts), begins, strict=True):
        for i in range(len(t) - 99):
            assert got[i] == (t[i : i + 100] in seen)
            seen.add(t[i : i + 100])


def test_suffix_dedup_odd_rows(docs, none):
    got = Counter((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffix_dedup.dedup(docs, ["doc_id"]).collect())
    pairs = [(r[0], r[1]) for r in rows()]
    assert got == Counter((i, *c) for (i, _), c in zip(pairs, cut(pairs), strict=True))
    assert suffix_dedup.dedup(none, ["doc_id"]).count() == 0
    clash = suffix_dedup.dedup(docs, ["kept", "n", "k0"])
    assert clash.columns == ["kept", "n", "k0", "n_bytes", "spans", "kept"] and clash.count() == len(rows())
    at = next(r for r in suffix_dedup.dedup(docs, ["doc_id", "text"]).collect() if r.doc_id == 1)
    whole = at.text.encode()
    assert b"".join(whole[a:b] for a, b in zip([0, *(s.end for s in at.spans)], [*(s.start for s in at.spans), len(whole)], strict=True)) == bytes(at.kept)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_op11_whole_table(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (*c[:3], hashlib.sha256(c[3]).hexdigest()) for r, c in zip(table, cut([tuple(r) for r in table]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op11_suffix_dedup"](spark, FOLDER).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_walk_visits_orders_by_swaps():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def plain_audit(table, labelled):
    """part, order, step to counts, document by document."""
    first: dict = {}
    for i, t, _ in table:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    told = []
    for i, t, lang in table:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        told.append((lang or "", fails, any(a == i and q == 1 for a, q, _ in labelled), any(a == i and x == 1 for a, _, x in labelled)))
    out = {}
    for part in {p for p, *_ in told}:
        mine, gains = [x for x in told if x[0] == part], Counter()
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                gains[f] += len(gone)
                out[part, "".join("ABCDE"[k] for k in order), step] = [len(left), len(gone), sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and sum(x[1]) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(gains["ABCDE".index(order[step - 1])])
    return out


def test_filter_audit_odd_rows(spark, docs, none):
    labelled = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (9, None, 1), (13, 1, 1), (77, 1, 1)]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit(docs, labels).collect()}
    want = plain_audit([r[:3] for r in rows()], [x for x in labelled if x[0] is not None])
    assert got == want and len(got) == 3 * 600
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).count() == 3 * 600


TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def plain_fim(key, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    w = TOKEN.findall(t)
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, len(w), "plain", t, None, None
    return (key, len(w), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < 20 else (key, len(w), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


@pytest.mark.parametrize("bytes_at_once", [1, 700, 1 << 24])
def test_fill_in_middle_odd_rows(spark, docs, none, bytes_at_once, monkeypatch):
    monkeypatch.setattr(fim, "SLICE", bytes_at_once)
    more = [(100 + i, "<" * (i % 5) + "S>M>P><S" + "é漢😀a b" * i + "<M" * (i % 3), "en", "s", 1, 2, "k") for i in range(120)]
    table = docs.unionByName(spark.createDataFrame(more, SCHEMA)).coalesce(2)
    made = fim.transform(table, ["doc_id"])
    assert Counter(map(tuple, made.collect())) == Counter(plain_fim(r[0], r[1]) for r in [*rows(), *more])
    back = fim.transform(table, ["doc_id", "text"]).select("text", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert fim.transform(none, ["doc_id"]).count() == 0
    assert fim.transform(table, ["kept", "n"]).columns == ["kept", "n", "n", "form", "output", "prefix_chars", "middle_chars"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


@pytest.mark.parametrize("size", [5_000, 1_000_000])
def test_html_values_of_any_length(size):
    """A quoted value may be as long as it likes; pages of stray quotes still take time in proportion to their length."""
    inside = "x" * size + " > " + "y" * size
    for quote in "\"'":
        page = f"<article><p>Real words stand here, and they are many.</p><div data-json={quote}{inside}{quote}><p>More real words stand here, as before.</p></div></article>"
        assert html_text.extract(page) == "Real words stand here, and they are many.\n\nMore real words stand here, as before."
    began = time.monotonic()
    for stray in ("<a href=it's>x</a> ", '<a title=">x</a> ', "<i k='\"v>", '<a href="', '<p x="' + "a" * 50):
        html_text.extract("<article><p>" + stray * (size // len(stray)))
    assert time.monotonic() - began < 20


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_scoring_sends_as_much_at_any_number_of_shards(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 7 != 2).alias("learned"), "text").coalesce(2)
    sizes = {}
    for shards in (20, 800):
        sent = docs.mapInArrow(ngram_trie._pairs(shards, np.array([1, 2], np.uint64), np.array([200, 200]), ngram_trie.MU), "shard int, chunk long, blob binary").cache()
        back = sent.groupBy("shard").applyInPandas(ngram_trie._shard(100_000, 5_000, np.array([1, 2], np.uint64), np.array([200, 200]), ngram_trie.MU), "chunk long, blob binary")
        sizes[shards] = [df.agg(F.sum(F.length("blob"))).first()[0] for df in (sent, back)]
    assert all(b < 3 * a for a, b in zip(sizes[20], sizes[800], strict=True)), sizes


def test_bits_there_and_back():
    rng = np.random.default_rng(5)
    for most in (0, 1, 5, 1000, 1 << 33):
        for n in (0, 1, 7, 1000):
            x = rng.integers(0, most + 1, n)
            assert (ngram_trie._unbits(ngram_trie._bits(x)) == x).all()
    h = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    assert (ngram_trie._uncut(ngram_trie._cut(h)) == h & np.uint64((1 << 40) - 1)).all()
