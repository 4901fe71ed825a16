"""The parts of the corpus operators that need no session, against plain versions."""

import base64
import random
from collections import Counter

import numpy as np
import pytest

from hushframe.llm import components, html_text, langid, ngram_join, ngram_trie, pq, quality, simple8b, toxicity
from hushframe.llm.bpe import Bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return Bpe.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_is_what_the_library_gives(bpe):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tthe é'sS12,.!漢字😀́tlld\xa0") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in [*texts, "", "a" * 4000, "ab" * 2000, "thesethese" * 400, "é漢" * 500, "<|endoftext|>"]:
        ids = bpe.encode(t).tolist()
        assert ids == own.encode_ordinary(t)
        assert bpe.decode(ids, 7) == t.encode()


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_joins_don_t_depend_on_where_they_are(bpe, leaf):
    rng = random.Random(2)
    other = Bpe(bpe.ranks, P.PATTERN, leaf)
    for _ in range(200):
        data = bytes(rng.choice(b"abcthe ing") for _ in range(rng.randrange(1, 50)))
        whole = bpe.merge(data)
        cut = rng.randrange(len(data) + 1)
        assert other.reduce(data) == whole == bpe.join(bpe.merge(data[:cut]), bpe.merge(data[cut:]))


def test_packing_is_undone():
    rng = np.random.default_rng(0)
    for k in range(80):
        n, most = int(rng.integers(0, 7000)), int(rng.choice([1, 2, 100, 50000, 2**31, 2**59, 2**63]))
        v = rng.integers(0, most, n).astype(np.uint64)
        if k % 3 == 0:
            v[rng.random(n) < 0.5] = 0
        words, offsets = simple8b.pack(v)
        assert (simple8b.unpack(words, n, simple8b.BLOCK, offsets) == v).all()
        if len(offsets) > 2:
            assert (simple8b.unpack(words, n, simple8b.BLOCK, offsets, 1, 2) == v[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()
    keys, lengths = [None, 3, 3], np.array([2, 0, 1])
    data = simple8b.record(5, keys, lengths, np.array([9, 2**63, 1], np.uint64)) + b"\n"
    ((shard, back, sizes, values),) = simple8b.records(data)
    assert (shard, back, sizes.tolist(), values.tolist()) == (5, keys, [2, 0, 1], [9, 2**63, 1])
    with pytest.raises(ValueError):
        list(simple8b.records(b"x" * 60))


def test_words_are_cut_as_the_library_does():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(rng.choice("ab \n\té'sSTÉß12,.!漢ΣσİıLl'd\x1c\xa0\x85Å§¼²") for _ in range(rng.randrange(30))) for _ in range(800)] + ["a<|endoftext|>b", ""]
    kind, coded = simple8b.encode_texts(texts, path)
    got = [np.frombuffer(x, kind).tolist() for x in coded]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for most in (1, 50, 2**40, 2**63):
        v = np.sort(rng.integers(0, most, 5000, np.uint64, endpoint=True))
        e = ngram_trie.EliasFano(ngram_trie.EliasFano.pack(v))
        assert (e.decode() == v).all() and (e.decode(4090, 4200) == v[4090:4200]).all() and e[4999] == v[4999] and e.find(int(v[77]), 0, 5000) >= 0
    assert len(ngram_trie.EliasFano(ngram_trie.EliasFano.pack(np.zeros(0, np.uint64))).decode()) == 0
    words = np.unique(rng.integers(1, 2**62, 60).astype(np.uint64))
    pairs = sorted({(int(rng.integers(1, 40)), int(rng.integers(0, len(words)))) for _ in range(300)})
    context, place = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])
    terms = rng.random(len(pairs))
    trie = ngram_trie.Trie.mapped(ngram_trie.Trie.pack(words, rng.random(len(words)), place, context, terms))
    found = trie.look_up_all(context, place)
    assert (found == np.arange(len(pairs))).all() and abs(trie.upper[found] - terms).max() < 1e-4
    assert [trie.look_up(c, int(words[p])) for c, p in pairs[:40]] == list(range(40))
    known = set(pairs)
    assert all((trie.look_up(c, int(words[p])) >= 0) == ((c, p) in known) for c in range(1, 45, 7) for p in range(len(words)))


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.9995), (0.9, 0.999), (0.5, 0.9)):
        bands, rows = ngram_join.choose_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_shingles_and_intersections():
    assert len(ngram_join.shingles(b"a b c d e f")) == 2 and len(ngram_join.shingles(b"a b")) == 1 and len(ngram_join.shingles(b" \n")) == 0
    assert (ngram_join.shingles(b"a b c d e") == ngram_join.shingles(b"a\tb\nc d  e")).all()
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(12)]
    got = ngram_join.intersections(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(12) for j in range(12) if i != j)


def test_forests():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 40, 25), rng.integers(0, 40, 25)
        label = list(range(40))
        for _ in range(40):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert components.forest(40, a, b).tolist() == label


def test_quantised_search_loses_no_pair():
    rng = np.random.default_rng(4)
    base = pq.unit(rng.normal(size=(300, 16)))
    near = pq.unit(base[:100] + 0.05 * rng.normal(size=(100, 16)))
    index = pq.Index.fit(base, 4, 4, 16)
    found = set()
    for q, x in pq.pairs_in_list(index, index.centroids[0], near, base, 0.9):
        found |= set(zip(q.tolist(), x.tolist(), strict=True))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near @ base.T >= 0.9), strict=True)}
    assert want and want <= found and len(found) < near.shape[0] * base.shape[0]


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, j, rng.randrange(1, 6)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(label, scores=scores, edges=edges):
            return sum(max(s, 0) if not x else max(-s, 0) for s, x in zip(scores, label, strict=True)) + sum(c for a, b, c in edges if label[a] != label[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(scores, edges)) == best


def test_pages():
    page = "<header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies.</div><main><h1>On &amp; off</h1><p>A first paragraph,\n with <b>some</b> text. And more.<p>Short.<script>var a='<p>no</p>'</script></main><div id=comments><p>Great post! I liked it, thanks.</p></div><aside>Related</aside><footer>&copy; x</footer>"
    assert html_text.extract(page) == "On & off\n\nA first paragraph, with some text. And more.\n\nShort."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("<article><p>" + "word " * 30000 + "</article>").count("word") == 30000
    assert html_text.extract("<p><!-- unclosed") == ""


def test_measures_are_those_of_a_plain_count():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n#|é\t") for _ in range(rng.randrange(120))) for _ in range(60)] + ["", "a b c a b c", "x\nx\n \n x"]
    got = np.array(quality.measures([t.encode() for t in texts])).T.tolist()
    for t, m in zip(texts, got, strict=True):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert m == [len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), sum(not (x.isalpha() or x in " \t\n\r\x0b\x0c") for x in t), len(lines), len(lines) - len(set(lines)), len(hit)]


def test_profiles_tell_languages():
    s = langid.Space()
    rows, letters = s.bundles(["the cat and the dog and the house", "der hund und die katze und das haus", None, "12 !", "the dog and the cat", ""])
    assert letters.tolist() == [True, True, False, False, True, False]
    u = langid._unit(rows)
    assert u[4] @ u[0] > u[4] @ u[1] and not rows[2].any()
    # a bundle is the sum of its bound vectors
    a, b, c = (s._draw(ord(x)).astype(float) for x in "abc")
    sp = s._draw(32).astype(float)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (s.bundles(["abc"])[0][0] == bind(sp, a, b) + bind(a, b, c) + bind(b, c, sp)).all()


def test_sentences_are_found_from_document_labels():
    rng = random.Random(7)
    plain = ["tree", "house", "river", "stone", "green", "walks"]
    texts, labels = [], []
    for i in range(300):
        said = [" ".join(rng.choices(plain, k=5)) for _ in range(8)]
        if i % 3 == 0:
            said[rng.randrange(8)] = "you utter scum of tree"
        texts.append(". ".join(said) + ".")
        labels.append(int(i % 3 == 0))
    m = toxicity.fit(texts[:200], labels[:200])
    assert all((m.score(t) >= 0.5) == bool(y) for t, y in zip(texts[200:], labels[200:], strict=True))
    t = "A green tree. You utter scum! The river walks."
    assert [t[a:b].strip() for a, b, _ in m.locate(t)] == ["You utter scum"] and 0 <= m.score("") < 0.5 and m.score(None) == m.score("")
    assert toxicity.fit(["a"], [0]).score("a") < 0.5 and toxicity.fit([], []).score("a") < 0.5
