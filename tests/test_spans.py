"""Span algebra against the cases it must get right, and against a plain-Python version."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from hushframe import schemas
from hushframe.functions import spans, text
from hushframe.operators import detect, metrics, replace


def entity(value, label, start, end, score=1.0, source="detector"):
    return (f"{label}_{start}_{end}", value, label, start, end, score, source)


def frame(spark, rows):
    return spark.createDataFrame(rows, f"t string, e {spans.KIND}")


def one(spark, body, entities, column):
    return frame(spark, [(body, entities)]).select(column.alias("x")).first().x


def places(found):
    return [(e.label, e.start_position, e.end_position) for e in found]


def test_malformed_answers_give_no_spans(spark):
    bad = ["no json", "[]", '{"entities": 3}', '{"entities": [1, "a", null]}', '{"entities":[{"text":"","label":"a","start":0,"end":1}]}', '{"entities":[{"text":"a","label":"a","start":-1,"end":1}]}', '{"entities":[{"text":"a","label":"a","start":2,"end":2}]}', '{"entities":[{"text":"a","label":"a","start":0,"end":99}]}', '{"entities":[{"text":"a","label":"a","start":"x","end":1}]}', None]
    df = spark.createDataFrame([("abc", b) for b in bad], "t string, r string")
    assert all(not r.x for r in df.select(spans.parse_raw(F.col("r"), F.col("t")).alias("x")).collect())


def test_number_like_positions_are_read(spark):
    df = spark.createDataFrame([("abcdef", '{"entities":[{"text":" b ","label":"l","start":"1","end":2.9,"score":"0.5"}]}')], "t string, r string")
    found = df.select(spans.parse_raw(F.col("r"), F.col("t")).alias("x")).first().x
    assert places(found) == [("l", 1, 2)] and found[0].value == "b" and found[0].score == 0.5


def test_equal_spans_keep_the_smaller_label_and_equal_ones_the_earlier_source(spark):
    assert places(one(spark, "abc", [entity("a", "z", 0, 1), entity("a", "b", 0, 1)], spans.resolve_overlaps(F.col("e")))) == [("b", 0, 1)]
    got = one(spark, "abc", [entity("a", "b", 0, 1), entity("a", "b", 0, 1, source="propagation")], spans.resolve_overlaps(F.col("e")))
    assert [e.source for e in got] == ["detector"]


def plain_resolve(items):
    kept = []
    for e in sorted(items, key=lambda e: (e[3] - e[4], e[3], e[4], e[2])):
        if not any(e[3] < k[4] and k[3] < e[4] for k in kept):
            kept.append(e)
    return sorted(kept, key=lambda e: (e[3], e[4], e[2]))


def test_resolving_is_what_a_plain_loop_does_and_idempotent(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        made = []
        for _ in range(rng.randrange(9)):
            s = rng.randrange(30)
            made.append(entity("v", rng.choice("abc"), s, s + rng.randrange(1, 9)))
        rows.append(("x" * 40, made))
    once = spans.resolve_overlaps(F.col("e"))
    got = frame(spark, rows).select("e", once.alias("a"), spans.resolve_overlaps(once).alias("b")).collect()
    for r in got:
        assert [tuple(e) for e in r.a] == plain_resolve([tuple(e) for e in r.e])
        assert r.a == r.b


def test_decisions(spark):
    df = frame(spark, [("abcdefgh", [entity("a", "x", 0, 1), entity("b", "x", 1, 2), entity("c", "x", 2, 3), entity("d", "x", 3, 4)])])
    d = F.expr("from_json('[{\"id\":\"x_0_1\",\"decision\":\"DROP\"},{\"id\":\"x_1_2\",\"decision\":\"reclass\",\"proposed_label\":\"y\"},{\"id\":\"x_2_3\",\"decision\":\"drop\"},{\"id\":\"x_2_3\",\"decision\":\"keep\"},{\"id\":\"x_3_4\",\"decision\":\"reclass\"},{\"id\":\"zz\",\"decision\":\"drop\"}]', 'array<struct<id:string,decision:string,proposed_label:string,reason:string>>')")
    got = df.select(spans.apply_decisions(F.col("e"), d).alias("x")).first().x
    # the last decision counts, the id keeps the old label, reclass without a label keeps
    assert [(e.id, e.label) for e in got] == [("x_1_2", "y"), ("x_2_3", "x"), ("x_3_4", "x")]


@pytest.mark.parametrize("body,needle", [("Ana Anaë ana! xAna Ana_", "Ana"), ("a.b A.B a+b", "a.b"), ("😀 Bob 😀bob", "bob"), ("q \\E q\\E", "\\E"), ("aaaa", "aa"), ("x", "")])
def test_occurrences_are_those_of_an_ascii_bounded_search(spark, body, needle):
    p = re.escape(needle)
    if needle and (needle[0].isalnum() or needle[0] == "_"):
        p = "(?<![A-Za-z0-9_])" + p
    if needle and (needle[-1].isalnum() or needle[-1] == "_"):
        p += "(?![A-Za-z0-9_])"
    want = [m.start() for m in re.finditer(p, body, re.I)] if needle else []
    df = spark.createDataFrame([(body, needle)], "t string, n string")
    assert df.select(text.occurrences(F.col("t"), F.col("n")).alias("x")).first().x == want


def test_expansion_takes_the_text_of_each_place_and_the_first_label(spark):
    got = one(spark, "Bob saw BOB", [entity("Bob", "n", 0, 3), entity("bob", "z", 8, 11)], spans.expand_occurrences(F.col("t"), F.col("e")))
    assert [(e.value, e.label, e.start_position) for e in got] == [("Bob", "n", 0), ("BOB", "n", 8)]


def test_full_names_are_split_once(spark):
    got = one(spark, "Ann B Berg, ann", [entity("Ann B Berg", "full_name", 0, 10)], spans.split_full_names(F.col("t"), F.col("e")))
    assert [(e.label, e.start_position) for e in got[1:]] == [("first_name", 0), ("first_name", 12), ("last_name", 6)]


def test_tags_avoid_the_text_and_come_off_again(spark):
    for body, want in (("Al is", "xml"), ("<b>Al", "bracket"), ("< [[Al", "paren"), ("< [[ )) Al", "sentinel")):
        start = body.index("Al")
        got = one(spark, body, [entity("Al", "n", start, start + 2)], spans.tagged_text(F.col("t"), F.col("e")))
        shape = {"xml": "<n>Al</n>", "bracket": "[[Al|n]]", "paren": "((SENSITIVE:n|Al))", "sentinel": "<<SENSITIVE:n>>Al<</SENSITIVE:n>>"}[want]
        assert got == body.replace("Al", shape)


def test_replacement_takes_pairs_then_values_then_leaves(spark):
    pairs = F.expr("array(named_struct('original','A','label','x','synthetic','1'), named_struct('original','B','label','q','synthetic','2'))")
    got = one(spark, "A B C", [entity("A", "x", 0, 1), entity("B", "x", 2, 3), entity("C", "x", 4, 5), entity("B", "x", 2, 9)], replace.apply_map(F.col("t"), F.col("e"), pairs))
    assert got == "1 2 C"


def test_labels_and_hashes(spark):
    df = spark.createDataFrame([(" first-name ", "Alice"), ("--", "x")], "l string, v string")
    got = df.select(replace.Redact().column(F.col("v"), F.col("l")).alias("r"), replace.Hash().column(F.col("v"), F.col("l")).alias("h")).collect()
    assert [r.r for r in got] == ["[REDACTED_FIRST_NAME]", "[REDACTED_UNKNOWN]"] and got[0].h == "<HASH_ FIRST-NAME _3bc51062973c>"
    with pytest.raises(ValueError):
        replace.Hash(format_template="{label}")
    with pytest.raises(ValueError):
        replace.Redact("{text}")


def test_substitutes_that_are_originals_get_free_numbers(spark):
    df = spark.range(1).selectExpr("array(named_struct('value','A','labels',array('x')), named_struct('value','B','labels',array('x')), named_struct('value','[SUBSTITUTE_X_1]','labels',array('y'))) as by", "array(named_struct('original','A','label','x','synthetic','B'), named_struct('original','Q','label','x','synthetic','B'), named_struct('original','A','label','x','synthetic','z'), named_struct('original','B','label','x','synthetic','ok')) as p")
    got = df.select(replace.requested_pairs(F.col("p"), F.col("by")).alias("x")).first().x
    assert [(r.original, r.synthetic) for r in got] == [("A", "[SUBSTITUTE_X_2]"), ("B", "ok")]


def test_chunks_cover_all_and_excerpts_hold_whole_spans(spark):
    es = [entity("v", "n", i * 10, i * 10 + 3) for i in range(7)]
    got = one(spark, "x" * 90, es, spans.chunks(F.col("e"), 3))
    assert [len(c) for c in got] == [3, 3, 1] and one(spark, "x", [], spans.chunks(F.col("e"), 3)) == []
    part = one(spark, "0123456789" * 3, [entity("0", "n", 10, 11), entity("9", "n", 19, 20)], spans.excerpt(F.col("t"), F.slice("e", 1, 1), F.col("e"), 5, F.lit("xml")))
    assert part == "56789<n>0</n>12345"


def test_detector_helpers(spark):
    es = [entity("ab", "n", 0, 2, 0.2), entity("abc", "n", 0, 3), entity("AB", "n", 0, 2, 0.9)]
    assert places(one(spark, "abc", es, spans.without_subsets(F.col("e")))) == [("n", 0, 3)]
    assert [e.score for e in one(spark, "abc", es, spans.deduplicated(F.col("e")))] == [0.9, 1.0]


def test_nulls_pass_through(spark):
    df = spark.createDataFrame([(None,), ("",), ("a@b.co",)], f"{schemas.TEXT} string")
    out = replace.replace(detect.finalize(detect.detect(df)), replace.Redact()).collect()
    assert [r[schemas.OUTPUT] for r in out] == [None, "", "[REDACTED_EMAIL]"]


def test_ids_and_hashes_are_those_of_the_standard_library(spark):
    r = spark.createDataFrame([("é",)], "t string").select(text.record_id("t").alias("u"), text.keyed_hash(F.col("t"), b"k" * 70).alias("h")).first()
    assert r.u == uuid.uuid5(uuid.NAMESPACE_URL, '{"t":"é"}').hex and r.h == text.keyed_hash_of("é", b"k" * 70)


def test_leaks_of_short_values_need_edges(spark):
    df = spark.createDataFrame([("Anna 1234567", "Ann"), ("Ann 12", "Ann"), ("x1234567", "1234567"), ("xJohnsonx", "Johnson")], "o string, v string")
    assert [r.x for r in df.select(text.contains_value(F.col("o"), F.col("v")).alias("x")).collect()] == [False, True, False, True]


def test_relaxed_matching_is_a_maximum_matching(spark):
    rng = random.Random(8)

    def best(fs, gs):
        if not gs:
            return 0
        skip = best(fs, gs[1:])
        return max([skip, *(1 + best(fs[:i] + fs[i + 1 :], gs[1:]) for i, f in enumerate(fs) if f[3] < gs[0][4] and gs[0][3] < f[4])])

    rows, want = [], []
    for _ in range(40):
        fs, gs = ([entity("v", "n", s, s + rng.randrange(1, 6)) for s in (rng.randrange(15) for _ in range(rng.randrange(5)))] for _ in range(2))
        rows.append((fs, gs))
        want.append(best(fs, gs))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, f {spans.KIND}, g {spans.KIND}")
    got = df.select("i", metrics.relaxed_count(F.col("f"), F.col("g")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == want
