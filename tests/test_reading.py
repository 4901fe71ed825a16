"""Tolerant payloads, folded case, medians by selection, folders of artifacts."""

import math
import random
import statistics
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import schemas
from hushframe.functions import folding, payload, text
from hushframe.operators import medians
from hushframe.sources import records, tables

ITEM = schemas._struct(id=T.IntegerType(), score=T.DoubleType(), passes=T.BooleanType(), why=T.StringType(), tags=T.ArrayType(T.StringType()))
KIND = schemas._struct(items=T.ArrayType(ITEM))
PAYLOADS = [
    ('{"items":[{"id":1,"score":0.5,"passes":true,"why":"x","tags":["a"]}]}', "read", [(1, 0.5, True, "x", ["a"])]),
    ('{"items":[{"id":"2","score":"0.25","passes":" YES","why":3,"tags":"no list"},{"id":"x","score":[1],"passes":2},{"id":1.9,"passes":0}]}', "read", [(2, 0.25, True, "3", None), (None, None, True, None, None), (1, None, False, None, None)]),
    ("not json", "malformed", None),
    ('{"items":[]} trailing', "malformed", None),
    ("", "empty", None),
    (" \n", "empty", None),
    (None, "empty", None),
    ("{}", "read", None),
    ('[{"id":4}]', "read", [(4, None, None, None, None)]),
    ('"{\\"items\\":[{\\"id\\":5}]}"', "read", [(5, None, None, None, None)]),
    ('{"items":"[{\\"id\\":6}]"}', "read", [(6, None, None, None, None)]),
    ("7", "other", None),
    ("null", "other", None),
    ('{"items":[null,{"score":"NaN","passes":"maybe"}]}', "read", [None, (None, None, None, None, None)]),
]


def test_payloads_are_read_field_by_field(spark):
    df = spark.createDataFrame([(p[0],) for p in PAYLOADS], "r string")
    for r, (raw, state, items) in zip(df.select("r", payload.state(F.col("r")).alias("s"), payload.read(F.col("r"), KIND).alias("v")).collect(), PAYLOADS, strict=True):
        got = None if r.v is None or r.v["items"] is None else [None if x is None else (x.id, x.score, x.passes, x.why, x.tags) for x in r.v["items"]]
        assert (r.s, got) == (state, items), raw
    maps = df.limit(1).select(payload.read(F.lit('{"a":{"n":1},"b":{"n":"x"}}'), T.MapType(T.StringType(), schemas._struct(n=T.LongType()))).alias("m")).first().m
    assert {k: v.n for k, v in maps.items()} == {"a": 1, "b": None}


def test_case_is_folded_as_python_folds_it(spark):
    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or chr(c).casefold() != chr(c))]
    words = ["Straße", "ΣΊΣΥΦΟΣ", "İstanbul", "ŉ ﬃ", "", "PLAIN", "ᏸᏸ", None]
    df = spark.createDataFrame([(v,) for v in [*every, *words]], "v string").repartition(4)
    assert all(r.f == (None if r.v is None else r.v.casefold()) for r in df.select("v", folding.fold(F.col("v")).alias("f")).collect())
    assert len(folding.SEVERAL) > 100
    row = spark.createDataFrame([(["  Große  STRASSE ", "x"],)], "a array<string>").select(F.transform("a", text.value_key).alias("a")).first()
    assert row.a == ["grosse strasse", "x"]


def _median(values):
    have = [v for v in values if v is not None]
    if not have:
        return None
    order = sorted(have, key=lambda v: (math.isnan(v), v))
    a, b = order[(len(order) - 1) // 2], order[len(order) // 2]
    return (a + b) / 2


@pytest.mark.parametrize(("most", "parts"), [(1, 16), (4, 64), (1000, 64)])
def test_medians_by_selection(spark, most, parts):
    rng = random.Random(most)
    rows = [("big", rng.lognormvariate(0, 5) * rng.choice([1, -1]), rng.choice([1.0, 2.0, None])) for _ in range(700)]
    rows += [("odd", float(i), None) for i in range(11)] + [("two", -1.5e308, 3.0), ("two", 1.5e308, 4.0), (None, 2.0, 1.0), (None, 5.0, 1.0), (None, 9.0, 1.0), ("none", None, None), ("none", None, None)]
    rows += [("strange", v, 0.0) for v in (math.inf, -math.inf, math.nan, math.nan, 1.0, 2.0, -0.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    got = {r.k: (r.median_a, r.median_b) for r in medians.medians(df, ["k"], ["a", "b"], tables.kept, most, parts).collect()}
    want = {k: tuple(_median([r[i] for r in rows if r[0] == k]) for i in (1, 2)) for k in {r[0] for r in rows}}
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert all(a is b is None or a == pytest.approx(b, nan_ok=True, rel=1e-12) for a, b in zip(got[k], pair, strict=True)), k
    assert statistics.median([r[1] for r in rows if r[0] == "big"]) == got["big"][0]
    rolled = medians.rolled_up(df, ["k"], [F.count(F.lit(1)).alias("n")], ["a"], tables.kept, most)
    assert {r.k: r.n for r in rolled.collect()}["big"] == 700 and {r.k: r.median_a for r in rolled.collect()}["big"] == got["big"][0]


def test_a_large_group_is_spread(spark):
    """One group of 20,000 values: no task of a round reads more than a fair part of them."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.hash("id") / 7).alias("a"))
    sizes = []

    def keep(frame, name):
        out = tables.kept(frame, name)
        if name == "values":
            sizes.extend(r.n for r in out.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())
        return out

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = medians.medians(df, ["k"], ["a"], keep, 500, 64).first().median_a
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == df.agg(F.median("a")).first()[0]
    assert len(sizes) > 1 and max(sizes) < 0.6 * 20_000


def test_artifact_folders(spark, tmp_path):
    with pytest.raises(tables.InputError):
        records.read_artifact_folder(spark, f"{tmp_path}")
    c = records.ARTIFACT_COLUMNS
    for step, frame in (("entity-detection-1", spark.createDataFrame([('{"entities": [{"value": "Ann", "label": "name", "start_position": "0", "end_position": 3}, {"value": "", "label": "x"}]}',), (None,), ("broken",)], f"{c['final']} string")), ("entity-detection-2", spark.createDataFrame([(7, [("Bo", "name")])], f"{c['seed']} int, {c['final']} array<struct<value:string,label:string>>"))):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{step}/{records.ARTIFACT_FOLDER}")
    got = sorted(records.read_artifact_folder(spark, f"{tmp_path}").collect(), key=lambda r: (r.workflow_name, r.row_index))
    assert [(r.workflow_name, r.row_index, [e.value for e in r.final], len(r.seed), r.merged_validation_candidate_count) for r in got] == [("entity-detection-1", 0, ["Ann"], 0, 0), ("entity-detection-1", 1, [], 0, 0), ("entity-detection-1", 2, [], 0, 0), ("entity-detection-2", 0, ["Bo"], 0, 0)]
    assert got[0].final[0].start_position == 0 and got[0].batch_file.startswith(f"entity-detection-1/{records.ARTIFACT_FOLDER}/part-")
