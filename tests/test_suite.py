"""Suites, sweeps, domains, strict reading."""

import dataclasses
import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from hushframe.operators import analysis
from hushframe.plans.config import Evaluate
from hushframe.plans.domains import DOMAINS, privacy_guidance, quality_guidance
from hushframe.plans.engine import Engine
from hushframe.plans.suite import Suite, Workload, combined_records, config_of, patched, run_suite, run_sweep, seal, sweep
from hushframe.sources import records
from hushframe.sources.tables import InputError


def test_a_suite_runs_its_cases_and_notes_failures(spark, tmp_path):
    spark.createDataFrame([(i, f"mail a{i}@b.co") for i in range(6)], "id int, text string").write.parquet(f"{tmp_path}/w.parquet")
    suite = Suite("s", [Workload("all", f"{tmp_path}/w.parquet"), Workload("some", f"{tmp_path}/w.parquet", order="id", offset=2, limit=3), Workload("none", f"{tmp_path}/missing.parquet")], {"hash": {"replace": {"kind": "hash"}}}, matrix=[("all", "hash"), ("some", "hash"), ("none", "hash")])
    cases, made = run_suite(spark, suite, f"file://{tmp_path}/out", retries=1, wait=0)
    assert [c.status for c in cases] == ["completed", "completed", "error"] and cases[0].id == "all__hash__r000"
    assert {r["run_tags"]["workload_id"]: r["n"] for r in made.groupBy("run_tags").agg(F.sum("final_entity_count").alias("n")).collect()} == {"all": 6, "some": 3}
    again = combined_records(spark, f"file://{tmp_path}/out", cases)
    assert again.count() == made.count() and combined_records(spark, "x", []) is None
    assert seal(made) == seal(made.orderBy(F.desc("text_length_chars"))) != seal(made.limit(2))
    assert analysis.summary(spark.createDataFrame([("a", False, 2.0), ("b", True, 4.0)], "case_id string, case_failed boolean, pipeline_elapsed_sec double")).first().success_rate == 0.5


def test_suites_are_checked():
    w = [Workload("a", "x")]
    for bad in (lambda: Suite("s", w * 2, {"c": {}}), lambda: Suite("s", w, {}), lambda: Suite("s", w, {"c": {}}, matrix=[("a", "d")]), lambda: list(sweep(Suite("s", w, {"c": {}}), {})), lambda: patched({"a": 1}, "a.b", 2)):
        with pytest.raises(InputError):
            bad()
    assert len(Suite("s", w, {"c": {}, "d": {}}, repetitions=3).cases()) == 6


def test_sweeps_patch_all_configurations():
    arms = list(sweep(Suite("s", [Workload("a", "x")], {"c": {}, "d": {"detect": {"entity_labels": ["email"]}}}), {"detect.threshold": [0.1, 0.2], "replace.kind": ["hash"]}))
    assert [a["detect.threshold"] for a, _ in arms] == [0.1, 0.2] and len({s.id for _, s in arms}) == 2
    got = config_of({"replace": {"kind": "hash"}} | arms[1][1].configs["d"])
    assert got.detect.threshold == 0.2 and got.detect.entity_labels == ["email"]


def test_domains(spark):
    assert len(DOMAINS) == 21
    df = spark.createDataFrame([("LEGAL",), ("nope",), (None,)], "d string")
    rows = df.select(quality_guidance(F.col("d")).alias("q"), privacy_guidance(F.col("d")).alias("p")).collect()
    assert rows[0].q == DOMAINS["LEGAL"][1] and rows[0].p == DOMAINS["LEGAL"][2] and rows[1].q == rows[2].p == DOMAINS["OTHER"][1]


def test_strict_reading(spark, tmp_path):
    good = tmp_path / "m.jsonl"
    good.write_text(json.dumps({"record_type": "record", "run_id": "r"}) + "\n")
    assert records.read_strictly(spark, f"file://{good}").count() == 1
    with pytest.raises(InputError):
        records.read_strictly(spark, f"file://{good}", most_bytes=3)
    line = {"record_type": "record", "run_id": "r", "status": "completed"}
    deep = json.dumps(line | {"x": [[[[{'[[[[[["': '"[["'}]]]]})
    for wrong, what in (("{bad", "not JSON"), ("", "an empty record"), (json.dumps({"run_id": "r"}), "no record type"), (json.dumps({"record_type": "record"}), "no run"), (json.dumps(line | {"final_entity_count": "many"}), "another type"), (json.dumps(line | {"x": "y" * 300}), "more than 200 bytes"), (deep, "nests more than 5 deep"), ('{"record_type": "stage", "run_id": "r", "elapsed_sec": NaN}', "not JSON")):
        good.write_text(json.dumps(line) + "\n" + wrong + "\n" + json.dumps(line) + "\n")
        with pytest.raises(InputError, match=rf"m\.jsonl, line 2: .*{what}.*in all: .*\(1\)"):
            records.read_strictly(spark, f"file://{good}", most_line=200, most_depth=5)
    good.write_text(json.dumps(line) + "\r\n" + json.dumps(line))
    assert records.read_strictly(spark, f"file://{good}", statuses={"r": "completed"}).count() == 2
    for bad in (lambda: records.read_strictly(spark, f"file://{good}", most_records=1), lambda: records.read_strictly(spark, f"file://{good}", statuses={"r": "error"}), lambda: records.read_strictly(spark, f"file://{good}", statuses={})):
        with pytest.raises(InputError):
            bad()
    good.write_text("")
    assert records.read_strictly(spark, f"file://{good}").count() == 0


def test_judges_are_checked():
    assert Evaluate().judges is None and Evaluate(("detection",)).judges == ("detection",)
    for bad in ((), ("nobody",)):
        with pytest.raises(InputError):
            Evaluate(bad)


def test_rollup_of_nulls_and_unknown_kinds(spark):
    rows = spark.createDataFrame([("a", 1, None, None, "x"), ("a", 2, None, None, None), ("b", 1, 3, 0.5, None)], "k string, n int, total int, failed_rate double, status string")
    got = {r.k: r for r in analysis.scalar_rollup(rows, ["k"], "n").collect()}
    assert (got["a"].total, got["a"].failed_rate_mean, got["a"].status) == (None, None, "x") and (got["b"].total, got["b"].failed_rate_mean, got["b"].status) == (3.0, 0.5, None)
    assert analysis.scalar_rollup(rows.limit(0), ["k"], "n").count() == 0
    with pytest.raises(ValueError, match="most"):
        analysis.scalar_rollup(rows, ["k"], "n", {"total": "most"})


def _slow(prompt, alias):
    time.sleep(0.5)
    return "{}"


def test_a_suite_resumes_runs_beside_and_cancels(spark, tmp_path):
    spark.createDataFrame([(i, f"mail a{i}@b.co") for i in range(6)], "id long, text string").write.parquet(f"{tmp_path}/in.parquet")
    made = []

    def make(session):
        made.append(1)
        return Engine(session)

    spec = Suite("s", [Workload("w", f"{tmp_path}/in.parquet")], {"hash": {"replace": {"kind": "hash"}}, "redact": {"replace": {"kind": "redact"}}}, repetitions=2)
    done, records = run_suite(spark, spec, f"{tmp_path}/out", make, at_once=3)
    assert [c.status for c in done] == ["completed"] * 4 and records.count() == 24 and len(made) == 4
    # one case lost its note, another its records' seal: only these run again
    shutil.rmtree(f"{tmp_path}/out/w__hash__r001/seal")
    spark.read.parquet(f"{tmp_path}/out/w__redact__r000/records").limit(3).write.parquet(f"{tmp_path}/less")
    shutil.rmtree(f"{tmp_path}/out/w__redact__r000/records")
    shutil.move(f"{tmp_path}/less", f"{tmp_path}/out/w__redact__r000/records")
    again, records = run_suite(spark, spec, f"{tmp_path}/out", make)
    assert {c.id for c in again if not c.resumed} == {"w__hash__r001", "w__redact__r000"} and len(made) == 6 and records.count() == 24
    # what a case is made of counts
    other = dataclasses.replace(spec, configs={**spec.configs, "hash": {"replace": {"kind": "hash", "algorithm": "md5"}}})
    assert {c.id for c in run_suite(spark, other, f"{tmp_path}/out", make)[0] if not c.resumed} == {"w__hash__r000", "w__hash__r001"}
    runs = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/w__hash__r000/runs").collect()]
    assert {r["record_type"] for r in runs} == {"run", "stage"} and all(r["run_tags"]["case_id"] == "w__hash__r000" for r in runs)

    slow = Suite("late", [Workload("w", f"{tmp_path}/in.parquet")], {"x": {"replace": {"kind": "redact"}}})
    began = time.monotonic()
    late, none = run_suite(spark, slow, f"{tmp_path}/late", lambda s: Engine(s, lambda: _slow), retries=2, limit=1.0)
    assert (late[0].status, late[0].error, none) == ("cancelled", "TimeoutError", None) and time.monotonic() - began < 30
    # jobs of others aren't touched
    assert spark.range(10).count() == 10


def test_a_sweep_runs_what_is_left(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.co")], "id long, text string").write.parquet(f"{tmp_path}/in.parquet")
    spec = Suite("s", [Workload("w", f"{tmp_path}/in.parquet")], {"c": {"replace": {"kind": "redact"}}})
    half, _ = run_sweep(spark, spec, {"detect.threshold": [0.2]}, f"{tmp_path}/out")
    table, records = run_sweep(spark, spec, {"detect.threshold": [0.2, 0.6]}, f"{tmp_path}/out")
    assert [r.resumed for r in half.collect()] == [False]
    assert sorted((json.loads(r.arm)["detect.threshold"], r.status, r.resumed) for r in table.collect()) == [(0.2, "completed", True), (0.6, "completed", False)]
    assert records.count() == 2
