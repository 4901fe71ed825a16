"""Whole runs, with the offline detector and with a scripted model."""

import json

import pytest
from pyspark.sql import functions as F

from hushframe import cli, schemas
from hushframe.operators import analysis, model
from hushframe.operators.replace import Hash, Redact, Substitute
from hushframe.operators.rewrite import PrivacyGoal, Rewrite
from hushframe.plans.config import Config, Detect, Evaluate, Input, validator_pool
from hushframe.plans.display import show
from hushframe.plans.engine import Engine, unrenamed
from hushframe.plans.prompts import fill
from hushframe.sources import records, tables
from hushframe.sources.tables import InputError
from hushframe.streaming.stream import redact_stream


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Mirela met Tadeo."), (2, "Nobody here."), (3, "mail a@b.co now")], "id long, text string")


def scripted():
    """Knows two names; substitutes, answers and judges by fixed rules."""

    def call(prompt, alias):
        if alias == "down":
            raise ConnectionError("down")
        if prompt.startswith("Say for each entity"):
            return json.dumps({"decisions": [{"id": "name_0_5", "decision": "keep"}]})
        if prompt.startswith("List entities"):
            return json.dumps({"entities": [{"value": "Tadeo", "label": "name", "reason": "r"}]})
        if prompt.startswith("Make up"):
            return json.dumps({"replacements": [{"original": "Mirela", "label": "name", "synthetic": "Carol"}, {"original": "Tadeo", "label": "name", "synthetic": "Mirela"}]})
        if prompt.startswith("For each entity: sens"):
            return json.dumps({"sensitivity_disposition": [{"id": 9, "source": "t", "category": "direct", "sensitivity": "high", "entity_label": "name", "entity_value": "Mirela", "protection_reason": "r", "protection_method_suggestion": "replace", "combined_risk_level": "high"}]})
        if prompt.startswith("Ask a question"):
            return json.dumps({"items": [{"id": 1, "aspect": "a", "importance": "critical", "question": "who?", "reference_answer": "x"}]})
        if prompt.startswith("Rewrite again"):
            return json.dumps({"rewritten_text": "Somebody met somebody."})
        if prompt.startswith("Rewrite the text"):
            return json.dumps({"rewritten_text": "Mirela met somebody."})
        if prompt.startswith("Answer") and "stranger" in prompt:
            return json.dumps({"answers": [{"id": 1, "answer": "yes" if "Mirela met" in prompt else "no", "confidence": 0.9, "reason": "r", "evidence": []}]})
        if prompt.startswith("Score"):
            return json.dumps({"items": [{"id": 1, "score": 0.8, "reason": "r"}]})
        if prompt.startswith("Judge"):
            return json.dumps({"all_valid": True, "items": []})
        if "Mirela met Tadeo." in prompt and len(prompt) < 40:
            return json.dumps({"entities": [{"text": "Mirela", "label": "name", "start": 0, "end": 6, "score": 0.9}]})
        return "{}"

    return call


def test_redacting_a_table(spark, people):
    got = Engine(spark).run(Config(replace=Redact()), Input(people))
    assert got.frame.columns == ["id", "text", "final_entities", "text_with_spans", "text_replaced"] or set(got.frame.columns) >= {"id", "text", "text_replaced"}
    assert {r.id: r.text_replaced for r in got.frame.collect()} == {1: "Mirela met Tadeo.", 2: "Nobody here.", 3: "mail [REDACTED_EMAIL] now"}
    assert "<" in show(got.trace, 0) and got.failed.count() == 0
    assert got.metrics().agg(F.sum("final_entity_count")).first()[0] == 1


def test_substituting_with_a_model_and_judging(spark, people):
    engine = Engine(spark, scripted, {"entity_validator": ["down", "up"]})
    got = engine.run(Config(replace=Substitute()), Input(people))
    by = {r.id: r.text_replaced for r in got.frame.collect()}
    # a substitute that is itself an original is replaced
    assert by[1] == "Carol met [SUBSTITUTE_NAME_1]." and by[2] == "Nobody here."
    judged = engine.evaluate(got).frame
    assert {r.id: r.detection_valid for r in judged.collect()} == {1: True, 2: True, 3: True}
    chosen = engine.evaluate(got, Evaluate(("type_fidelity",))).frame.columns
    assert "type_fidelity_valid" in chosen and "detection_valid" not in chosen


def test_rewriting_repairs_leaks(spark, people):
    engine = Engine(spark, scripted)
    got = engine.run(Config(rewrite=Rewrite(risk_tolerance="low")), Input(people))
    with pytest.raises(InputError, match="rewrite"):
        engine.evaluate(got, Evaluate(("type_fidelity",)))
    rows = {r.id: r for r in got.frame.collect()}
    assert rows[1].text_rewritten == "Somebody met somebody." and not rows[1].any_high_leaked and rows[1].utility_score == 0.8
    assert rows[2].text_rewritten == "Nobody here." and rows[2].utility_score == 1.0 and not rows[2].needs_human_review
    assert {r[schemas.RECORD_ID]: r["_hf_repair_iterations"] for r in got.trace.collect()} and got.trace.filter("_hf_repair_iterations = 1").count() == 1


def test_failed_calls_become_failed_records(spark, people):
    engine = Engine(spark, scripted, {"entity_detector": "down"})
    got = engine.run(Config(replace=Hash()), Input(people))
    assert got.frame.count() == 0 and got.failed.count() == 3
    assert got.failed.first().step == "entity-detection"
    assert analysis.failure_counts(got.failed).first().detection == 3


def test_model_column_skips_rows_that_need_no_call(spark):
    df = spark.createDataFrame([(1, ["a", "b"], True), (2, ["c"], False), (3, None, True)], "id int, p array<string>, w boolean")
    out = model.model_column(df, "p", "x", schemas.T.StringType(), lambda: lambda p, alias: p + alias, ["1", "2"], when="w")
    assert {r.id: r.x for r in out.collect()} == {1: ["a1", "b2"], 2: None, 3: None}
    clash = df.withColumnsRenamed({"id": "calls", "w": "error"})
    out = model.model_column(clash, "p", "answer", schemas.T.StringType(), lambda: lambda p, alias: p + alias, ["1"], when="error")
    assert out.columns == ["calls", "p", "error", "answer", "answer_error"] and {r.calls: r.answer for r in out.collect()} == {1: ["a1", "b1"], 2: None, 3: None}


def test_names_are_kept_apart(spark):
    df = spark.createDataFrame([("a", "b", "c")], "final_entities string, final_entities__input string, final_entities__input_2_replaced string")
    got = tables.keep_apart(df, "final_entities")
    assert got.resolved == "final_entities__input_2" and len(set(got.frame.columns)) == 3
    assert "final_entities__input_2_replaced" not in got.frame.columns
    with pytest.raises(tables.InputError):
        tables.resolve(df, "nope")
    assert unrenamed(spark.createDataFrame([("a", "b")], "t string, t_replaced string"), "t").columns == [schemas.TEXT, schemas.OUTPUT]


def test_tables_round_trip(spark, people, tmp_path):
    for name in ("a.csv", "a.parquet"):
        path = tables.write_table(people, f"{tmp_path}/{name}")
        back = tables.read_table(spark, path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, people.collect()))
        assert tables.read_table(spark, path, -1).count() == 0 and tables.read_table(spark, path, 2).count() == 2
    with pytest.raises(tables.InputError):
        tables.read_table(spark, "a.txt")
    assert tables.suffix_of("https://x.org/d.CSV?a=1#b") == ".csv"


def test_configurations_are_checked():
    for bad in (lambda: Config(), lambda: Config(replace=Redact(), rewrite=Rewrite()), lambda: Detect([" "]), lambda: Detect(threshold=2), lambda: PrivacyGoal("two words", "also two"), lambda: Rewrite(risk_tolerance="x"), lambda: validator_pool([])):
        with pytest.raises(ValueError):
            bad()
    assert Detect([" B", "a", "b"]).entity_labels == ["a", "b"] and validator_pool(["a", "b", "a"]) == ["a", "b"]
    assert fill("<<A>> <<B>>", {"A": "<<B>>", "B": "x"}) == "<<B>> x"
    with pytest.raises(KeyError):
        fill("<<A>>", {})


def test_command_line(tmp_path, spark, people):
    people.coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    assert cli.main(["validate", "x.csv"]) == 0
    assert cli.main(["run", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/out.parquet", "--replace", "hash"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out.parquet").filter("text_replaced like '%<HASH_EMAIL_%'").count() == 1
    assert cli.main(["run", "x.txt", "--output", "y.csv"]) == 2


def test_measurement_files(spark, tmp_path):
    tag = {"case_id": "c1", "workload_id": "w", "limit": 0.3}
    rows = [
        {"record_type": "record", "run_id": "r", "run_tags": tag, "final_entity_count": 3, "entity_true_positive_count": 2, "entity_false_positive_count": 1, "original_value_leak_label_counts": {"a": 1, "b": 0}},
        {"record_type": "stage", "run_id": "r", "run_tags": tag, "stage": analysis.PIPELINE, "elapsed_sec": 2.0, "status": "completed"},
        {"record_type": "ndd_workflow", "run_id": "r", "run_tags": tag, "workflow_name": "d", "elapsed_sec": 1.0, "observed_total_requests": 4, "observed_failed_requests": 1, "model_usage": {"m": {"request_usage": {"total_requests": 4, "failed_requests": 1}, "token_usage": {"total_tokens": 9}}}},
    ]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "t" / "x").mkdir(parents=True)
    (tmp_path / "t" / "x" / "a.jsonl").write_text(json.dumps({"run_id": "r", "status": "error", "error_type": analysis.BRIDGE_ERROR, "messages": ["secret"], "run_tags": tag}) + "\n")
    m, t = records.read_measurements(spark, f"{tmp_path}/m.jsonl", {"threshold": "limit"}), records.read_traces(spark, f"{tmp_path}/t")
    assert "messages" not in t.columns
    case = analysis.case_rows(m, traces=t).first()
    assert (case.case_id, case.record_count, case.records_per_pipeline_sec, case.observed_failed_request_rate) == ("c1", 1, 0.5, 0.25)
    assert (case.observed_bridge_fallback_requests, case.observed_non_bridge_total_requests, case.original_value_leak_label_counts) == (1, 3, {"a": 1})
    group = analysis.group_rows(analysis.case_rows(m)).first()
    assert group.case_count == 1 and group.threshold == 0.3 and group.micro_entity_precision == pytest.approx(2 / 3)
    use = analysis.usage_group_rows(analysis.usage_rows(m)).first()
    assert (use.model_name, use.sum_observed_total_tokens, use.observed_failed_request_rate) == ("m", 9, 0.25)
    assert "record" in records.export(m, f"{tmp_path}/out")


def test_a_stream_gives_what_a_batch_gives(spark, people, tmp_path):
    people.write.parquet(f"{tmp_path}/s.parquet")
    got = redact_stream(spark, f"{tmp_path}/s.parquet", "id", f"file://{tmp_path}/o")
    want = Engine(spark).run(Config(replace=Redact()), Input(people)).frame
    assert sorted(map(tuple, got.collect())) == sorted((r.id, r.text_replaced) for r in want.collect())
