"""Models, roles, requests, named steps, recording, and what a run does with rows that get lost."""

import json
import logging
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest
from pyspark.sql import functions as F

import hushframe
from hushframe import schemas
from hushframe.operators import metrics, model
from hushframe.operators.replace import Redact, Substitute
from hushframe.operators.rewrite import Rewrite
from hushframe.plans import columns, prompts
from hushframe.plans.config import EXAMPLES, LABEL_NAMES, Config, Detect, Input
from hushframe.plans.engine import Engine
from hushframe.plans.models import Models
from hushframe.plans.recording import Recorder, settings
from hushframe.plans.suite import seal
from hushframe.sources.tables import InputError, shared_folder

POOL = """
model_configs:
  - {alias: small, model: org/small, provider: here, inference_parameters: {temperature: 0.1, max_tokens: 9, timeout: 3, extra_body: {seed: 1}}}
  - {alias: big, model: org/big, provider: here}
providers:
  - {name: here, endpoint: "http://127.0.0.1:PORT/v1/", api_key: SOME_KEY_VARIABLE}
selected_models:
  detection: {entity_validator: [small, big, small], entity_detector: big}
  evaluate: {detection_validity_judge: big}
"""


def test_models_are_read_and_checked(tmp_path):
    got = Models.read(POOL)
    assert [m.alias for m in got.models] == ["small", "big"] and got.roles["entity_validator"] == ["small", "big", "small"]
    assert got.roles["detection_judge"] == "big" and got.roles["rewriter"] == "small"
    (tmp_path / "m.yaml").write_text(POOL.split("providers:")[0])
    (tmp_path / "p.yaml").write_text("providers:\n  - {name: here, endpoint: http://x}\n")
    assert Models.read(tmp_path / "m.yaml", str(tmp_path / "p.yaml")).servers[0].endpoint == "http://x"
    got.check(["detection", "rewrite", "evaluate"])
    for bad in ("[]", "model_configs: []", "model_configs:\n  - {alias: a, model: b}", POOL.replace("name: here", "name: there"), POOL.replace("entity_detector", "nobody"), str(tmp_path / "none.yaml")):
        with pytest.raises(InputError):
            Models.read(bad)
    with pytest.raises(InputError):
        Models.read(POOL.replace("entity_detector: big", "entity_detector: huge")).check(["detection"])


def test_requests_carry_parameters_and_are_repeated(monkeypatch):
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(seen) == 1 else 400 if len(seen) == 3 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY_VARIABLE", "secret")
    provider = Models.read(POOL.replace("PORT", str(server.server_port))).provider(wait=0.01)
    call = provider.with_parameters("small", {"labels": ["x"]})()
    assert call("hello", "small") == "{}" and len(seen) == 2
    path, key, body = seen[1]
    assert path == "/v1/chat/completions" and key == "Bearer secret"
    assert body == {"model": "org/small", "messages": [{"role": "user", "content": "hello"}], "temperature": 0.1, "max_tokens": 9, "seed": 1, "labels": ["x"]}
    with pytest.raises(Exception):  # noqa: B017
        call("hello", "big")
    assert model.dispatch(call, "hello", ["nobody", "small"], 0)[0] == "{}"
    server.shutdown()


def test_prompts_name_what_they_ask_for():
    for template in (prompts.VALIDATE, prompts.AUGMENT_OPEN, prompts.AUGMENT_STRICT, prompts.LATENT, prompts.SUBSTITUTE, prompts.DOMAIN, prompts.DISPOSITION, prompts.MEANING, prompts.QUALITY_QA, prompts.REWRITE, prompts.ANSWER_PRIVACY, prompts.ANSWER_QUALITY, prompts.COMPARE, prompts.REPAIR, prompts.FINAL_JUDGE, prompts.JUDGE):
        assert "JSON" in template and "<<" in template
    for kind, template in ((schemas.LATENT, prompts.LATENT), (schemas.DISPOSITION, prompts.DISPOSITION), (schemas.MEANING_UNIT, prompts.MEANING), (schemas.QUALITY_QA, prompts.QUALITY_QA), (schemas.PRIVACY_ANSWER, prompts.ANSWER_PRIVACY), (schemas.DOMAIN, prompts.DOMAIN), (schemas.REPLACEMENT, prompts.SUBSTITUTE)):
        assert all(f'"{name}"' in template for name in kind.names)
    assert "no others" in prompts.AUGMENT_STRICT and "no others" not in prompts.AUGMENT_OPEN
    assert set(EXAMPLES) == set(LABEL_NAMES) and all(len(v) > 1 for v in EXAMPLES.values())


class Scripted:
    """A provider that takes parameters and notes what it is asked (in the task's answers)."""

    def __init__(self, extra=None):
        self.extra = extra or {}

    def with_parameters(self, alias, more):
        return Scripted({**self.extra, alias: more})

    def __call__(self):
        def call(prompt, alias):
            if alias in self.extra:
                assert self.extra[alias]["threshold"] == 0.7 and self.extra[alias]["labels"] == ["name"]
                return json.dumps({"entities": [{"text": "Mirela", "label": "name", "start": 0, "end": 6, "score": 0.9}]} if prompt.startswith("Mirela") else {"entities": []})
            if prompt.startswith("Make up"):
                return json.dumps({"replacements": [{"original": "Mirela", "label": "name", "synthetic": "Ines"}]})
            if prompt.startswith("List what can be inferred"):
                return json.dumps({"latent_entities": [{"category": "place", "label": "city", "value": "Porto", "confidence": "high", "evidence": ["the river"], "rationale": "r"}]})
            if prompt.startswith("Name the domain"):
                return json.dumps({"domain": "legal", "domain_confidence": 0.8})
            if prompt.startswith("For each entity: sens"):
                assert "Porto" in prompt and "docket numbers" in prompt
                return json.dumps({"sensitivity_disposition": [{"id": 1, "source": "latent", "category": "latent_identifier", "sensitivity": "low", "entity_label": "city", "entity_value": "Porto", "protection_reason": "r", "protection_method_suggestion": "generalize", "combined_risk_level": "medium"}]})
            if prompt.startswith("Rewrite the text"):
                assert "parties by role" in prompt
                return json.dumps({"rewritten_text": "Somebody lives by a river."})
            return "{}"

        return call


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(3, "Nobody here."), (1, "Mirela lives by the river."), (2, "Nothing either.")], "id long, text string").coalesce(1)


def test_detectors_get_labels_and_threshold(spark, rows):
    config = Config(Detect(["name"], threshold=0.7), replace=Substitute())
    got = Engine(spark, Scripted(), {"entity_detector": "finder"}).run(config, Input(rows, data_summary="notes"))
    assert [(r.id, r.text_replaced) for r in got.in_order().collect()] == [(3, "Nobody here."), (1, "Ines lives by the river."), (2, "Nothing either.")]
    assert got.failed.count() == 0


def test_rewriting_uses_latent_entities_and_the_domain(spark, rows):
    config = Config(Detect(["name"], threshold=0.7), rewrite=Rewrite(risk_tolerance="high", max_repair_iterations=0))
    got = Engine(spark, Scripted(), {"entity_detector": "finder"}).run(config, Input(rows))
    by = {r.id: r for r in got.frame.collect()}
    assert by[1].text_rewritten == "Somebody lives by a river." and by[3].text_rewritten == "Nobody here."
    trace = {r.id: r for r in got.trace.collect()}
    assert trace[1]["_hf_domain"].domain == "legal" and trace[1]["_hf_latent"][0].value == "Porto" and trace[3]["_hf_domain"] is None


def test_lost_records(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], f"{schemas.RECORD_ID} string")
    assert [r.record_id for r in model.missing_records(ids("a", "b"), ids("b", "c"), "s").collect()] == ["a"]
    gone = model.missing_records(ids("a", "b"), spark.range(3), "s").collect()
    assert {r.record_id for r in gone} == {"a", "b"} and all("no record ids" in r.reason for r in gone)
    assert model.missing_records(spark.range(3), ids("a"), "s").count() == 0


def test_expected_entities_in_any_form(spark):
    found = json.dumps([{"value": "Ann", "label": "name", "start_position": 0, "end_position": 3}])
    base = spark.createDataFrame([(found, json.dumps({"entities": json.loads(found)}))], "ground_truth_entities string, other string")
    kind = "array<struct<value:string,label:string,start_position:int,end_position:int>>"
    for df in (base, base.withColumn("ground_truth_entities", F.col("other")), base.withColumn("ground_truth_entities", F.from_json("ground_truth_entities", kind)), base.withColumn("ground_truth_entities", F.struct(F.from_json("ground_truth_entities", kind).alias("entities")))):
        assert df.select(metrics.expected_entities(df).alias("e")).first().e[0].value == "Ann"
    assert metrics.expected_entities(base.select("other")) is None


def test_steps_are_registered_once_and_checked(spark, rows):
    @columns.column_step("shout", ("text",), ("loud",))
    def shout(df, mark="!"):
        return df.withColumn("loud", F.concat(F.upper("text"), F.lit(mark)))

    assert columns.apply_steps(rows, [("shout", {"mark": "?"})]).first().loud == "NOBODY HERE.?"
    with pytest.raises(InputError):
        columns.column_step("shout")(shout.run)
    with pytest.raises(InputError):
        columns.step("shout")(rows.drop("text"))
    with pytest.raises(InputError):
        columns.step("no such step")
    bad = columns.Step("bad", (), ("x",), lambda df: df)
    with pytest.raises(InputError):
        bad(rows)
    del columns.STEPS["shout"]


def test_recording(spark, tmp_path):
    config, data = Config(Detect(["name"]), replace=Substitute("Keep it short and plain")), Input("people.csv", data_summary="private")
    told = json.dumps(settings(config, data))
    assert "short" not in told and "private" not in told and '"input_kind": "csv"' in told and '"has_entity_labels": true' in told
    r = Recorder(f"{tmp_path}/r.jsonl", "run-1", suite_id="s")
    r.run(config, data)
    with r.stage("detect") as made:
        made["rows"] = 10
    with pytest.raises(RuntimeError), r.stage("replace"):
        raise RuntimeError("x")
    assert r.workflow("validation", "small", 4, 1, 2.0)["requests_per_sec"] == 2
    assert r.records[1]["rows_per_sec"] > 0 and r.records[2]["status"] == "error" and r.frame(spark).count() == 4
    r.write()
    lines = [json.loads(x) for x in (tmp_path / "r.jsonl").read_text().splitlines()]
    assert [x["record_type"] for x in lines] == ["run", "stage", "stage", "model_workflow"] and all(x["run_id"] == "run-1" for x in lines) and r.records == []


def test_seals_tell_records_apart(spark):
    of = lambda *rows: seal(spark.createDataFrame(list(rows), "a int, m map<string,int>"))
    one, two = (1, {"x": 1, "y": 2}), (2, {"x": 1})
    assert of(one, two) == of(two, (1, {"y": 2, "x": 1})) and len({of(one), of(one, one, one), of(one, two, two), of((1, {"x": 1, "y": 3}))}) == 4


def test_public_names_and_logging(spark, rows, caplog):
    assert all(getattr(hushframe, n) for n in hushframe.__all__)
    with pytest.raises(AttributeError):
        hushframe.nothing  # noqa: B018
    with caplog.at_level(logging.INFO, "hushframe"):
        Engine(spark).run(Config(replace=Redact()), Input(rows))
    assert "replace of column text" in caplog.text
    assert shared_folder(spark, "x/") == "x" and shared_folder(spark)
