"""Configurations as plain values, the command line, exported detections, prompts, counts of spans, tables from addresses."""

import json
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from threading import Thread

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe import cli, schemas
from hushframe.functions import sql
from hushframe.operators import analysis, detect, metrics
from hushframe.operators.replace import Annotate, Hash, Redact, Substitute
from hushframe.operators.rewrite import PrivacyGoal, Rewrite
from hushframe.plans import columns
from hushframe.plans.config import Config, Detect, Input, config_of, spec_of
from hushframe.plans.engine import Engine
from hushframe.sources import tables
from hushframe.sources.tables import InputError


@pytest.mark.parametrize("config", [Config(replace=Redact(normalize_label=False)), Config(Detect(["name"], 0.5, 7, 9), replace=Hash("md5", 8)), Config(replace=Annotate()), Config(replace=Substitute("brief")), Config(rewrite=Rewrite(PrivacyGoal("all that tells who it is"), "x", "high", 0, True))])
def test_configurations_there_and_back(config):
    import yaml

    assert config_of(json.loads(json.dumps(spec_of(config)))) == config == config_of(yaml.safe_load(yaml.safe_dump(spec_of(config))))


def test_options_of_the_command_line(tmp_path, capsys):
    def told(*args):
        return cli.configured(cli.parser().parse_args(["validate", "x.csv", *args]))

    got = told("--labels", "name,email", "--threshold", "0.6", "--validation-entities", "5", "--validation-window", "50", "--replace", "hash", "--algorithm", "sha1", "--digest-length", "9")
    assert got == Config(Detect(["name", "email"], 0.6, 5, 50), replace=Hash("sha1", 9))
    assert told("--replace", "redact", "--plain-labels", "--template", "({label})").replace == Redact("({label})", False)
    got = told("--risk-tolerance", "high", "--protect", "all that tells who it is", "--max-repair-iterations", "0", "--strict-protection", "--instructions", "brief").rewrite
    assert (got.privacy_goal.protect, got.max_repair_iterations, got.strict_entity_protection, got.instructions) == ("all that tells who it is", 0, True, "brief")
    (tmp_path / "c.yaml").write_text(json.dumps(spec_of(Config(replace=Annotate()))))
    assert told("--config", f"{tmp_path}/c.yaml") == Config(replace=Annotate())
    assert cli.main(["validate", "x.csv", "--debug", "--replace", "annotate"]) == 0 and json.loads(capsys.readouterr().out)["replace"]["kind"] == "annotate"
    for bad in (["--risk-tolerance", "low", "--replace", "hash"], ["--threshold", "3"], ["--risk-tolerance", "low", "--protect", "x"]):
        assert cli.main(["validate", "x.csv", *bad]) == 2


def test_records_and_exports_of_the_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.co now"), (2, "nothing")], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in.parquet")
    assert cli.main(["run", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/out.parquet", "--records", f"{tmp_path}/r.jsonl", "--quiet"]) == 0
    made = [json.loads(x) for x in (tmp_path / "r.jsonl").read_text().splitlines()]
    assert [r.get("stage") for r in made] == [None, "detection", "replace", "run"] and made[-1]["rows"] == 2 and made[1]["entities"] == 1
    assert cli.main(["export", f"{tmp_path}/in.parquet", "--output", f"{tmp_path}/export", "--labels", "email", "--id-column", "id", "--quiet"]) == 0
    got = Engine(spark).run_exported(f"{tmp_path}/export")
    assert {r.id: [e.value for e in r.final_entities] for r in got.collect()} == {1: ["a@b.co"], 2: []}


def test_an_exported_detection_is_run_with_models(spark, tmp_path):
    def finder():
        return lambda prompt, alias: json.dumps({"entities": [{"text": "Mirela", "label": "name", "start": 0, "end": 6, "score": 0.9}]}) if alias == "finder" and prompt.startswith("Mirela") else "{}"

    rows = spark.createDataFrame([(1, "Mirela went"), (2, "nobody")], "id long, text string")
    folder = Engine(spark, finder, {"entity_detector": "finder"}).export_detection(Config(replace=Redact()), Input(rows, data_summary="notes"), f"{tmp_path}/e")
    again = Engine(spark, finder)
    assert {r.id: [e.value for e in r.final_entities] for r in again.run_exported(folder).collect()} == {1: ["Mirela"], 2: []} and again.roles["entity_detector"] == "finder"


def test_repair_prompts_say_how_much_leaks(spark):
    seen = []
    says = {
        "For each entity: sens": {"sensitivity_disposition": [{"id": 1, "source": "t", "category": "direct", "sensitivity": "high", "entity_label": "name", "entity_value": "Mirela", "protection_reason": "r", "protection_method_suggestion": "replace", "combined_risk_level": "high"}]},
        "Rewrite the text": {"rewritten_text": "Mirela again"},
    }

    def writer():
        def call(prompt, alias):
            if alias == "finder":
                return json.dumps({"entities": [{"text": "Mirela", "label": "name", "start": 0, "end": 6, "score": 0.9}]})
            if alias == "mender":
                return json.dumps({"rewritten_text": prompt})
            return json.dumps(next((v for k, v in says.items() if prompt.startswith(k)), {}))

        return call

    rows = spark.createDataFrame([(1, "Mirela went home")], "id long, text string")
    done = Engine(spark, writer, {"entity_detector": "finder", "repairer": "mender"}).run(Config(rewrite=Rewrite(risk_tolerance="low", max_repair_iterations=1)), Input(rows))
    seen = done.frame.first().text_rewritten
    assert "leaks 1.00, which has to be below 1.0" in seen and "high sensitivity leaks" in seen and "Mirela again" in seen and "Mirela went home" in seen and '"entity_value":"Mirela"' in seen and "PROTECT: " in seen


SPAN = st.tuples(st.sampled_from(["a", "b", "c", "", None]), st.sampled_from(["x", "y", "", None]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(SPAN, max_size=9), st.lists(SPAN, max_size=9)), min_size=1, max_size=12))
def test_counts_of_spans_are_those_of_counters(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p array<struct<value:string,label:string>>, g array<struct<value:string,label:string>>")
    for r in df.select("p", "g", metrics.strict_counts(F.col("p"), F.col("g")).alias("n"), metrics.label_counts(F.col("p")).alias("l")).collect():
        named = lambda a: Counter((e.value, e.label) for e in a if e.value is not None and e.label is not None)
        p, g = named(r.p), named(r.g)
        tp = sum((p & g).values())
        assert tuple(r.n) == (tp, sum(p.values()) - tp, sum(g.values()) - tp)
        assert r.l == Counter(e.label for e in r.p if e.label)


def test_latest_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w")], "k string, n int, v string")
    assert sorted((r.k, r.n, r.v) for r in analysis.latest(df, ["k"], "n").collect()) == [("a", 3, "y"), ("b", None, "w")]


def test_tables_from_an_address_go_to_the_shared_folder(spark):
    class Files(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path.startswith("/t.csv") else 404)
            self.end_headers()
            self.wfile.write(b"id,text\n1,hello\n2,there\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Files)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    got = tables.read_table(spark, f"{url}/t.csv?x=1")
    assert sorted(r.text for r in got.collect()) == ["hello", "there"] and tables.shared_folder(spark).removeprefix("file://") in got.inputFiles()[0]
    with pytest.raises(tables.TableError):
        tables.read_table(spark, f"{url}/none.csv")
    server.shutdown()


def test_record_scores(spark):
    row = spark.createDataFrame([("t", 0.5, 2)], f"{schemas.OUTPUT} string, utility_score double, _hf_repair_iterations int").withColumns({schemas.TEXT: F.lit("t"), schemas.FINAL: F.array().cast(f"array<{schemas.ENTITY.simpleString()}>"), schemas.MAP: F.array().cast("array<struct<original:string,label:string,synthetic:string>>")})
    full = row.withColumns({schemas.ENTITIES: F.col(schemas.FINAL), schemas.BY_VALUES: F.array(F.struct(F.lit("v").alias("value"), F.array(F.lit("l")).alias("labels")))})
    got = metrics.record_metrics(full, "rewrite").first()
    assert (got.utility_score, got.leakage_mass, got.repair_iterations, got.estimated_calls_rewrite_evaluate, got.estimated_calls_rewrite_repair) == (0.5, None, 2, 9, 2)
    assert "utility_score" not in metrics.record_metrics(full, "replace").columns
    with pytest.raises(InputError):
        tables.read_table(spark, "x.txt")


def test_steps_of_rows(spark):
    @columns.row_step("count-words", ("text",), "n int, words array<string>")
    def count_words(text, mark=" "):
        words = [(x or "").split(mark) for x in text.to_pylist()]
        return {"n": [len(w) for w in words], "words": words}

    @columns.row_step("lossy", ("text",), "x int")
    def lossy(text):
        return {"x": [1]}

    df = spark.createDataFrame([(1, "a b", {"k": 1}), (2, None, None), (3, "c-d", {})], "id int, text string, m map<string,int>")
    try:
        got = columns.apply_steps(df, [("count-words", {"mark": "-"})])
        assert got.columns == ["id", "text", "m", "n", "words"]
        assert [(r.id, r.m, r.n, r.words) for r in got.orderBy("id").collect()] == [(1, {"k": 1}, 1, ["a b"]), (2, None, 1, [""]), (3, {}, 2, ["c", "d"])]
        with pytest.raises(InputError, match="which is there"):
            columns.apply_steps(got, ["count-words"])
        with pytest.raises(InputError, match="needs text"):
            columns.apply_steps(df.drop("text"), ["count-words"])
        with pytest.raises(Exception, match="another number of values"):
            columns.apply_steps(df.coalesce(1), ["lossy"]).collect()
        assert columns.apply_steps(df.limit(0), ["count-words"]).count() == 0
    finally:
        del columns.STEPS["count-words"], columns.STEPS["lossy"]


def test_spans_as_a_table_function(spark):
    texts = ["mail a@b.co, see https://x.org/a?b=c@d.e and 10.0.0.1", "plain", None, "é😀 4111111111111111 +49 30 1234 5678 q@é.w"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.createOrReplaceTempView("texts_of_a_test")
    name = sql.register(spark)
    got = {tuple(r) for r in spark.sql(f"select d.i, s.* from texts_of_a_test d, lateral {name}(d.t) s").collect()}
    own = detect.detect(df.withColumnRenamed("t", schemas.TEXT)).select("i", F.explode(schemas.ENTITIES).alias("e")).collect()
    assert got == {(r.i, r.e.id, r.e.label, r.e.value, r.e.start_position, r.e.end_position, r.e.score, r.e.source) for r in own} and len(got) > 4
    assert {r.label for r in spark.sql(f"select s.label from texts_of_a_test d, lateral {sql.register(spark, ['email'], 'mails')}(d.t) s").collect()} == {"email"}
