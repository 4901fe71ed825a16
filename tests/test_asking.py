"""The boundary to models: narrow answers, caps on calls in flight, lists of prompts, records of runs."""

import json
import random
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Lock, Thread

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hushframe import schemas
from hushframe.operators import model
from hushframe.operators.replace import Hash, Substitute
from hushframe.operators.rewrite import Rewrite
from hushframe.plans.config import Config, Input
from hushframe.plans.engine import Engine
from hushframe.plans.models import Models
from hushframe.plans.recording import Recorder

SAYS = {
    "Make up": {"replacements": [{"original": "Mirela", "label": "name", "synthetic": "Ines"}]},
    "For each entity: sens": {"sensitivity_disposition": [{"id": 1, "source": "t", "category": "direct", "sensitivity": "high", "entity_label": "name", "entity_value": "Mirela", "protection_reason": "r", "protection_method_suggestion": "replace", "combined_risk_level": "high"}]},
    "Rewrite the text": {"rewritten_text": "Somebody."},
}


def writer():
    def call(prompt, alias):
        if alias == "finder":
            return json.dumps({"entities": [{"text": "Mirela", "label": "name", "start": 0, "end": 6, "score": 0.9}]})
        return json.dumps(next((v for k, v in SAYS.items() if prompt.startswith(k)), {}))

    return call


@pytest.fixture(scope="module")
def letters(spark):
    rng = random.Random(4)
    rows = [(i, "Mirela " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(10_000))) for i in range(20)]
    return spark.createDataFrame(rows, "id long, text string")


def test_a_rewrite_writes_texts_once(spark, letters, tmp_path):
    engine = Engine(spark, writer, {"entity_detector": "finder"}, folder=f"file://{tmp_path}")
    got = engine.run(Config(rewrite=Rewrite(risk_tolerance="low", max_repair_iterations=1)), Input(letters))
    judged = engine.evaluate(got)
    assert {r.text_rewritten for r in judged.frame.collect()} == {"Somebody."} and got.failed.count() == 0
    text = letters.agg(F.sum(F.length("text"))).first()[0]
    size = {t.name: sum(f.stat().st_size for f in t.glob("*.parquet")) for t in Path(tmp_path).iterdir()}
    rows = [n for n in size if n.startswith("hf_rows")]
    # random letters hardly compress: one table has the texts, the others are narrow
    assert len(rows) == 1 and 0.6 * text < size[rows[0]] < 1.2 * text
    assert len(size) > 12
    longest = [spark.read.parquet(f"file://{tmp_path}/{n}").select(F.max(F.length(F.to_json(F.struct("*")))).alias("n")).first().n for n in size if n not in rows]
    assert max(longest) < 10_000
    narrow = [f for f in Path(tmp_path).rglob("*.parquet") if f.parent.name not in rows]
    assert not any(schemas.TEXT in pq.read_schema(f).names or schemas.TAGGED in pq.read_schema(f).names for f in narrow)
    # texts and answers lie in the same buckets: nothing is exchanged to bring them together
    plan = judged.trace._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan
    got.forget()
    assert not list(Path(tmp_path).iterdir())


def test_repeated_rows_and_ids_keep_their_own_answers(spark):
    rows = spark.createDataFrame([(1, "Mirela a"), (1, "Mirela b"), (1, "Mirela a"), (None, None)], "id long, text string")
    got = Engine(spark, writer, {"entity_detector": "finder"}).run(Config(replace=Substitute()), Input(rows, id_column="id"))
    assert Counter(r.text_replaced for r in got.frame.collect()) == Counter(["Ines a", "Ines a", "Ines b"]) or Counter(r.text_replaced for r in got.frame.collect()) == Counter(["Ines a", "Ines a", "Ines b", None])


class Counting:
    """A server that notes how many requests it has at once, and in all."""

    def __init__(self, answer, wait=0.05):
        self.now = self.most = self.total = 0
        lock, me = Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                with lock:
                    me.now, me.total = me.now + 1, me.total + 1
                    me.most = max(me.most, me.now)
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                time.sleep(wait)
                with lock:
                    me.now -= 1
                code, told = answer(body)
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(told).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        Thread(target=self.server.serve_forever, daemon=True).start()

    def models(self, parameters="", lists="false"):
        return Models.read(f"model_configs:\n  - {{alias: a, model: m, provider: p, inference_parameters: {{temperature: 0{parameters}}}}}\nproviders:\n  - {{name: p, endpoint: 'http://127.0.0.1:{self.server.server_port}', lists: {lists}}}\n")


def chat(body):
    return 200, {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}], "usage": {"prompt_tokens": 2, "completion_tokens": 1}}


@pytest.mark.parametrize("limit", [1, 4, 6])
def test_calls_in_flight_are_capped(spark, limit):
    server = Counting(chat)
    asked = spark.range(60).repartition(9).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    got = model.answers(asked, "prompt", server.models(f", max_parallel_requests: {limit}").provider(), ["a"]).collect()
    assert {r.answer for r in got} == {f"P{i}" for i in range(60)} and server.total == 60
    assert server.most <= limit and (limit == 1 or server.most > 1)
    assert sum(r.input_tokens for r in got) == 120 and sum(r.calls for r in got) == 60
    server.server.shutdown()


def test_a_model_has_a_time_out_of_its_own():
    server = Counting(chat, wait=1.0)
    call = server.models(", timeout: 0.1").provider(retries=0)()
    with pytest.raises(OSError):
        call("x", "a")
    assert server.models(", timeout: 5").provider(retries=0)()("x", "a") == "X"
    server.server.shutdown()


def test_prompts_go_in_lists(spark):
    def answer(body):
        prompts = body.get("prompt")
        if prompts is None:
            return chat(body)
        if any(p == "p7" for p in prompts):
            return 400, {}
        return 200, {"choices": [{"index": i, "text": p.upper()} for i, p in reversed(list(enumerate(prompts))) if p != "p50"]}

    server = Counting(answer, wait=0)
    asked = spark.range(200).coalesce(2).select("id", F.when(F.col("id") % 10 != 3, F.concat(F.lit("p"), "id")).alias("prompt"))
    got = model.answers(asked, "prompt", server.models(lists="true").provider(retries=0), ["a"], lists=model.Lists(32, 5)).collect()
    assert {r.id: r.answer for r in got} == {i: f"P{i}" if i % 10 != 3 else None for i in range(200)}
    # 180 prompts in 6 lists (3 a task), one of which fails and is asked one by one (32), and one leaves a prompt out
    assert server.total == sum(r.calls for r in got) <= 6 + 32 + 1 and sum(r.failed_calls for r in got) == 1
    server.server.shutdown()


def test_lists_are_sent_when_time_is_up():
    seen = []

    class Call:
        def __call__(self, prompt, alias):
            return prompt

        def many(self, prompts, alias):
            seen.append(len(prompts))
            return prompts

    asker = model.Asker(Call(), ["a", "b"], {"a": 1, "b": 1}, model.Lists(3, 0.02))
    assert asker.ask("x").result(5).answer == "x"
    waiting = [asker.ask(str(i), i % 2) for i in range(8)]
    assert [f.result(5).answer for f in waiting] == [str(i) for i in range(8)]
    asker.close()
    assert seen[0] == 1 and sum(seen) == 9 and max(seen) == 3
    assert model.Asker(Call(), [], {}).ask("x").result().error == "the pool is empty"


def test_a_run_is_recorded(spark, letters, tmp_path):
    recorder = Recorder(f"{tmp_path}/r.jsonl")
    got = Engine(spark, recorder=recorder).run(Config(replace=Hash()), Input(letters))
    got.frame.write.format("noop").mode("overwrite").save()
    whole = got.finish()
    kinds = [(r["record_type"], r.get("stage"), r.get("status")) for r in recorder.records]
    assert kinds == [("run", None, None), ("stage", "detection", "completed"), ("stage", "replace", "completed"), ("stage", "run", "completed")]
    assert recorder.records[1]["rows"] == whole["rows"] == 20 and whole["rows_per_sec"] > 0 and whole["chars"] > 200_000
    assert Engine(spark).run(Config(replace=Hash()), Input(letters)).finish() is None
