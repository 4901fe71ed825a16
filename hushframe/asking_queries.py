"""Registered queries of the boundary to models: chunks, lists of prompts, lost rows, records of a run; with their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import spans, text
from .operators import metrics, model, replace
from .plans import engine, prompts
from .plans.config import Config, Detect, Input
from .plans.recording import Recorder
from .queries import _found, _table, query

_PARTS = (("code", 0), ("city", 6), ("name", 12))
#: Each part has a letter, and is there once: spread to other places, it could push another one out.
_LETTERS = " and ".join(f"regexp_matches(substr(text, {at + 1}, 6), '[A-Za-z]') and length(text) - length(replace(lower(text), lower(substr(text, {at + 1}, 6)), '')) = 6" for _, at in _PARTS)
_FOUND = f"length(text) >= 18 and {_LETTERS}"
#: Once, counted without overlaps: a third part that is also one to five places further left, between edges of words if its own are word characters,
#: is spread to there, and of two equally long spans the first stays. Values are stripped, and a shorter one pushes nothing out.
_WORD, _BLANK = r"[\p{L}\p{N}_]", r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EDGE = "not (regexp_matches(substr(text, {own}, 1), '" + _WORD.replace("{", "{{").replace("}", "}}") + "') and regexp_matches(substr(text, {next}, 1), '[A-Za-z0-9_]'))"
_PUSHED = f"(not regexp_matches(substr(text, 13, 6), '^{_BLANK}|{_BLANK}$') and (" + " or ".join(f"(lower(substr(text, {13 - k}, 6)) = lower(substr(text, 13, 6)) and {_EDGE.format(own=13, next=12 - k)} and {_EDGE.format(own=18, next=19 - k)})" for k in range(1, 6)) + "))"


def three_spans() -> Callable[[str, str], str]:
    """A model without chance: finds three spans at the beginning of a text; one judge renames what it is asked about, the other drops it."""

    def answer(prompt: str, alias: str) -> str:
        if alias in ("renames", "drops"):
            asked = re.findall(r'"id":"([a-z]+_[0-9]+_[0-9]+)"', prompt)
            if len(asked) != 1:
                raise ValueError(f"{len(asked)} entities in a chunk of one")
            return json.dumps({"decisions": [{"id": asked[0], "decision": "reclass" if alias == "renames" else "drop", "proposed_label": "thing", "reason": alias}]})
        if alias != "finder":
            return "{}"
        if len(prompt) % 5 == 0:
            raise ConnectionError("not today")
        parts = [prompt[at : at + 6].lower() for _, at in _PARTS]
        if len(prompt) < 18 or not all(re.search("[a-z]", p) and prompt.lower().count(p) == 1 for p in parts):
            return "{}"
        return json.dumps({"entities": [{"text": prompt[at : at + 6], "label": k, "start": at, "end": at + 6, "score": 0.5} for k, at in _PARTS]})

    return answer


_ROLES = {"entity_detector": "finder", "entity_validator": ["renames", "drops"], "entity_augmenter": "adds"}


def _run(spark: SparkSession, sf_dir: str, recorder: Recorder | None = None) -> engine.Result:
    config = Config(Detect(validation_max_entities_per_call=1), replace=replace.Redact())
    return engine.Engine(spark, three_spans, _ROLES, recorder=recorder).run(config, Input(_table(spark, sf_dir, "documents"), id_column="doc_id"))


@query(f"select doc_id, 'thing' as label, s, s + 6 as e, substr(text, s + 1, 6) as found from documents, (values (0), (12)) as t(s) where {_FOUND} and length(text) % 5 <> 0 and not (s = 12 and {_PUSHED})")
def model_detection_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three entities a row, judged one a call: the calls begin at the judges in turn, and their decisions come together."""
    each = _run(spark, sf_dir).trace.select("doc_id", schemas.TEXT, F.explode(schemas.FINAL).alias("e")).filter("e.source = 'detector'")
    return each.select("doc_id", F.col("e.label").alias("label"), F.col("e.start_position").alias("s"), F.col("e.end_position").alias("e"), spans.slice_of(F.col(schemas.TEXT), F.col("e")).alias("found"))


@query("select doc_id, length(text) % 5 = 0 as failed, case when length(text) % 5 = 0 then 'entity-detection' end as step from documents")
def model_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came through, and those that a step failed on, by the record's id."""
    done = _run(spark, sf_dir)
    lost = done.failed.select(F.col("record_id").alias(schemas.RECORD_ID), "step")
    rows = engine.Engine(spark).load(Input(_table(spark, sf_dir, "documents"), id_column="doc_id")).frame.select("doc_id", schemas.RECORD_ID)
    came = done.trace.select(F.col(schemas.RECORD_ID).alias("came"))
    both = rows.join(lost, schemas.RECORD_ID, "left").join(came, F.col(schemas.RECORD_ID) == F.col("came"), "left")
    return both.filter(F.col("step").isNotNull() != F.col("came").isNotNull()).select("doc_id", F.col("step").isNotNull().alias("failed"), "step")


@query(
    f"""with d as (select text, length(text) % 5 = 0 as failed, {_FOUND} as found from documents)
  select 'entity-detection' as name, count(*) as input_rows, count(*) as requests, count_if(failed) as failed_requests, count_if(failed) as failed_rows, null::bigint as documents from d
  union all select 'entity-validation', count_if(found and not failed), 3 * count_if(found and not failed), 0, 0, null from d
  union all select 'entity-augmentation', count_if(not failed), count_if(not failed), 0, 0, null from d
  union all select 'run', count_if(not failed), null, null, null, (select count(*) from d) from d"""
)
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recorder tells of a run's steps, counted while their answers and the result were written."""
    recorder = Recorder()
    done = _run(spark, sf_dir, recorder)
    done.frame.write.format("noop").mode("overwrite").save()
    whole = done.finish()
    rows = [(r["workflow_name"], r["input_rows"], r["observed_total_requests"], r["observed_failed_requests"], r["failed_rows"], None) for r in recorder.records if r["record_type"] == "model_workflow"]
    detected = next(r for r in recorder.records if r.get("stage") == "detection")
    assert detected["rows"] == whole["rows"] and detected["entities"] == whole["entities"]
    # a run without failures would have as many rows as there are documents
    rows.append(("run", whole["rows"], None, None, None, _table(spark, sf_dir, "documents").count()))
    return spark.createDataFrame(rows, "name string, input_rows long, requests long, failed_requests long, failed_rows long, documents long")


class InLists:
    """Answers lists; leaves out every seventh document of one, and fails on lists with an eleventh one."""

    def __call__(self, prompt: str, alias: str) -> str:
        if int(prompt.partition(":")[0]) % 13 == 0:
            raise ConnectionError("not today")
        return prompt.upper()

    def many(self, prompts: list[str], alias: str) -> list[str | None]:
        ids = [int(p.partition(":")[0]) for p in prompts]
        if any(i % 11 == 0 for i in ids):
            raise ConnectionError("not today")
        return [None if i % 7 == 0 or i % 13 == 0 else p.upper() for i, p in zip(ids, prompts, strict=True)]


@query("select doc_id, case when doc_id % 13 <> 0 then doc_id || ':A' end as first, case when doc_id % 13 <> 0 then doc_id || ':B' end as second, case when doc_id % 13 = 0 then 'ConnectionError: not today' end as error from documents")
def model_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts gathered into lists over rows and chunks; what a list leaves out or fails on is asked one by one."""
    asked = _table(spark, sf_dir, "documents").select("doc_id", F.array(F.concat("doc_id", F.lit(":a")), F.concat("doc_id", F.lit(":b"))).alias("prompt"))
    got = model.answers(asked, "prompt", InLists)
    return got.select("doc_id", F.get("answer", 0).alias("first"), F.get("answer", 1).alias("second"), "error")


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL that concatenates a template's parts with expressions."""
    parts, at = [], 0
    for m in prompts.PLACE.finditer(template):
        parts += ["'" + template[at : m.start()].replace("'", "''") + "'", f"coalesce({values[m[1]]}, '')"]
        at = m.end()
    return " || ".join([*parts, "'" + template[at:].replace("'", "''") + "'"])


_LABELS_SHOWN = ["email", "made_up_label"]
_JSON = """'{"decisions":[{"id":"name_' || doc_id % 5 || '_9"}]}'"""
_PIECES = "case doc_id % 4 when 0 then '<amount>total</amount>' when 1 then '[[total|amount]]' when 2 then '((SENSITIVE:amount|total))' else '<<SENSITIVE:amount>>total<</SENSITIVE:amount>>' end"
_NOTATION = "list_value('xml', 'bracket', 'paren', 'sentinel')[doc_id % 4 + 1]"


@query(
    "select doc_id, length(p) as n, md5(p) as digest, contains(p, 'made_up_label') and contains(p, 'sub' || piece || '_sum') as told from (select doc_id, {p} as piece, {f} as p from documents)".format(
        p=_PIECES, f=_filled(prompts.VALIDATE, {"SUMMARY": "source", "LABELS": "'" + prompts.label_examples(_LABELS_SHOWN).replace("'", "''") + "'", "NOTATION": _NOTATION, "PIECE": _PIECES, "EXCERPT": "substr(text, 1, 300)", "SKELETON": _JSON})
    )
)
def validation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a validator is asked: the labels it may choose from, and a piece of a word marked as the row's marks are."""
    k = F.col("doc_id") % 4
    notation = F.when(k == 0, "xml").when(k == 1, "bracket").when(k == 2, "paren").otherwise("sentinel")
    piece = text.entity_tag(F.lit("total"), F.lit("amount"), notation)
    skeleton = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("name_"), F.col("doc_id") % 5, F.lit("_9")).alias("id"))).alias("decisions")))
    filled = prompts.fill_columns(prompts.VALIDATE, {"SUMMARY": F.col("source"), "LABELS": F.lit(prompts.label_examples(_LABELS_SHOWN)), "NOTATION": notation, "PIECE": piece, "EXCERPT": F.substring("text", 1, 300), "SKELETON": skeleton})
    rows = _table(spark, sf_dir, "documents").select("doc_id", piece.alias("piece"), filled.alias("p"))
    return rows.select("doc_id", F.length("p").cast("long").alias("n"), F.md5("p").alias("digest"), (F.contains("p", F.lit("made_up_label")) & F.contains("p", F.concat(F.lit("sub"), "piece", F.lit("_sum")))).alias("told"))


@query(
    """select doc_id, case when doc_id % 7 <> 0 then (doc_id % 10) / 10.0::double end as utility_score, (doc_id % 4)::double as leakage_mass, doc_id % 3 = 0 as any_high_leaked, doc_id % 5 = 0 as needs_repair, null::boolean as needs_human_review, cast(doc_id % 4 as integer) as repair_iterations,
  cast(case when found then 3 * (doc_id % 4 + 1) else 0 end as integer) as evaluations, cast(case when found then doc_id % 4 else 0 end as integer) as repairs from (select *, regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') as found from documents)"""
)
def rewrite_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of rewritten rows: scores, NaN as none, repairs, and the calls that these stand for."""
    d = _found(spark, sf_dir, "email").withColumns({schemas.OUTPUT: F.col(schemas.TEXT), schemas.RECORD_ID: F.col("doc_id").cast("string"), schemas.MAP: replace.no_pairs()})
    k = F.col("doc_id")
    scored = d.withColumns({"utility_score": F.when(k % 7 != 0, (k % 10) / 10).otherwise(F.lit(float("nan"))), "leakage_mass": (k % 4).cast("double"), "any_high_leaked": k % 3 == 0, "_hf_needs_repair": k % 5 == 0, "_hf_repair_iterations": (k % 4).cast("int")})
    got = metrics.record_metrics(scored, "rewrite", "rewrite")
    plain = ("utility_score", "leakage_mass", "any_high_leaked", "needs_repair", "needs_human_review", "repair_iterations")
    return got.select(F.col(schemas.RECORD_ID).cast("long").alias("doc_id"), *plain, F.col("estimated_calls_rewrite_evaluate").cast("int").alias("evaluations"), F.col("estimated_calls_rewrite_repair").cast("int").alias("repairs"))
