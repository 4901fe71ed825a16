"""More registered queries: whole runs of the engine, files written and read back, and the rest of the roll-ups' fields, with their SQL."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import spans
from .operators import analysis, replace, rewrite
from .plans import engine, suite
from .plans.config import Config, Input
from .queries import _CASES, _EVENTS, _LINES, _SPAN_SQL, _docs, _line_spans, _measurements, _replaced_sql, _table, query
from .sources import records, tables


def _path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- the engine


@query(_replaced_sql("'[REDACTED_' || upper(label) || ']'").replace(" as replaced", " as text_replaced"))
def engine_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from the input's columns to the user's (the rules leave out no occurrence, so spreading values adds none)."""
    data = Input(_table(spark, sf_dir, "documents"), id_column="doc_id")
    return engine.Engine(spark).run(Config(replace=replace.Redact()), data).frame.select("doc_id", "text_replaced")


@query("select least(count(*), 10) as rows, 0::bigint as failed from documents")
def engine_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = engine.Engine(spark).preview(Config(replace=replace.Hash()), Input(_table(spark, sf_dir, "documents")))
    return done.frame.agg(F.count(F.lit(1)).alias("rows")).crossJoin(done.failed.agg(F.count(F.lit(1)).alias("failed")))


def scripted() -> Callable[[str, str], str]:
    """A model without chance: finds two spans at the beginning of a text, and when asked renames one and drops the other."""
    decided = json.dumps({"decisions": [{"id": "code_0_6", "decision": "reclass", "proposed_label": "name", "reason": "r"}, {"id": "city_6_12", "decision": "drop", "proposed_label": "", "reason": "r"}]})

    def answer(prompt: str, alias: str) -> str:
        if alias == "checker":
            return decided
        if alias != "finder" or not (re.search("[A-Za-z]", prompt[:6]) and re.search("[A-Za-z]", prompt[6:12])) or len(prompt) < 12:
            return "{}"
        parts = (("code", 0, 6), ("city", 6, 12))
        return json.dumps({"entities": [{"text": prompt[a:b], "label": k, "start": a, "end": b, "score": 0.5} for k, a, b in parts]})

    return answer


@query("select doc_id, 'name' as label, 0 as s, 6 as e, substr(text, 1, 6) as found from documents where length(text) >= 12 and regexp_matches(substr(text, 1, 6), '[A-Za-z]') and regexp_matches(substr(text, 7, 6), '[A-Za-z]')")
def model_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, validation in chunks and suggestions by a model; the spans of the detector that are left."""
    roles = {"entity_detector": "finder", "entity_validator": "checker"}
    done = engine.Engine(spark, scripted, roles).run(Config(replace=replace.Redact()), Input(_table(spark, sf_dir, "documents"), id_column="doc_id"))
    each = done.trace.select("doc_id", schemas.TEXT, F.explode(schemas.FINAL).alias("e")).filter("e.source = 'detector'")
    return each.select("doc_id", F.col("e.label").alias("label"), F.col("e.start_position").alias("s"), F.col("e.end_position").alias("e"), spans.slice_of(F.col(schemas.TEXT), F.col("e")).alias("found"))


@query("select doc_id, cast(least(doc_id % 5, 3) as integer) as repair_iterations, greatest(doc_id % 5 - 3, 0) as leaked, doc_id % 5 > 3 as needs_repair from documents")
def repair_loop_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three rounds, each of the rows that still fail, each of which mends one leak."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("leaked"))
    done = rewrite.repair_loop(rows, lambda x: x.withColumn("needs_repair", F.col("leaked") > 0), lambda x: x.withColumn("leaked", F.col("leaked") - 1), 3, engine.Engine(spark).keep)
    return done.select("doc_id", "repair_iterations", "leaked", "needs_repair")


@query("select doc_id, text as body, 'o' || doc_id as body_replaced, text as _hf_text, 'o' || doc_id as _hf_text_out from documents")
def names_there_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' names as a user's, and back again, side by side."""
    trace = _docs(spark, sf_dir).withColumn(schemas.OUTPUT, F.concat(F.lit("o"), F.col("doc_id").cast("string")))
    user = engine.renamed(trace, "body")
    return user.join(engine.unrenamed(user, "body"), "doc_id").select("doc_id", "body", "body_replaced", schemas.TEXT, schemas.OUTPUT)


@query(f"select id, label || '_' || s || '_' || e as name, label, true as undecided from ({_SPAN_SQL})")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a validator is to fill in: candidates without decisions."""
    rows = _line_spans(spark, sf_dir).select("id", F.explode(spans.skeleton(F.col("spans"))).alias("k"))
    return rows.select("id", F.col("k.id").alias("name"), F.col("k.label").alias("label"), (F.col("k.decision").isNull() & F.col("k.proposed_label").isNull() & F.col("k.reason").isNull()).alias("undecided"))


# ---------------------------------------------------------------- files


@query("select f as format, p_partkey, p_name, p_size, p_retailprice from part, (values ('csv'), ('parquet')) as t(f)")
def tables_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as CSV and as Parquet, read by what its path ends in."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    out = None
    for kind in ("csv", "parquet"):
        path = tables.write_table(part, f"{_path(spark, 'table')}.{kind}")
        got = tables.read_table(spark, path).select(F.lit(kind).alias("format"), *(F.col(f.name).cast(f.dataType) for f in part.schema.fields))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    f"""{_CASES} select case_id, cast(record_count as bigint) as record_count, pipeline_elapsed_sec, final_entity_count, case_failed, case when pipeline_elapsed_sec > 0 then round(record_count / pipeline_elapsed_sec, 9) end as records_per_sec,
    case when record_count > 0 then round(empty_detection_count / record_count, 9) end as empty_rate, case when tp + fn > 0 then round(tp / (tp + fn), 9) end as recall from c"""
)
def measurements_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements from JSON lines, rolled up by case."""
    path = tables.write_table(_measurements(spark, sf_dir), f"{_path(spark, 'measurements')}.jsonl")
    out = analysis.case_rows(records.read_measurements(spark, path))
    rates = {"records_per_sec": "records_per_pipeline_sec", "empty_rate": "empty_detection_rate", "recall": "entity_recall"}
    return out.select("case_id", "record_count", "pipeline_elapsed_sec", "final_entity_count", "case_failed", *(F.round(v, 9).alias(k) for k, v in rates.items()))


@query("select list_value('record', 'stage', 'ndd_workflow', 'evaluation_record')[event_id % 4 + 1] as kind, count(*) as n from events group by 1")
def records_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each kind of record; what the tables hold."""
    made = json.loads(records.export(_measurements(spark, sf_dir), _path(spark, "export")))["tables"]
    out = spark.createDataFrame([], "kind string, n long")
    for kind, path in made.items():
        out = out.unionByName(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return out


@query(
    f"""with m as ({_EVENTS}) select case_id, cast(count_if(t = 1) as bigint) as detection_artifact_rows, cast(sum(case when t = 1 then k % 5 end) as bigint) as seed_entity_count, cast(sum(case when t = 1 then k % 3 end) as bigint) as artifact_final_detector_entity_count,
    cast(count(distinct case when t = 1 then k % 7 end) as integer) as signatures, cast(count_if(t = 2) as bigint) as traces, cast(count_if(t = 2 and event_type = 'error') as bigint) as errors, cast(case when count_if(t = 2) > 0 then count_if(t = 2 and event_type = 'error' and k % 3 = 0) end as bigint) as bridges from m group by case_id"""
)
def artifacts_and_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases beside their detection artifacts and message traces, both read from JSON lines."""
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    run = F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id")
    left = e.filter(k % 4 == 1).select(run, (k % 5).alias("seed_entity_count"), F.create_map(F.lit("detector"), k % 3).alias("final_source_counts"), F.array((k % 7).cast("string")).alias("final_entity_signature_hashes"))
    said = e.filter(k % 4 == 2).select(run, F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"), F.when(k % 3 == 0, analysis.BRIDGE_ERROR).otherwise("Other").alias("error_type"), F.lit("secret").alias("messages"))
    folder = _path(spark, "traces")
    artifacts = records.read_artifacts(spark, tables.write_table(left, f"{_path(spark, 'artifacts')}.jsonl"))
    said.write.json(f"{folder}/deep")
    traces = records.read_traces(spark, folder, "*.json")
    out = analysis.case_rows(_measurements(spark, sf_dir), artifacts, traces)
    return out.select("case_id", "detection_artifact_rows", "seed_entity_count", "artifact_final_detector_entity_count", F.coalesce("artifact_final_entity_signature_count", F.lit(0)).alias("signatures"), F.col("dd_trace_record_count").alias("traces"), F.col("dd_trace_error_count").alias("errors"), F.col("observed_bridge_fallback_requests").alias("bridges"))


@query("select true as in_any_order, false as without_one from (select 1)")
def sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of records is the same in any order, and another if one is there twice."""
    rows = _table(spark, sf_dir, "events").withColumn("counts", F.create_map("event_type", "user_id")).drop("ts")
    once, turned = suite.seal(rows), suite.seal(rows.repartition(3, "user_id"))
    more = suite.seal(rows.unionAll(rows.orderBy("event_id").limit(1)))
    return spark.range(1).select(F.lit(once == turned).alias("in_any_order"), F.lit(once == more).alias("without_one"))


# ---------------------------------------------------------------- roll-ups


@query(f"{_CASES} select count(*) as case_count, cast(count_if(not case_failed) as bigint) as completed_count, round(count_if(not case_failed) / count(*), 9) as success_rate, sum(pipeline_elapsed_sec) as elapsed_sum, round(avg(pipeline_elapsed_sec), 9) as elapsed_mean from c")
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.summary(analysis.case_rows(_measurements(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("success_rate", "elapsed_mean")})


@query(
    f"""{_CASES} select workload_id, config_id, cast(sum(input_text_tokens_total) as bigint) as total_input_text_tokens, cast(sum(empty_detection_count) as bigint) as total_empty_detection_count, cast(sum(error_ndd_workflow_count) as bigint) as error_ndd_workflow_count,
    median(record_count) as median_record_count, median(observed_total_requests) as median_observed_total_requests, round(count_if(case_failed) / count(distinct case_id), 9) as failed_case_rate, case when sum(record_count) > 0 then round(sum(empty_detection_count) / sum(record_count), 9) end as empty_detection_rate,
    case when sum(tp) + sum(fp) > 0 then round(sum(tp) / (sum(tp) + sum(fp)), 9) end as micro_entity_precision, case when 2 * sum(tp) + sum(fp) + sum(fn) > 0 then round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) end as micro_entity_f1,
    cast(sum(detection_judged_record_count) as bigint) as judged, cast(sum(detection_valid_record_count) as bigint) as valid, case when sum(detection_judged_record_count) > 0 then round(sum(detection_valid_record_count) / sum(detection_judged_record_count), 9) end as valid_rate from c group by workload_id, config_id"""
)
def group_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, medians and rates of groups that ``group_rollup`` leaves out."""
    out = analysis.group_rows(analysis.case_rows(_measurements(spark, sf_dir)))
    rounded = [F.round(c, 9).alias(c) for c in ("failed_case_rate", "empty_detection_rate", "micro_entity_precision", "micro_entity_f1")]
    plain = ("workload_id", "config_id", "total_input_text_tokens", "total_empty_detection_count", "error_ndd_workflow_count", "median_record_count", "median_observed_total_requests")
    judged = {"judged": "sum_detection_judged_record_count", "valid": "sum_detection_valid_record_count"}
    return out.select(*plain, *rounded, *(F.col(v).alias(k) for k, v in judged.items()), F.round("micro_detection_valid_rate", 9).alias("valid_rate"))


@query("select n_nationkey as k, cast(n_nationkey + 2 as bigint) as total_requests, cast(n_nationkey % 2 as bigint) as failed_requests, cast(n_nationkey * 3 + 1 as bigint) as input_tokens, cast(5 as bigint) as output_tokens, cast(n_nationkey * 3 + 6 + 7 as bigint) as total_tokens from nation")
def usage_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over two models, one of which says only its input and output."""
    k = F.col("n_nationkey").cast("long")

    def one(requests, failed, read, said, total):
        return F.struct(F.struct(requests.alias("total_requests"), failed.alias("failed_requests")).alias("request_usage"), F.struct(read.alias("input_tokens"), said.alias("output_tokens"), total.alias("total_tokens")).alias("token_usage"))

    nothing, long = F.lit(None).cast("long"), lambda n: F.lit(n).cast("long")
    used = F.create_map(F.lit("a"), one(k, k % 2, k * 3 + 1, long(5), nothing), F.lit("b"), one(long(2), nothing, nothing, nothing, long(7)))
    rows = _table(spark, sf_dir, "nation").withColumn("used", used)
    return rows.select(F.col("n_nationkey").alias("k"), *(v.alias(n) for n, v in analysis.usage_totals(F.col("used")).items()))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each user."""
    return analysis.latest(_table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


_KNOWN = f"select r.*, l.pk from ({_SPAN_SQL}) r join ({_LINES}) l on l.l_orderkey = r.id and l.l_linenumber = r.n"


@query(
    f"""with r as ({_KNOWN}), x as (select *, exists (select 1 from r b where b.id = r.id and b.s <= r.s and b.e >= r.e and (b.s < r.s or b.e > r.e)) as within from r)
    select id, cast(count(distinct (label, pk, s, e)) as integer) as flat, cast(count(distinct case when not within then (label, pk, s, e) end) as integer) as nested from x group by id"""
)
def server_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans a detector's server answers with, flat and nested."""
    return _line_spans(spark, sf_dir).select("id", F.size(spans.final_spans(F.col("spans"), True)).alias("flat"), F.size(spans.final_spans(F.col("spans"), False)).alias("nested"))


@query("select event_id, case event_id % 4 when 0 then value end as plain, case event_id % 4 when 0 then value end as inner_value from events")
def numbers_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What JSON has no number for is null in it, inside lists too."""
    odd = F.when(F.col("event_id") % 4 == 0, F.col("value")).when(F.col("event_id") % 4 == 1, float("nan")).when(F.col("event_id") % 4 == 2, float("inf")).otherwise(float("-inf"))
    rows = _table(spark, sf_dir, "events").select("event_id", odd.alias("plain"), F.array(F.struct(odd.alias("v"))).alias("nested"))
    path = tables.write_table(rows, f"{_path(spark, 'numbers')}.jsonl")
    # read as texts first: a quoted NaN would otherwise be read as one
    texts = spark.read.schema("event_id long, plain string, nested array<struct<v:string>>").json(path)
    return texts.select("event_id", F.col("plain").cast("double").alias("plain"), F.col("nested")[0]["v"].cast("double").alias("inner_value"))


@query("select user_id, arg_max(event_type, event_id) as status, cast(sum(event_id % 9) as double) as observed_total_requests, round(avg(value), 6) as input_rows_per_sec_mean, max(case when event_id % 2 = 0 then event_id end) as last_even from events group by user_id")
def scalar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and last values, by what fields are called."""
    k = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), (k % 9).alias("observed_total_requests"), F.col("value").alias("input_rows_per_sec"), F.when(k % 2 == 0, k).alias("last_even"))
    out = analysis.scalar_rollup(rows, ["user_id"], "event_id", {"last_even": "last"})
    return out.withColumn("input_rows_per_sec_mean", F.round("input_rows_per_sec_mean", 6))


@query(
    f"""with m as ({_EVENTS}) select 'case_analysis' as name, count(distinct case_id) as n from m union all select 'group_analysis', count(*) from (select distinct user_id % 3, case when user_id % 5 > 0 then user_id % 5 end from m)
    union all select 'model_analysis', count(*) from m where t = 2 and (k % 9 > 0 or k % 4 > 0 or k > 0) union all select 'model_group_analysis', count(*) from (select distinct user_id % 3, user_id % 5, event_type from m where t = 2 and (k % 9 > 0 or k % 4 > 0 or k > 0))"""
)
def analysis_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tables of an analysis, written; how many rows each has when read back."""
    out = spark.createDataFrame([], "name string, n long")
    for name, path in tables.write_tables(analysis.analysis_tables(_measurements(spark, sf_dir)), _path(spark, "analysis")).items():
        out = out.unionByName(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out
