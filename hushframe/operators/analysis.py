"""Roll-ups of measurement records: cases, groups of cases, use of models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import f1, ratio
from ..sources.records import LABEL_MAPS, NUMBERS, REQUESTS, VERDICTS
from ..sources.tables import kept
from .medians import counted, rolled_up

GROUP_KEYS = ("workload_id", "workload_category", "config_id", "experimental_detection_strategy", "experimental_replacement_strategy", "entity_label_set_id", "entity_label_count", "threshold")
USAGE_KEYS = ("workload_id", "config_id", "experimental_detection_strategy", "experimental_replacement_strategy", "dd_parser_compat", "workflow_name", "model_alias", "model_name", "model_provider_name")
#: The stage that spans a whole run unless said otherwise, and the error of a client that can't be used from a synchronous call.
PIPELINE, BRIDGE_ERROR = "pipeline", "SyncClientUnavailableError"
MODEL_KINDS = ("ndd_workflow", "model_workflow")


def _tag(*names: str) -> Column:
    return F.coalesce(*(F.col(n) for n in names))


def _first(c: Column, order: str = "_n") -> Column:
    """First value that isn't null, in the order of the records."""
    return F.min_by(c, F.when(c.isNotNull(), F.col(order)))


def failed(c: str = "status") -> Column:
    return F.coalesce(F.lower(c).isin("error", "failed"), F.lit(False))


def merged_counts(df: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Maps of counts added up by key, all columns in one pass; entries that come to 0 are left out."""
    none = F.array().cast("array<struct<c:string,k:string,v:bigint>>")

    def listed(c: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(c), lambda e: F.struct(F.lit(c).alias("c"), e["key"].alias("k"), e["value"].alias("v"))), none)

    each = df.select(*keys, F.explode(F.concat(*map(listed, columns))).alias("_e"))
    sums = each.groupBy(*keys, F.col("_e.c").alias("_c"), F.col("_e.k").alias("_k")).agg(F.sum("_e.v").alias("_v")).filter("_v <> 0")
    maps = (F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("_c") == c, F.struct("_k", "_v"))))).alias(c) for c in columns)
    return sums.groupBy(*keys).agg(*maps)


def with_merged(base: DataFrame, df: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """``base`` with added-up maps of ``df``, empty where a group has none."""
    more = merged_counts(df, keys, columns).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (base[k].eqNullSafe(more[f"_{k}"]) for k in keys))
    joined = base.join(more, on, "left").drop(*(f"_{k}" for k in keys))
    return joined.withColumns({c: F.coalesce(c, F.create_map().cast("map<string,bigint>")) for c in columns})


def _quality(prefix: str = "") -> dict[str, Column]:
    c = lambda n: F.col(prefix + n)
    tp, fp, fn = c("entity_true_positive_count"), c("entity_false_positive_count"), c("entity_false_negative_count")
    final, truth = F.col("final_entity_count") if not prefix else F.col("_final"), c("ground_truth_entity_count")
    rows = (
        ("entity", ratio(tp, tp + fp), ratio(tp, tp + fn)),
        ("entity_relaxed", ratio(c("entity_relaxed_detected_tp_count"), final), ratio(c("entity_relaxed_gt_found_count"), truth)),
        ("entity_relaxed_label_compatible", ratio(c("entity_relaxed_label_compatible_detected_tp_count"), final), ratio(c("entity_relaxed_label_compatible_gt_found_count"), truth)),
    )
    out = {}
    for name, precision, recall in rows:
        out |= {f"{name}_precision": precision, f"{name}_recall": recall, f"{name}_f1": f1(precision, recall)}
    return out


def case_rows(measurements: DataFrame, artifacts: DataFrame | None = None, traces: DataFrame | None = None, whole_run: str = PIPELINE) -> DataFrame:
    """A row for each case: one conditional aggregation of its records, beside one of its artifacts and traces.

    ``whole_run``: the stage whose time is that of a whole run. A case is named by its
    tag, else by its run. First values follow the order of
    time in a run that its records' own order gives.
    """
    named = measurements.withColumn("case_id", _tag("run_tags.case_id", "run_id")).filter("case_id is not null").withColumn("_n", F.monotonically_increasing_id())
    kind = lambda *names: F.col("record_type").isin(*names)
    record, judged, model, stage = kind("record"), kind("evaluation_record"), kind(*MODEL_KINDS), kind("stage")
    pipeline = stage & (F.col("stage") == whole_run)
    tags = {
        **{k: _tag(f"run_tags.{k}") for k in ("suite_id", "workload_id", "config_id", "experimental_detection_strategy", "experimental_replacement_strategy", "dd_parser_compat", "repetition")},
        "workload_category": _tag("run_tags.workload_category", "run_tags.dataset_category"),
        "entity_label_set_id": _tag("run_tags.entity_label_set_id", "run_tags.entity_label_set", "run_tags.label_set", "detect.entity_label_source"),
        "entity_label_count": _tag("run_tags.entity_label_count", "detect.entity_label_count"),
        "threshold": _tag("run_tags.threshold", "detect.threshold"),
        "topology_endpoint_count": _tag("run_tags.topology_endpoint_count", "run_tags.endpoint_count"),
        "topology_gpu_count": _tag("run_tags.topology_gpu_count", "run_tags.gpu_count"),
        "topology_tensor_parallelism": _tag("run_tags.topology_tensor_parallelism", "run_tags.tensor_parallelism"),
        "topology_shard_count": _tag("run_tags.topology_shard_count", "run_tags.shard_count"),
        "validation_max_entities_per_call": _tag("detect.validation_max_entities_per_call"),
        "run_id": _tag("run_id"),
    }
    sums = {n: F.sum(F.when(record, F.col(n))) for n in NUMBERS if n != "text_length_tokens"}
    sums |= {n: F.coalesce(F.sum(F.when(model, F.col(n))), F.lit(0)) for n in REQUESTS}
    counts = {
        "error_stage_count": F.count_if(stage & failed()), "error_ndd_workflow_count": F.count_if(kind("ndd_workflow") & failed()), "error_model_workflow_count": F.count_if(model & failed()),
        "pipeline_elapsed_sec": F.sum(F.when(pipeline, F.col("elapsed_sec"))), "ndd_workflow_count": F.count_if(kind("ndd_workflow")),
        "ndd_elapsed_sec_total": F.coalesce(F.sum(F.when(kind("ndd_workflow"), F.col("elapsed_sec"))), F.lit(0.0)),
        "record_count": F.count_if(record), "input_text_tokens_total": F.sum(F.when(record, F.col("text_length_tokens"))),
        "empty_detection_count": F.count_if(record & (F.col("final_entity_count") == 0)),
        "ground_truth_record_count": F.count_if(record & F.col("ground_truth_entity_count").isNotNull()),
        "empty_detection_with_ground_truth_count": F.count_if(record & (F.col("final_entity_count") == 0) & (F.col("ground_truth_entity_count") > 0)),
        "original_value_leak_record_count": F.count_if(record & (F.col("original_value_leak_count") > 0)),
    }
    for name, valid, bad in VERDICTS:
        counts |= {f"{name}_judged_record_count": F.count_if(judged & F.col(valid).isNotNull()), f"{name}_valid_record_count": F.count_if(judged & F.col(valid)), bad: F.coalesce(F.sum(F.when(judged, F.col(bad))), F.lit(0))}
    out = named.groupBy("case_id").agg(*(_first(c).alias(k) for k, c in tags.items()), *(c.alias(k) for k, c in {**sums, **counts}.items()))

    if artifacts is not None:
        a = artifacts.withColumn("case_id", _tag("case_id", "run_id"))
        made = a.groupBy("case_id").agg(
            F.count(F.lit(1)).alias("detection_artifact_rows"), *(F.sum(n).alias(n) for n in ("seed_entity_count", "seed_validation_candidate_count", "augmented_entity_count", "augmented_new_final_value_count")),
            F.sum("final_entity_count").alias("artifact_final_entity_count"), *(F.sum(F.try_element_at("final_source_counts", F.lit(s))).alias(f"artifact_final_{s}_entity_count") for s in ("detector", "augmenter")),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("final_entity_signature_hashes")))).alias("artifact_final_entity_signature_hashes"),
        )
        out = out.join(made, "case_id", "full")
        out = out.withColumns({"detection_artifact_rows": F.coalesce("detection_artifact_rows", F.lit(0)), "artifact_final_entity_signature_count": F.size("artifact_final_entity_signature_hashes"), "final_entity_count": F.coalesce("final_entity_count", "artifact_final_entity_count")})
    if traces is not None:
        t = traces.withColumn("case_id", _tag("run_tags.case_id", "run_id"))
        error = F.col("status") == "error"
        seen = t.groupBy("case_id").agg(F.count(F.lit(1)).alias("dd_trace_record_count"), F.count_if(error).alias("dd_trace_error_count"), F.count_if(error & (F.col("error_type") == BRIDGE_ERROR)).alias("observed_bridge_fallback_requests"))
        out = out.join(seen, "case_id", "full").withColumns({"dd_trace_record_count": F.coalesce("dd_trace_record_count", F.lit(0)), "dd_trace_error_count": F.coalesce("dd_trace_error_count", F.lit(0))})
        bridge = F.col("observed_bridge_fallback_requests")
        less = lambda c: F.when(bridge.isNotNull(), F.greatest(F.coalesce(F.col(c), F.lit(0)) - bridge, F.lit(0)))
        out = out.withColumns({"observed_non_bridge_total_requests": less("observed_total_requests"), "observed_non_bridge_failed_requests": less("observed_failed_requests")})
        out = out.withColumn("observed_non_bridge_failed_request_rate", ratio(F.col("observed_non_bridge_failed_requests"), F.col("observed_non_bridge_total_requests")))

    c = F.col
    derived = {
        "run_id": F.coalesce("run_id", "case_id"), "case_failed": (c("error_stage_count") > 0) | (c("error_ndd_workflow_count") > 0) | (c("error_model_workflow_count") > 0),
        "observed_failed_request_rate": ratio(c("observed_failed_requests"), c("observed_total_requests")),
        "records_per_pipeline_sec": ratio(c("record_count"), c("pipeline_elapsed_sec")), "records_per_ndd_sec": ratio(c("record_count"), c("ndd_elapsed_sec_total")),
        "input_text_tokens_per_pipeline_sec": ratio(c("input_text_tokens_total"), c("pipeline_elapsed_sec")), "input_text_tokens_per_ndd_sec": ratio(c("input_text_tokens_total"), c("ndd_elapsed_sec_total")),
        "empty_detection_rate": ratio(c("empty_detection_count"), c("record_count")), "empty_detection_with_ground_truth_rate": ratio(c("empty_detection_with_ground_truth_count"), c("ground_truth_record_count")),
        **_quality(), **{f"{n}_valid_rate": ratio(c(f"{n}_valid_record_count"), c(f"{n}_judged_record_count")) for n, _, _ in VERDICTS},
    }
    out = out.withColumns(derived)
    out = out.withColumns({"input_text_tokens_per_endpoint_sec": ratio(c("input_text_tokens_per_pipeline_sec"), c("topology_endpoint_count")), "input_text_tokens_per_gpu_sec": ratio(c("input_text_tokens_per_pipeline_sec"), c("topology_gpu_count"))})
    return with_merged(out, named.filter(record), ["case_id"], LABEL_MAPS)


def group_rows(cases: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """Cases by workload, configuration and strategies; null keys make groups of their own.

    Cases are made once, into a table; medians of large groups are selected, so that
    no task holds a group.
    """
    cases, rows = counted(cases, "cases", keep)
    have = lambda names: [n for n in names if n in cases.columns]
    totals = ("error_stage_count", "error_ndd_workflow_count", "error_model_workflow_count")
    medians = have((
        "pipeline_elapsed_sec", "ndd_elapsed_sec_total", *REQUESTS, "observed_failed_request_rate", "observed_bridge_fallback_requests", "observed_non_bridge_total_requests",
        "observed_non_bridge_failed_requests", "observed_non_bridge_failed_request_rate", "record_count", "input_text_tokens_total", "records_per_pipeline_sec", "records_per_ndd_sec",
        "input_text_tokens_per_pipeline_sec", "input_text_tokens_per_ndd_sec", "topology_endpoint_count", "topology_gpu_count", "topology_tensor_parallelism", "topology_shard_count",
        "input_text_tokens_per_endpoint_sec", "input_text_tokens_per_gpu_sec", "final_entity_count", "entity_relaxed_f1", "entity_relaxed_label_compatible_f1",
        "replacement_missing_final_entity_count", "replacement_missing_final_value_count", "replacement_synthetic_original_collision_count", "replacement_synthetic_original_collision_value_count", "original_value_leak_count",
        "seed_entity_count", "seed_validation_candidate_count", "augmented_entity_count", "augmented_new_final_value_count", "artifact_final_entity_count", "artifact_final_detector_entity_count", "artifact_final_augmenter_entity_count", "artifact_final_entity_signature_count",
    ))
    sums = [n for n in NUMBERS if n.startswith(("ground_truth", "entity_"))] + ["original_value_leak_count"]
    zero = lambda n: F.coalesce(F.sum(n), F.lit(0))
    aggregates = [
        F.countDistinct("case_id").alias("case_count"), F.count_if("case_failed").alias("failed_case_count"), *(zero(n).alias(n) for n in totals),
        zero("record_count").alias("total_record_count"), F.sum("input_text_tokens_total").alias("total_input_text_tokens"), zero("empty_detection_count").alias("total_empty_detection_count"),
        zero("ground_truth_record_count").alias("total_ground_truth_record_count"), zero("empty_detection_with_ground_truth_count").alias("total_empty_detection_with_ground_truth_count"),
        F.sum("final_entity_count").alias("_final"), *(F.sum(n).alias(f"sum_{n}") for n in sums), F.count_if(F.col("original_value_leak_count") > 0).alias("leaking_case_count"),
    ]
    for name, _, bad in VERDICTS:
        aggregates += [zero(f"{name}_judged_record_count").alias(f"sum_{name}_judged_record_count"), zero(f"{name}_valid_record_count").alias(f"sum_{name}_valid_record_count"), zero(bad).alias(f"sum_{bad}")]
    out = rolled_up(cases, GROUP_KEYS, aggregates, medians, keep, rows=rows)
    c = F.col
    derived = {"failed_case_rate": ratio(c("failed_case_count"), c("case_count")), "empty_detection_rate": ratio(c("total_empty_detection_count"), c("total_record_count")), "empty_detection_with_ground_truth_rate": ratio(c("total_empty_detection_with_ground_truth_count"), c("total_ground_truth_record_count"))}
    derived |= {f"micro_{k}": v for k, v in _quality("sum_").items()}
    derived |= {f"micro_{n}_valid_rate": ratio(c(f"sum_{n}_valid_record_count"), c(f"sum_{n}_judged_record_count")) for n, _, _ in VERDICTS}
    out = out.withColumns(derived).drop("_final")
    return with_merged(out, cases, list(GROUP_KEYS), LABEL_MAPS[:2])


def usage_rows(measurements: DataFrame) -> DataFrame:
    """A row for each workflow and model that was used."""
    rows = measurements.filter(F.col("record_type").isin(*MODEL_KINDS))
    each = rows.select("run_tags", "run_id", "workflow_name", F.col("elapsed_sec").alias("ndd_elapsed_sec"), F.explode("model_usage").alias("_key", "u"))
    number = lambda path: F.coalesce(F.col(f"u.{path}"), F.lit(0))
    out = each.select(
        *(F.col(f"run_tags.{k}") for k in ("suite_id", "workload_id", "config_id", "experimental_detection_strategy", "experimental_replacement_strategy", "dd_parser_compat", "repetition")),
        F.coalesce("run_tags.case_id", "run_id").alias("case_id"), F.coalesce("run_id", "run_tags.case_id").alias("run_id"), "workflow_name", "ndd_elapsed_sec", F.col("u.model_alias").alias("model_alias"), F.coalesce("u.model_name", "_key").alias("model_name"), F.col("u.model_provider_name").alias("model_provider_name"),
        number("request_usage.total_requests").alias("observed_total_requests"), number("request_usage.successful_requests").alias("observed_successful_requests"), number("request_usage.failed_requests").alias("observed_failed_requests"),
        number("token_usage.input_tokens").alias("observed_input_tokens"), number("token_usage.output_tokens").alias("observed_output_tokens"), number("token_usage.total_tokens").alias("observed_total_tokens"), F.col("u.token_usage.reasoning_tokens").alias("observed_reasoning_tokens"),
    )
    used = reduce(lambda a, b: a | b, (F.col(n) > 0 for n in REQUESTS))
    return out.filter(F.col("case_id").isNotNull() & used).withColumn("observed_failed_request_rate", ratio(F.col("observed_failed_requests"), F.col("observed_total_requests")))


def usage_group_rows(usage: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    usage, rows = counted(usage, "usage", keep)
    sums = [F.countDistinct("case_id").alias("case_count"), F.count(F.lit(1)).alias("workflow_count"), *(F.sum(n).alias(f"sum_{n}") for n in REQUESTS), F.sum("observed_reasoning_tokens").alias("sum_observed_reasoning_tokens")]
    out = rolled_up(usage, USAGE_KEYS, sums, ("observed_total_requests", "observed_failed_requests", "observed_total_tokens"), keep, rows=rows)
    return out.withColumn("observed_failed_request_rate", ratio(F.col("sum_observed_failed_requests"), F.col("sum_observed_total_requests")))


def usage_totals(usage: Column) -> dict[str, Column]:
    """Totals over a map of models; total tokens fall back to input plus output."""
    values = F.map_values(usage)
    add = lambda f: F.aggregate(values, F.lit(0).cast("long"), lambda acc, u: acc + F.coalesce(f(u), F.lit(0)))
    tokens = lambda u: F.coalesce(u["token_usage"]["total_tokens"], u["token_usage"]["input_tokens"] + u["token_usage"]["output_tokens"])
    return {"total_requests": add(lambda u: u["request_usage"]["total_requests"]), "failed_requests": add(lambda u: u["request_usage"]["failed_requests"]), "input_tokens": add(lambda u: u["token_usage"]["input_tokens"]), "output_tokens": add(lambda u: u["token_usage"]["output_tokens"]), "total_tokens": add(tokens)}


#: Step names and the classes they are counted in.
STEPS = {"entity-detection": "detection", "latent-detection": "latent", "replace-map": "replace", "rewrite-pipeline": "rewrite", "rewrite-evaluate": "evaluate", "rewrite-repair": "repair", "rewrite-final-judge": "judge"}


def step_class(step: Column) -> Column:
    return F.coalesce(*(F.when(step.startswith(k), F.lit(v)) for k, v in STEPS.items()), F.lit("other"))


def failure_counts(failed_rows: DataFrame) -> DataFrame:
    """Failed records by class of step, a column for each class."""
    return failed_rows.agg(*(F.count_if(step_class(F.col("step")) == v).alias(v) for v in [*STEPS.values(), "other"]))


def repair_rounds(failed_rows: DataFrame) -> DataFrame:
    n = F.regexp_extract("step", r"^rewrite-repair-(\d+)$", 1)
    return failed_rows.agg(F.countDistinct(F.when(n != "", n)).alias("repair_rounds"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by ``order``, found in the tasks before anything is exchanged."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(order).isNotNull(), order)).alias("_row")).select("_row.*")


def summary(cases: DataFrame) -> DataFrame:
    done = F.count_if(~F.col("case_failed"))
    n = F.count(F.lit(1))
    return cases.agg(n.alias("case_count"), done.alias("completed_count"), ratio(done, n).alias("success_rate"), F.sum("pipeline_elapsed_sec").alias("elapsed_sum"), F.avg("pipeline_elapsed_sec").alias("elapsed_mean"))


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """How many texts there are, and the least, greatest and mean length of those that aren't null."""
    n = F.length(text)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(text).alias("texts"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"))


def label_frequency(df: DataFrame, entities: str) -> DataFrame:
    """Labels with how often they occur and their place by that; of equal ones the first by name. A row a label."""
    counts = df.select(F.explode(F.transform(entities, lambda e: e["label"])).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def analysis_tables(measurements: DataFrame, artifacts: DataFrame | None = None, traces: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four tables of an analysis: cases, groups of cases, use of models, and groups of that."""
    cases, usage = case_rows(measurements, artifacts, traces), usage_rows(measurements)
    return {"case_analysis": cases, "group_analysis": group_rows(cases), "model_analysis": usage, "model_group_analysis": usage_group_rows(usage)}


#: How names of fields end whose values are averaged; other numbers are added up, and of what isn't a number the last counts.
MEANS = ("_rate", "_per_sec", "_precision", "_recall", "_f1", "_score", "_fraction")


def scalar_kind(field: T.StructField) -> str:
    """sum, mean or last: how a field of records is rolled up."""
    if not isinstance(field.dataType, T.NumericType):
        return "last"
    return "mean" if field.name.endswith(MEANS) else "sum"


def scalar_rollup(records: DataFrame, keys: list[str], order: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """A row a key: sums, means (as name_mean) and last values of the other fields, nulls left out.

    ``order`` tells which value is the last; ``kinds`` overrides ``scalar_kind`` by name.
    All are partial aggregates, so a key's records never meet in one task.
    """
    made = []
    for f in records.schema.fields:
        if f.name in (*keys, order):
            continue
        c, kind = F.col(f"`{f.name}`"), (kinds or {}).get(f.name, scalar_kind(f))
        if kind == "sum":
            made.append(F.sum(c.cast("double")).alias(f.name))
        elif kind == "mean":
            made.append(F.avg(c.cast("double")).alias(f"{f.name}_mean"))
        elif kind == "last":
            made.append(F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(f.name))
        else:
            raise ValueError(f"{f.name}: {kind!r} isn't sum, mean or last")
    return records.groupBy(*keys).agg(*made)
