"""Measurement records: JSON lines of several kinds, read with a declared schema."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..schemas import AUGMENTED, ENTITY, B, D, L, S, _struct
from .tables import InputError, kept, present, suffix_of, write_table

from pyspark.sql import types as T  # isort: skip

_TAGS = _struct(
    suite_id=S, workload_id=S, workload_category=S, dataset_category=S, config_id=S, case_id=S, repetition=L,
    experimental_detection_strategy=S, experimental_replacement_strategy=S, dd_parser_compat=S,
    entity_label_set_id=S, entity_label_set=S, label_set=S, entity_label_count=L, threshold=D,
    topology_endpoint_count=D, endpoint_count=D, topology_gpu_count=D, gpu_count=D,
    topology_tensor_parallelism=D, tensor_parallelism=D, topology_shard_count=D, shard_count=D,
)
_USAGE = _struct(
    model_alias=S, model_name=S, model_provider_name=S,
    request_usage=_struct(successful_requests=L, failed_requests=L, total_requests=L),
    token_usage=_struct(input_tokens=L, output_tokens=L, total_tokens=L, reasoning_tokens=L),
)
_COUNTS = T.MapType(S, L)
NUMBERS = (
    "text_length_tokens", "final_entity_count", "ground_truth_entity_count",
    "entity_true_positive_count", "entity_false_positive_count", "entity_false_negative_count",
    "entity_relaxed_gt_found_count", "entity_relaxed_detected_tp_count",
    "entity_relaxed_label_compatible_gt_found_count", "entity_relaxed_label_compatible_detected_tp_count",
    "replacement_count", "replacement_missing_final_entity_count", "replacement_missing_final_value_count",
    "replacement_synthetic_original_collision_count", "replacement_synthetic_original_collision_value_count",
    "original_value_leak_count",
)
LABEL_MAPS = ("replacement_missing_final_entity_label_counts", "replacement_synthetic_original_collision_label_counts", "original_value_leak_label_counts")
REQUESTS = ("observed_total_requests", "observed_successful_requests", "observed_failed_requests", "observed_input_tokens", "observed_output_tokens", "observed_total_tokens")
#: A judge's name, its verdict and its number of bad items.
VERDICTS = (
    ("detection", "detection_valid", "detection_invalid_entity_count"),
    ("type_fidelity", "type_fidelity_valid", "type_fidelity_invalid_replacement_count"),
    ("relational_consistency", "relational_consistency_valid", "relational_consistency_invalid_relation_count"),
    ("attribute_fidelity", "attribute_fidelity_valid", "attribute_fidelity_invalid_entity_count"),
)

MEASUREMENT = _struct(
    record_type=S, run_id=S, run_tags=_TAGS, workflow_name=S, stage=S, status=S, elapsed_sec=D,
    **dict.fromkeys(REQUESTS, L), model_usage=T.MapType(S, _USAGE),
    detect=_struct(validation_max_entities_per_call=L, entity_label_source=S, entity_label_count=L, threshold=D),
    **dict.fromkeys(NUMBERS, L), **dict.fromkeys(LABEL_MAPS, _COUNTS),
    **{v: B for _, v, _ in VERDICTS}, **{n: L for _, _, n in VERDICTS},
)
ARTIFACT = _struct(
    suite_id=S, workload_id=S, workload_category=S, config_id=S, case_id=S, run_id=S, repetition=L, workflow_name=S,
    seed_entity_count=L, seed_validation_candidate_count=L, augmented_entity_count=L, augmented_new_final_value_count=L,
    final_entity_count=L, final_source_counts=_COUNTS, final_entity_signature_count=L, final_entity_signature_hashes=T.ArrayType(S),
)
#: What is safe to read of a message trace: no messages, no responses.
TRACE = _struct(record_type=S, run_id=S, workflow_name=S, model_alias=S, status=S, error_type=S, is_async=B, run_tags=_TAGS)


def _named(kind: T.DataType, names: dict[str, str]) -> T.DataType:
    """A type with its fields under the names that files have."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(names.get(f.name, f.name), _named(f.dataType, names)) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _named(kind.valueType, names))
    return kind


def read_measurements(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Measurements of a file; ``names``: what fields of ours are called in it, where that differs."""
    suffix = suffix_of(path)
    if suffix not in (".jsonl", ".json"):
        raise InputError(f"{path}: measurements are .jsonl or .json")
    theirs = _named(MEASUREMENT, names or {})
    frame = spark.read.schema(theirs).option("multiLine", suffix == ".json").json(path)
    return frame.select(*(F.col(f.name).cast(own.dataType).alias(own.name) for f, own in zip(theirs.fields, MEASUREMENT.fields, strict=True)))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT).json(path)


def read_traces(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Traces in a folder and those below it; what the schema lacks isn't parsed."""
    return spark.read.schema(TRACE).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)


def export(measurements: DataFrame, folder: str, suffix: str = ".parquet", overwrite: bool = False) -> str:
    """A table for each kind of record, and a manifest of them (as JSON)."""
    kinds = sorted(r[0] for r in measurements.select("record_type").distinct().collect() if r[0] is not None)
    tables = {}
    for kind in kinds:
        rows = present(measurements.filter(F.col("record_type") == kind))
        tables[kind] = write_table(rows, f"{folder}/{kind}{suffix}", overwrite)
    return json.dumps({"tables": tables}, indent=2)


#: Limits of what is read strictly: bytes in all, records, bytes and nesting of one.
BYTES, RECORDS, LINE, DEPTH = 64 << 20, 1_000_000, 1 << 20, 32
FAULT = _struct(file=S, line=L, fault=S)


def _depth(line: Column) -> Column:
    """How deep a JSON text nests, told before it is parsed: of its brackets alone, those of its strings left out."""
    unquoted = F.regexp_replace(F.regexp_replace(line, r"\\.", ""), r'"[^"]*"?', "")
    brackets = F.regexp_replace(unquoted, r"[^\[\]{}]+", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), zero, step, lambda acc: acc["most"])


def read_strictly(spark: SparkSession, path: str, most_bytes: int = BYTES, most_records: int = RECORDS, most_line: int = LINE, most_depth: int = DEPTH, statuses: dict[str, str] | None = None) -> DataFrame:
    """Measurements that must all fit, in one pass over the files: each record's size and nesting is looked at before it is parsed.

    A fault names file and line: an empty record, one too long or too deep, not JSON,
    a value that its field doesn't take, no type, no run, a run that ``statuses`` (run
    to status) doesn't know, or another status than it says. The first one is raised,
    with how many there are of each kind; nothing is left out silently. Files are
    taken as they are when they are read: what is returned is what was checked.
    """
    sizes = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if sizes > most_bytes:
        raise InputError(f"{path}: {sizes} bytes, at most {most_bytes} are read")
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "text")).filter((F.col("line") > 0) | (F.col("text") != ""))
    sized = texts.withColumn("line", F.col("line") + 1).withColumn("fault", F.when(F.trim("text") == "", "an empty record").when(F.octet_length("text") > most_line, f"more than {most_line} bytes").when(_depth(F.col("text")) > most_depth, f"nests more than {most_depth} deep"))
    corrupt = "_corrupt"
    kind = T.StructType([*MEASUREMENT.fields, T.StructField(corrupt, S)])
    fit = F.when(F.col("fault").isNull(), F.col("text"))
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "allowNonNumericNumbers": "false"}
    read = sized.withColumn("r", F.from_json(fit, kind, strict))
    wrong = F.when(payload.parse(F.col("text")).isNull(), "not JSON").when(F.col(f"r.{corrupt}").isNotNull(), "a field has a value of another type").when(F.col("r.record_type").isNull(), "no record type").when(F.col("r.run_id").isNull(), "no run")
    if statuses is not None:
        known = F.create_map(*(F.lit(x) for pair in statuses.items() for x in pair)) if statuses else F.create_map().cast("map<string,string>")
        said = F.try_element_at(known, F.col("r.run_id"))
        wrong = wrong.when(said.isNull(), "a run that isn't expected").when(F.col("r.status").isNotNull() & (F.col("r.status") != said), "another status than expected")
    told = read.withColumn("fault", F.coalesce("fault", wrong))
    seen = Observation()
    at = F.when(F.col("fault").isNotNull(), F.struct("file", "line", "fault"))
    watched = told.observe(seen, F.count(F.lit(1)).alias("n"), F.count("fault").alias("bad"), F.min(at).alias("first"))
    frame = kept(watched.select("fault", "r"), "records")
    if seen.get["n"] > most_records:
        raise InputError(f"{path}: {seen.get['n']} records, at most {most_records} are read")
    if seen.get["bad"]:
        first, each = seen.get["first"], frame.filter(F.col("fault").isNotNull()).groupBy("fault").count().orderBy("fault").collect()
        raise InputError(f"{first['file']}, line {first['line']}: {first['fault']}; in all: " + ", ".join(f"{r['fault']} ({r['count']})" for r in each))
    return frame.select(*(F.col(f"r.{f.name}") for f in MEASUREMENT.fields))


#: The columns of a detection artifact, by what they hold.
ARTIFACT_COLUMNS = {"seed": "_seed_entities_json", "augmented": "_augmented_entities", "final": "_detected_entities", "seed_candidates": "_seed_validation_candidates", "candidates": "_validation_candidates"}
ARTIFACT_FOLDER, ARTIFACT_STEP = "parquet-files", "entity-detection"


def read_artifact_folder(spark: SparkSession, folder: str, columns: dict[str, str] | None = None) -> DataFrame:
    """workflow_name, batch_file, row_index, seed, augmented, final (spans), and numbers of candidates, of all files below ``folder``.

    Files of steps whose name begins with ARTIFACT_STEP are read, whatever types they
    give the columns: JSON texts, lists or objects of a list; a column that a file
    lacks is empty. Files with the same types are read together. The driver looks at
    each file's footer, some at once; rows are where their file and their place in it
    say. A span without value or label doesn't count.
    """
    names = {**ARTIFACT_COLUMNS, **(columns or {})}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    part = F.split("path", "/")
    paths = [r.path for r in listed.filter((F.element_at(part, -2) == ARTIFACT_FOLDER) & F.startswith(F.element_at(part, -3), F.lit(ARTIFACT_STEP))).orderBy("path").collect()]
    if not paths:
        raise InputError(f"{folder}: no detection artifacts")
    with ThreadPoolExecutor(8) as workers:
        schemas_of = list(workers.map(lambda p: spark.read.parquet(p).schema, paths))
    alike: dict[str, list[str]] = {}
    for path, schema in zip(paths, schemas_of, strict=True):
        alike.setdefault(T.StructType([f for f in schema.fields if f.name in names.values()]).json(), []).append(path)

    def typed(frame: DataFrame, column: str, kind: T.StructType) -> Column:
        (field,) = kind.fields
        found = next((f for f in frame.schema.fields if f.name == column), None)
        none = F.array().cast(field.dataType)
        if found is None:
            return none
        raw = F.col(f"`{column}`") if isinstance(found.dataType, T.StringType) else F.to_json(f"`{column}`") if isinstance(found.dataType, T.StructType | T.ArrayType | T.MapType) else F.lit(None).cast("string")
        return F.coalesce(payload.read(raw, kind)[field.name], none)

    def spans(frame: DataFrame, column: str, kind: T.StructType) -> Column:
        return F.filter(typed(frame, column, _struct(entities=T.ArrayType(kind))), lambda e: (e["value"] != "") & (e["label"] != ""))

    out = None
    for group in alike.values():
        frame = spark.read.parquet(*group)
        place = F.split(F.col("_metadata.file_path"), "/")
        counted = {f"{k}_count": F.size(typed(frame, names[v], _struct(candidates=T.ArrayType(T.StringType())))) for k, v in (("seed_validation_candidate", "seed_candidates"), ("merged_validation_candidate", "candidates"))}
        found = {"seed": spans(frame, names["seed"], ENTITY), "augmented": spans(frame, names["augmented"], AUGMENTED), "final": spans(frame, names["final"], ENTITY)}
        rows = frame.select(F.element_at(place, -3).alias("workflow_name"), F.array_join(F.slice(place, -3, 3), "/").alias("batch_file"), F.col("_metadata.row_index").cast("int").alias("row_index"), *(v.alias(k) for k, v in {**found, **counted}.items()))
        out = rows if out is None else out.unionByName(rows)
    return out
