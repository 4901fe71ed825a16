"""Registered queries of what is read from outside: answers that half fit, folders of artifacts, strict records, folded case; with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import folding, payload, sql, text
from .operators import artifacts
from .queries import ORACLE_SQL, _measurements, _table, query
from .schemas import T
from .sources import records, tables


def _path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_ITEMS = schemas._struct(items=T.ArrayType(schemas._struct(id=T.IntegerType(), score=T.DoubleType(), passes=T.BooleanType(), why=T.StringType())))


@query(
    """select doc_id, list_value('read', 'read', 'read', 'malformed', 'empty', 'read', 'read', 'other')[doc_id % 8 + 1] as state, case when doc_id % 8 in (0, 1, 2, 5) then cast(doc_id as integer) end as id,
  case doc_id % 8 when 0 then 0.5::double when 2 then 1.0::double end as score, case doc_id % 8 when 0 then false when 1 then true end as passes, case when doc_id % 8 = 0 then substr(text, 1, 9) when doc_id % 8 = 1 then '3' end as why from documents"""
)
def tolerant_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good, half-good, broken and empty answers: fields are read one by one."""
    d, key = _table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    quoted = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("id"), F.lit(0.5).alias("score"), F.lit(False).alias("passes"), F.substring("text", 1, 9).alias("why"))).alias("items")))
    kinds = [
        quoted,
        F.concat(F.lit('{"items": [{"id": " '), key, F.lit(' ", "score": "high", "passes": " Yes", "why": 3}]}')),
        F.concat(F.lit('[{"id": '), key, F.lit(', "score": 1, "passes": [], "other": {}}]')),
        F.concat(F.lit("{"), F.substring("text", 1, 40)),
        F.when(F.col("doc_id") % 16 == 4, F.lit(" ")),
        F.concat(F.lit('{"items": "[{\\"id\\": '), key, F.lit('}]"}')),
        F.lit("{}"),
        key,
    ]
    raw = F.coalesce(*(F.when(F.col("doc_id") % 8 == i, k) for i, k in enumerate(kinds)))
    got = d.select("doc_id", payload.state(raw).alias("state"), payload.read(raw, _ITEMS)["items"].alias("items"))
    return got.select("doc_id", "state", F.get("items", 0).alias("x")).select("doc_id", "state", "x.id", "x.score", "x.passes", "x.why")


@query("select doc_id, lower(substr(text, 1, 400)) as folded, lower(regexp_replace(trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')), 'ss', 'ss')) as key from documents where not regexp_matches(text, '[^\\x00-\\x7F]')")
def case_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which each ss was made a sharp s, and each fi a ligature: folded they are the lower-cased originals."""
    d = _table(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    odd = lambda c: F.replace(F.replace(c, F.lit("ss"), F.lit("ß")), F.lit("fi"), F.lit("ﬁ"))
    return d.select("doc_id", folding.fold(odd(F.substring("text", 1, 400))).alias("folded"), text.value_key(odd(F.substring("text", 1, 60))).alias("key"))


@query(
    """select case when c_custkey % 2 = 0 then 'entity-detection' else 'entity-detection-2' end as workflow_name, count(*) as rows, count(*) as places, cast(sum(1 + c_custkey % 3) as bigint) as candidates, count(*) as seed, cast(sum(case when c_custkey % 2 = 0 then 2 else 0 end) as bigint) as augmented,
  cast(sum(case when c_custkey % 2 = 0 then 2 else 1 end) as bigint) as final, cast(sum(case when c_custkey % 2 = 0 then 1 else 0 end) as bigint) as known, cast(sum(case when c_custkey % 2 = 0 then 1 else 0 end) as bigint) as new_final from customer group by 1"""
)
def artifact_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of two steps whose files give the columns different types; files of other steps are left out."""
    c = _table(spark, sf_dir, "customer")
    one = lambda value, label: F.struct(F.col(value).alias("value"), F.lit(label).alias("label"), F.lit(0).alias("start_position"), F.length(value).alias("end_position"))
    listed = lambda *items: F.struct(F.array(*items).alias("entities"))
    columns, folder = records.ARTIFACT_COLUMNS, _path(spark, "artifact-folders")
    many = F.struct(F.transform(F.sequence(F.lit(0), F.col("c_custkey") % 3), lambda i: F.struct(i.alias("id"))).alias("candidates"))
    texts = c.filter("c_custkey % 2 = 0").select(F.to_json(listed(one("c_name", "name"))).alias(columns["seed"]), F.to_json(listed(one("c_name", "name"), one("c_mktsegment", "group"))).alias(columns["augmented"]), F.to_json(listed(one("c_name", "name"), one("c_mktsegment", "group"))).alias(columns["final"]), F.to_json(many).alias(columns["seed_candidates"]))
    typed = c.filter("c_custkey % 2 = 1").select(listed(one("c_name", "name")).alias(columns["seed"]), F.array(one("c_name", "name"), F.struct(F.lit("").alias("value"), F.lit("x").alias("label"), F.lit(0).alias("start_position"), F.lit(0).alias("end_position"))).alias(columns["final"]), many.alias(columns["seed_candidates"]))
    for frame, step in ((texts, "entity-detection"), (typed, "entity-detection-2"), (typed, "replace-map")):
        frame.repartition(2).write.parquet(f"{folder}/{step}/{records.ARTIFACT_FOLDER}")
    read = records.read_artifact_folder(spark, folder)
    spans = artifacts.artifact_rows(read.withColumn("place", F.struct("workflow_name", "batch_file", "row_index")), "row_index", "seed", "augmented", "final", ("place", "workflow_name", "seed_validation_candidate_count"))
    sums = {"candidates": "seed_validation_candidate_count", "seed": "seed_entity_count", "augmented": "augmented_entity_count", "final": "final_entity_count", "known": "augmented_duplicate_seed_value_count", "new_final": "augmented_new_final_value_count"}
    return spans.groupBy("workflow_name").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("place").alias("places"), *(F.sum(v).cast("long").alias(k) for k, v in sums.items()))


@query(
    """with e as (select event_id % 5 as f from events) select 'an empty record' as fault, count_if(f = 1) as n from e union all select 'no run', count_if(f = 2) from e union all select 'not JSON', count_if(f = 3) from e
  union all select 'a field has a value of another type', count_if(f = 4) from e union all select 'read', count(*) from e"""
)
def strict_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict reader says of measurements with faults of several kinds, and how many it reads of those without."""
    kind, run = F.col("event_id") % 5, F.concat(F.lit("r"), F.col("user_id").cast("string"))
    good = F.to_json(F.struct(F.lit("record").alias("record_type"), run.alias("run_id"), F.col("event_id").alias("final_entity_count")))
    wrong = F.when(kind == 1, " ").when(kind == 2, '{"record_type": "record"}').when(kind == 3, F.concat(good, F.lit("}x"))).when(kind == 4, F.regexp_replace(good, r':[0-9]+\}', ':"no"}'))
    lines = _table(spark, sf_dir, "events").select(F.coalesce(wrong, good).alias("value"), good.alias("good"))
    bad, fine = _path(spark, "faults"), _path(spark, "strict")
    # files of one record at least: an empty line in a file is a record of its own
    lines.select("value").write.text(bad)
    lines.select("good").write.text(fine)
    try:
        records.read_strictly(spark, bad, most_bytes=1 << 40, most_records=1 << 40)
        told = []
    except tables.InputError as e:
        told = [(k, int(n)) for k, n in re.findall(r"([^,(]+) \((\d+)\)", str(e).rpartition("in all: ")[2].replace(", ", ","))]
    read = records.read_strictly(spark, fine, most_bytes=1 << 40, most_records=1 << 40)
    return spark.createDataFrame(told, "fault string, n long").unionByName(read.agg(F.lit("read").alias("fault"), F.count("final_entity_count").alias("n")))


@query("select record_type, count(*) as n, count(distinct run_id) as runs from (select list_value('record', 'stage', 'ndd_workflow', 'evaluation_record')[event_id % 4 + 1] as record_type, 'run' || user_id as run_id from events) group by 1")
def strict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements read strictly from JSON lines."""
    path = tables.write_table(_measurements(spark, sf_dir), f"{_path(spark, 'strict-records')}.jsonl")
    return records.read_strictly(spark, path, most_bytes=1 << 40, most_records=1 << 40).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))


@query(ORACLE_SQL["detect_all"])
def spans_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule detector as a table function, joined laterally in SQL: what the column functions find."""
    name, view = sql.register(spark), f"docs_{uuid.uuid4().hex}"
    _table(spark, sf_dir, "documents").createTempView(view)
    return spark.sql(f"select d.doc_id, s.label, s.value, s.start_position as s, s.end_position as e from {view} d, lateral {name}(d.text) s")
