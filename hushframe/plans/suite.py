"""Suites of cases: workloads by configurations by repetitions, and sweeps over parameters."""

from __future__ import annotations

import copy
import dataclasses
import hashlib
import itertools
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import InputError, read_table, slice_rows
from .config import Input, config_of
from .engine import Engine
from .recording import Recorder

log = logging.getLogger("hushframe")


@dataclass(frozen=True)
class Workload:
    id: str
    source: str
    text_column: str = "text"
    order: str | None = None
    offset: int = 0
    limit: int | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        frame = read_table(spark, self.source)
        if not self.offset and self.limit is None:
            return frame
        if self.order is None:
            raise InputError(f"workload {self.id}: a slice needs a column that orders its rows")
        return slice_rows(frame, self.order, self.offset, self.limit)


@dataclass(frozen=True)
class Case:
    id: str
    workload: str
    config: str
    repetition: int
    status: str = "planned"
    seconds: float | None = None
    error: str | None = None
    resumed: bool = False


@dataclass
class Suite:
    id: str
    workloads: list[Workload]
    configs: dict[str, dict]
    repetitions: int = 1
    matrix: list[tuple[str, str]] | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        ids = [w.id for w in self.workloads]
        if len(set(ids)) < len(ids) or not ids or not self.configs or self.repetitions < 1:
            raise InputError("a suite has workloads with ids of their own, configurations, and at least one repetition")
        for w, c in self.matrix or []:
            if w not in ids or c not in self.configs:
                raise InputError(f"the matrix names {w!r} with {c!r}, which the suite lacks")

    def cases(self) -> list[Case]:
        pairs = self.matrix or list(itertools.product([w.id for w in self.workloads], self.configs))
        return [Case(f"{w}__{c}__r{k:03}", w, c, k) for w, c in dict.fromkeys(pairs) for k in range(self.repetitions)]


def _spec(suite: Suite, case: Case) -> str:
    """What a case is made of: a finished one counts as long as this stays."""
    work = next(w for w in suite.workloads if w.id == case.workload)
    told = json.dumps([dataclasses.asdict(work), suite.configs[case.config], case.repetition, suite.tags], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def _finished(spark: SparkSession, folder: str, case: Case, spec: str) -> Case | None:
    """The case as it ended before, if its note is there, tells of the same specification, and seals the records beside it."""
    try:
        told = json.loads("".join(r.value for r in spark.read.text(f"{folder}/{case.id}/seal").collect()))
        good = told["spec"] == spec and told["seal"] == seal(spark.read.parquet(f"{folder}/{case.id}/records"))
    except Exception:
        return None
    return replace(case, status="completed", seconds=told["seconds"], resumed=True) if good else None


@contextmanager
def _bounded(spark: SparkSession, tag: str, limit: float | None) -> Iterator[Callable[[], bool]]:
    """Tags the jobs of this thread; when the time is up all of them are cancelled, and those that come after, too."""
    sc, done, late = spark.sparkContext, Event(), Event()
    sc.addJobTag(tag)

    def watch() -> None:
        if not done.wait(limit):
            late.set()
            while not done.wait(0.1):
                sc.cancelJobsWithTag(tag)

    watcher = Thread(target=watch, daemon=True)
    if limit is not None:
        watcher.start()
    try:
        yield late.is_set
    finally:
        done.set()
        if limit is not None:
            watcher.join()
        sc.removeJobTag(tag)


def _run_case(spark: SparkSession, suite: Suite, case: Case, folder: str, make: Callable[[SparkSession], Engine], spec: str) -> float:
    began = time.time()
    work = next(w for w in suite.workloads if w.id == case.workload)
    tags = {"suite_id": suite.id, "workload_id": case.workload, "config_id": case.config, "case_id": case.id, **suite.tags}
    engine = make(spark)
    engine.recorder = recorder = engine.recorder or Recorder(run_id=case.id, **tags, repetition=case.repetition)
    result = engine.run(config_of(suite.configs[case.config]), Input(work.load(spark), work.text_column))
    result.frame.write.mode("overwrite").parquet(f"{folder}/{case.id}/result")
    result.finish()
    tagged = result.metrics().withColumn("run_id", F.lit(case.id)).withColumn("run_tags", F.struct(*(F.lit(v).alias(k) for k, v in tags.items()), F.lit(case.repetition).cast("long").alias("repetition")))
    tagged.write.mode("overwrite").parquet(f"{folder}/{case.id}/records")
    recorder.frame(spark).select(F.col("record").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{case.id}/runs")
    result.forget()
    spent = time.time() - began
    note = json.dumps({"case": case.id, "spec": spec, "seconds": spent, "seal": seal(spark.read.parquet(f"{folder}/{case.id}/records"))})
    # written last: a case without it isn't finished
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{case.id}/seal")
    return spent


def run_suite(spark: SparkSession, suite: Suite, folder: str, make: Callable[[SparkSession], Engine] = Engine, retries: int = 0, wait: float = 1.0, fail_fast: bool = False, at_once: int = 1, limit: float | None = None) -> tuple[list[Case], DataFrame | None]:
    """Runs all cases; their results and records go to ``folder``. Returns the cases and the records of those that ended well.

    A case that ended well before, in the same folder and by the same specification,
    is taken as it is: after an interruption only what is left runs. ``at_once`` cases
    run beside each other, each configuration in a pool of its own (with Spark's FAIR
    scheduler these share the executors). A case that takes longer than ``limit``
    seconds has its jobs cancelled and isn't repeated. With ``fail_fast`` no case is
    begun after one that failed.
    """
    stop = Event()

    def one(case: Case) -> Case:
        spec = _spec(suite, case)
        if (before := _finished(spark, folder, case, spec)) is not None:
            log.info("case %s: finished before", case.id)
            return before
        for attempt in range(retries + 1):
            if stop.is_set():
                return replace(case, status="skipped")
            began = time.time()
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", case.config)
            with _bounded(spark, f"hf-{uuid.uuid4().hex}", limit) as late:
                try:
                    return replace(case, status="completed", seconds=_run_case(spark, suite, case, folder, make, spec))
                except Exception as e:
                    ended = replace(case, status="cancelled" if late() else "error", seconds=time.time() - began, error="TimeoutError" if late() else type(e).__name__)
                finally:
                    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            log.info("case %s: %s (%s)", case.id, ended.status, ended.error)
            if ended.status == "cancelled" or attempt == retries:
                if fail_fast:
                    stop.set()
                return ended
            time.sleep(wait)
        return case

    if at_once > 1:
        with ThreadPoolExecutor(at_once) as workers:
            done = list(workers.map(one, suite.cases()))
    else:
        done = [one(c) for c in suite.cases()]
    done = [c for c in done if c.status != "skipped"]
    return done, combined_records(spark, folder, done)


def run_sweep(spark: SparkSession, suite: Suite, parameters: dict[str, list], folder: str, **options) -> tuple[DataFrame, DataFrame | None]:
    """Runs a suite for each combination of parameters, in folders of their own: a table of cases beside the arm they are of, and all records."""
    rows, told = [], []
    for arm, made in sweep(suite, parameters):
        cases, records = run_suite(spark, made, f"{folder}/{made.id}", **options)
        rows += [(made.id, json.dumps(arm, sort_keys=True, default=str), c.id, c.workload, c.config, c.repetition, c.status, c.seconds, c.error, c.resumed) for c in cases]
        told += [records] if records is not None else []
    table = spark.createDataFrame(rows, "suite_id string, arm string, case_id string, workload string, config string, repetition int, status string, seconds double, error string, resumed boolean")
    return table, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told) if told else None


def combined_records(spark: SparkSession, folder: str, cases: list[Case]) -> DataFrame | None:
    """The records of the cases that ended well, read back from a suite's folder; none if there are none."""
    paths = [f"{folder}/{c.id}/records" for c in cases if c.status == "completed"]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def patched(spec: dict, path: str, value: object) -> dict:
    """A copy with the value at a dotted path changed (and made, where it isn't there)."""
    out = copy.deepcopy(spec)
    *above, last = path.split(".")
    here = out
    for name in above:
        here = here.setdefault(name, {})
        if not isinstance(here, dict):
            raise InputError(f"{path}: {name} isn't a mapping")
    here[last] = value
    return out


def sweep(suite: Suite, parameters: dict[str, list]) -> Iterator[tuple[dict, Suite]]:
    """A suite for each combination of parameters, all configurations patched alike."""
    if not parameters or any(not v for v in parameters.values()):
        raise InputError("a sweep has parameters, each with values")
    for values in itertools.product(*parameters.values()):
        arm = dict(zip(parameters, values, strict=True))
        configs = {k: reduce(lambda s, p: patched(s, *p), arm.items(), v) for k, v in suite.configs.items()}
        name = hashlib.sha256(json.dumps(arm, sort_keys=True, default=str).encode()).hexdigest()[:8]
        yield arm, replace(suite, id=f"{suite.id}-{name}", configs=configs)


def seal(records: DataFrame) -> str:
    """A digest of a finished case's records, whatever their order; only a count and two sums reach the driver.

    Rows are hashed as JSON with maps as sorted entries; hashes are added, so that a
    row that is there twice counts twice.
    """
    maps = {f.name for f in records.schema.fields if isinstance(f.dataType, T.MapType)}
    plain = [(F.sort_array(F.map_entries(f"`{c}`")) if c in maps else F.col(f"`{c}`")).alias(c) for c in sorted(records.columns)]
    row = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    sums = (F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")) for k in (0, 1))
    return hashlib.sha256(":".join(map(str, records.agg(F.count(F.lit(1)), *sums).first())).encode()).hexdigest()
