"""Reading and writing tables, and keeping the user's columns apart from a result's."""

from __future__ import annotations

import urllib.request
import uuid
from dataclasses import dataclass, replace
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

#: Formats told by the suffix of a path.
FORMATS = (".csv", ".parquet")
APART = "__input"


class InputError(ValueError):
    """The input or a path isn't what is asked for."""


class TableError(OSError):
    """A table couldn't be read or written."""


def is_remote(path: str) -> bool:
    return urlparse(path).scheme in ("http", "https")


def suffix_of(path: str) -> str:
    """Suffix in lower case; a URL's query and fragment don't count."""
    return PurePosixPath(urlparse(path).path if is_remote(path) else path).suffix.lower()


@dataclass(frozen=True)
class Resolved:
    """A table whose names don't collide with a result's, and what became of its text column."""

    frame: DataFrame
    requested: str
    resolved: str

    def with_frame(self, frame: DataFrame) -> Resolved:
        return replace(self, frame=frame)


def shared_folder(spark: SparkSession, given: str | None = None) -> str:
    """Where rows are kept between steps: given, or ``spark.checkpoint.dir``; a folder of our own in a local session only."""
    found = given or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise InputError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "/tmp/checkpoints/hushframe"
    return found.rstrip("/")


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: made once, its lineage cut."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fetched(spark: SparkSession, url: str) -> str:
    """What an http(s) address has, copied by the driver to the shared folder, where all executors can read it."""
    path = f"{shared_folder(spark)}/fetched-{uuid.uuid4().hex}/{PurePosixPath(urlparse(url).path).name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        with urllib.request.urlopen(url, timeout=120) as got:
            out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
            try:
                while piece := got.read(1 << 20):
                    out.write(bytearray(piece))
            finally:
                out.close()
    except OSError as e:
        raise TableError(f"can't read {url}") from e
    return path


def read_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV or Parquet table, or its first ``rows`` (none for 0 or less)."""
    suffix = suffix_of(path)
    if suffix not in FORMATS:
        raise InputError(f"{suffix or path!r} isn't a format that is read; use {' or '.join(FORMATS)}")
    if "://" in path and is_remote(path):
        path = fetched(spark, path)
    try:
        if suffix == ".csv":
            frame = spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"').csv(path)
        else:
            frame = spark.read.parquet(path)
    except Exception as e:
        raise TableError(f"can't read {path}") from e
    return frame if rows is None else frame.limit(max(0, rows))


def _free(name: str, taken: set[str]) -> str:
    k, found = 2, name
    while found in taken:
        found, k = f"{name}_{k}", k + 1
    return found


def keep_apart(frame: DataFrame, text: str) -> Resolved:
    """Renames the user's columns that are named like a result's, until none is.

    The text column may itself be renamed; the names derived from it are then looked
    at again.
    """
    names, now = {c: c for c in frame.columns}, text
    while True:
        taken = set(names.values())
        wanted = {now + s for s in schemas.SUFFIXES} | set(schemas.RESULT_COLUMNS)
        clash = sorted(taken & wanted)
        if not clash:
            break
        for name in clash:
            original = next(k for k, v in names.items() if v == name)
            names[original] = _free(name + APART, taken)
            taken.add(names[original])
            if name == now:
                now = names[original]
    return Resolved(frame.toDF(*(names[c] for c in frame.columns)), text, now)


def resolve(frame: DataFrame, text: str = "text") -> Resolved:
    """A table ready for the stages: no collisions, the text column under the stages' name."""
    if text not in frame.columns:
        raise InputError(f"no column {text!r}")
    if schemas.TEXT in frame.columns and text != schemas.TEXT:
        raise InputError(f"column {schemas.TEXT!r} is reserved")
    apart = keep_apart(frame, text)
    return apart.with_frame(apart.frame.withColumnRenamed(apart.resolved, schemas.TEXT))


def flat(frame: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats that have none."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return frame.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in frame.schema.fields))


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def _has_floats(kind: T.DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, T.DoubleType | T.FloatType) or any(map(_has_floats, parts))


def json_safe(frame: DataFrame) -> DataFrame:
    """Numbers that JSON lacks (not a number, infinities) as null, wherever they are nested."""
    return frame.withColumns({f.name: _finite(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields if _has_floats(f.dataType)})


def write_table(frame: DataFrame, path: str, overwrite: bool = False) -> str:
    """Writes CSV, Parquet or JSON lines, by the suffix of the path; every task writes its own part."""
    suffix = suffix_of(path)
    writer = (flat(frame) if suffix == ".csv" else frame).write.mode("overwrite" if overwrite else "error")
    if suffix == ".csv":
        writer.options(header=True, escape='"').csv(path)
    elif suffix == ".parquet":
        writer.parquet(path)
    elif suffix in (".jsonl", ".json"):
        json_safe(frame).write.mode("overwrite" if overwrite else "error").json(path)
    else:
        raise InputError(f"{suffix or path!r} isn't a format that is written")
    return path


def write_tables(named: dict[str, DataFrame], folder: str, suffix: str = ".parquet", overwrite: bool = False) -> dict[str, str]:
    """Several tables under a folder; name -> path."""
    return {name: write_table(frame, f"{folder.rstrip('/')}/{name}{suffix}", overwrite) for name, frame in named.items()}


def slice_rows(frame: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from ``offset`` on, in a stated order."""
    out = frame.orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


def present(frame: DataFrame) -> DataFrame:
    """Without columns that have only nulls, nested ones as JSON; one pass counts all columns."""
    counts = frame.agg(*(F.count(f"`{c}`").alias(c) for c in frame.columns)).first()
    return flat(frame.select(*(f"`{c}`" for c in frame.columns if counts[c])))
