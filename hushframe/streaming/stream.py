"""The row-local stages on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import detect, replace
from ..sources.tables import shared_folder


def redacted(df: DataFrame, how=None, labels: list[str] | None = None) -> DataFrame:
    """Detection and replacement of a batch or a stream: no state, no exchange."""
    return replace.replace(detect.finalize(detect.detect(df, labels=labels), labels=labels), how or replace.Redact())


def label_rates(df: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts of labels by window of time; what comes later than ``late`` is left out of closed windows."""
    each = df.withWatermark(time, late).select(time, F.explode(schemas.FINAL).alias("e"))
    return each.groupBy(F.window(time, every), F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def redact_stream(spark: SparkSession, path: str, key: str, folder: str | None = None) -> DataFrame:
    """Reads a Parquet table as a stream, writes it redacted, and returns what was written."""
    out = f"{shared_folder(spark, folder)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # a stream reads a folder: of a single file, the folder it is in
    whole = spark.read.parquet(path).inputFiles()
    single = len(whole) == 1 and whole[0].rstrip("/").endswith(path.rsplit("/", 1)[-1])
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", path.rsplit("/", 1)[-1]).parquet(path.rsplit("/", 1)[0]) if single else reader.parquet(path)
    slim = redacted(source.select(key, F.col("text").alias(schemas.TEXT)))
    writer = slim.select(key, F.col(schemas.OUTPUT).alias("replaced")).writeStream.format("parquet").option("checkpointLocation", f"{out}/_state").trigger(availableNow=True)
    writer.start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")
