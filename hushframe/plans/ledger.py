"""Narrow tables of one run, bucketed by row number, so that they come together without an exchange."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from .. import schemas


class Ledger:
    """Writes tables that are keyed by ``schemas.ORDER`` and reads them back.

    All have the same buckets. The rows of the input are dealt out once, when they are
    written; what is computed from them stays in its bucket, so each later table is
    written where its rows are, and joins read bucket by bucket. Files lie in the
    shared folder; ``forget`` drops them.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.tables: list[str] = []

    def put(self, frame: DataFrame, name: str, observed: Mapping[str, Column] | None = None, deal: bool = False) -> tuple[DataFrame, dict]:
        """``frame`` written and read back, and what was observed of its rows on the way."""
        table = f"hf_{name.replace('-', '_')}_{uuid.uuid4().hex}"
        seen = Observation(table)
        if observed:
            frame = frame.observe(seen, *(c.alias(k) for k, c in observed.items()))
        if deal:
            frame = frame.repartition(self.buckets, schemas.ORDER)
        frame.write.format("parquet").bucketBy(self.buckets, schemas.ORDER).option("path", f"{self.folder}/{table}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table), dict(seen.get) if observed else {}

    def beside(self, frame: DataFrame, narrow: DataFrame, how: str = "left") -> DataFrame:
        """``frame`` with a narrow table's columns; the text side is neither exchanged nor sorted."""
        return frame.join(narrow.hint("shuffle_hash"), schemas.ORDER, how)

    def forget(self) -> None:
        """Drops the tables and their files; frames made of them can't be used after that."""
        jvm = self.spark._jvm
        for table in self.tables:
            self.spark.sql(f"drop table if exists {table}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = []
