"""Putting results of steps back beside their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_new(target: DataFrame, source: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Columns of ``source`` beside the rows of ``target`` that it still has."""
    new = [c for c in source.columns if c != key and (overwrite or c not in target.columns)]
    kept = [c for c in target.columns if c not in new]
    return target.select(*kept).join(source.select(key, *new), key, "inner")


def join_keeping(target: DataFrame, source: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Columns of ``source`` beside all rows of ``target``; a default where there is no row."""
    new = [c for c in source.columns if c != key and c not in target.columns]
    joined = target.join(source.select(key, *new, F.lit(True).alias("_hf_there")), key, "left")
    return joined.withColumns({c: F.when(F.col("_hf_there"), F.col(c)).otherwise(defaults[c]) for c in new if c in defaults}).drop("_hf_there")


def grid(df: DataFrame, other: DataFrame) -> DataFrame:
    """All combinations of two tables of settings (workloads and configurations, parameters of a sweep)."""
    return df.crossJoin(other)
