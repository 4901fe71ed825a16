"""Statistics of what detection left behind, without texts or values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_key, value_key
from .metrics import label_counts


def signature(e: Column, row: Column) -> Column:
    """16 hex digits that stand for a span of a row: of its label and place, not of its value."""
    text = F.concat(F.lit('{"end": '), e["end_position"].cast("string"), F.lit(', "label": '), F.to_json(F.array(e["label"])).substr(F.lit(2), F.length(F.to_json(F.array(e["label"]))) - 2), F.lit(', "row": '), row.cast("string"), F.lit(', "start": '), e["start_position"].cast("string"), F.lit("}"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def counted(items: Column, field: str) -> Column:
    return label_counts(F.transform(items, lambda e: F.struct(e[field].alias("label"))))


def artifact_rows(df: DataFrame, row: str, seed: str, augmented: str, final: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """``row``, the columns ``beside`` and, for a row's seed, suggested and final spans, how many there are of what kind."""
    keys = lambda c: F.transform(c, lambda e: value_key(e["value"]))
    new = F.filter(augmented, lambda e: ~F.array_contains(keys(F.col(seed)), value_key(e["value"])))
    signs = F.sort_array(F.array_distinct(F.transform(final, lambda e: signature(e, F.col(row)))))
    detail = lambda e: F.struct(signature(e, F.col(row)).alias("signature"), e["label"].alias("label"), e["source"].alias("source"), e["start_position"].alias("start_position"), e["end_position"].alias("end_position"), F.length(e["value"]).alias("value_length"))
    return df.select(
        row,
        *beside,
        F.size(seed).alias("seed_entity_count"),
        F.size(augmented).alias("augmented_entity_count"),
        F.size(final).alias("final_entity_count"),
        (F.size(augmented) - F.size(new)).alias("augmented_duplicate_seed_value_count"),
        F.size(new).alias("augmented_new_value_count"),
        F.size(F.filter(new, lambda e: F.array_contains(keys(F.col(final)), value_key(e["value"])))).alias("augmented_new_final_value_count"),
        F.size(F.filter(final, lambda e: (e["label"] == "api_key") & ~looks_like_key(e["value"]))).alias("weak_api_key_shape_count"),
        F.size(signs).alias("final_entity_signature_count"),
        signs.alias("final_entity_signature_hashes"),
        F.transform(final, detail).alias("final_entity_signature_details"),
        label_counts(F.col(final)).alias("final_label_counts"),
        counted(F.col(final), "source").alias("final_source_counts"),
    )
