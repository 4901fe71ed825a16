"""Verdicts of judges over finished results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import payload


@dataclass(frozen=True)
class Judge:
    """A judge: its columns, the type of its answer, and which rows it has nothing to check in."""

    name: str
    items: T.StructType
    listed: bool  # the answer lists bad items only, else all with ``passes``

    @property
    def answer(self) -> T.StructType:
        return T.StructType([T.StructField("all_valid", T.BooleanType()), T.StructField("items", T.ArrayType(self.items))])

    @property
    def valid(self) -> str:
        return f"{self.name}_valid"

    @property
    def invalid(self) -> str:
        return f"{self.name}_invalid"

    def nothing_to_check(self) -> Column:
        if self.name == "detection":
            return F.size(judged_entities(F.col(schemas.BY_VALUES))) == 0
        return F.size(schemas.MAP) < (2 if self.name == "relational" else 1)


def _items(**fields: T.DataType) -> T.StructType:
    return schemas._struct(**fields)


JUDGES = {
    "detection": Judge("detection", _items(value=schemas.S, label=schemas.S, reason=schemas.S), True),
    "type_fidelity": Judge("type_fidelity", _items(original=schemas.S, label=schemas.S, synthetic=schemas.S, reason=schemas.S), True),
    "relational": Judge("relational", _items(relation=schemas.S, passes=schemas.B, reason=schemas.S), False),
    "attribute": Judge("attribute", _items(original=schemas.S, synthetic=schemas.S, attribute=schemas.S, passes=schemas.B, reason=schemas.S), False),
}


def judged_entities(by_value: Column) -> Column:
    """A row for each value and label."""
    return F.flatten(F.transform(by_value, lambda v: F.transform(v["labels"], lambda x: F.struct(v["value"].alias("value"), x.alias("label")))))


def settle(df: DataFrame, judge: Judge, raw: str) -> DataFrame:
    """Adds verdict and bad items: rows without anything to check are valid, bad answers have no verdict."""
    parsed = payload.read(F.col(raw), judge.answer)
    bad = parsed["items"] if judge.listed else F.filter(parsed["items"], lambda x: ~x["passes"])
    none = F.array().cast(T.ArrayType(judge.items))
    passed = judge.nothing_to_check()
    fine = parsed["all_valid"].isNotNull() & parsed["items"].isNotNull()
    return df.withColumns({judge.valid: F.when(passed, True).when(fine, parsed["all_valid"]), judge.invalid: F.when(~passed & fine, bad).otherwise(none)})


def valid_fraction(valid: Column, invalid_count: Column, total: Column) -> Column:
    """A verdict as a share; null where it can't be told."""
    share = F.greatest(F.lit(0.0), (total - invalid_count) / total.cast("double"))
    return F.when(valid.isNull(), None).when(valid, 1.0).when((total == 0) | (invalid_count == 0), None).otherwise(share)


def badge(valid: Column, correct: Column, total: Column) -> Column:
    """Words for a verdict with a count of correct items."""
    said_no = ~F.coalesce(valid, F.lit(True))
    return (
        F.when(valid.isNull(), "Unavailable")
        .when((total == 0) & ~said_no, "Satisfied")
        .when(said_no & (correct == total), "Not Satisfied")
        .when(correct >= total, "Satisfied")
        .when(correct == 0, "Not Satisfied")
        .otherwise("Partially Satisfied")
    )
