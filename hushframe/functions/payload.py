"""Answers of models as typed values: each field is taken for itself, and what can't be read is told from what is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for a truth value.
YES, NO = ("true", "1", "yes"), ("false", "0", "no")


def parse(raw: Column) -> Column:
    """A JSON text as a variant; null where it isn't JSON, or where something follows."""
    whole = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    return F.when(F.try_variant_get(whole, "$[1]", "variant").isNull(), F.try_variant_get(whole, "$[0]", "variant"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _inner(v: Column) -> Column:
    """What a text holds that is JSON itself, else the value."""
    return F.when(_is(v, "STRING"), F.coalesce(parse(F.try_variant_get(v, "$", "string")), v)).otherwise(v)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _truth(v: Column) -> Column:
    said = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    number = F.try_variant_get(v, "$", "double")
    other = F.when(~_is(v, "STRING") & number.isNotNull() & ~F.isnan(number), number != 0)
    return F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")).when(said.isin(*YES), True).when(said.isin(*NO), False).otherwise(other)


def _number(v: Column, kind: T.DataType) -> Column:
    got = F.try_variant_get(v, "$", "double")
    if isinstance(kind, T.DoubleType):
        return F.when(~F.isnan(got), got)
    # a text has to be a whole number; of others the fraction is left off
    text = F.trim(F.try_variant_get(v, "$", "string"))
    whole = F.when(_is(v, "STRING"), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))).otherwise(F.try_variant_get(v, "$", kind.simpleString()))
    return whole


def coerced(v: Column, kind: T.DataType) -> Column:
    """A variant as ``kind``; each field that doesn't fit is null, whatever the others are.

    Lists and objects that are texts of JSON are read too; a bare list stands for the
    only list of an object. Whole numbers may be texts, truth values words or numbers.
    """
    if isinstance(kind, T.StructType):
        lists = [f for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
        inner = _inner(v)
        read = F.struct(*(coerced(field(inner, f.name), f.dataType).alias(f.name) for f in kind.fields))
        out = F.when(_is(inner, "OBJECT"), read)
        if len(lists) == len(kind.fields) == 1:
            out = out.when(_is(inner, "ARRAY"), F.struct(coerced(inner, lists[0].dataType).alias(lists[0].name)))
        return out
    if isinstance(kind, T.ArrayType):
        return F.transform(F.try_variant_get(_inner(v), "$", "array<variant>"), lambda x: coerced(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.try_variant_get(_inner(v), "$", "map<string,variant>"), lambda _, x: coerced(x, kind.valueType))
    if isinstance(kind, T.BooleanType):
        return _truth(v)
    if isinstance(kind, T.StringType):
        return F.try_variant_get(v, "$", "string")
    return _number(v, kind)


def read(raw: Column, kind: T.DataType) -> Column:
    """A JSON text as ``kind``; null where it isn't JSON, or JSON of another shape."""
    return coerced(parse(raw), kind)


def state(raw: Column) -> Column:
    """How an answer came: empty, malformed (not JSON), other (JSON, but neither object nor list), read."""
    v = parse(raw)
    inner = _inner(v)
    return F.when(raw.isNull() | raw.rlike(r"\A\s*\z"), "empty").when(v.isNull(), "malformed").when(_is(inner, "OBJECT") | _is(inner, "ARRAY"), "read").otherwise("other")
