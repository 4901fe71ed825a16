"""Replacing entities in texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import spans
from ..functions.text import check_template, digest, filled, redaction_label

PAIRS = f"array<{schemas.REPLACEMENT.simpleString()}>"


@dataclass(frozen=True)
class Redact:
    format_template: str = "[REDACTED_{label}]"
    normalize_label: bool = True

    def __post_init__(self):
        check_template(self.format_template, set(), {"label"})

    def column(self, value: Column, label: Column) -> Column:
        return filled(self.format_template, label=redaction_label(label) if self.normalize_label else label)


@dataclass(frozen=True)
class Annotate:
    format_template: str = "<{text}, {label}>"

    def __post_init__(self):
        check_template(self.format_template, {"text", "label"}, {"text", "label"})

    def column(self, value: Column, label: Column) -> Column:
        return filled(self.format_template, text=value, label=label)


@dataclass(frozen=True)
class Hash:
    algorithm: str = "sha256"
    digest_length: int = 12
    format_template: str = "<HASH_{label}_{digest}>"

    def __post_init__(self):
        check_template(self.format_template, {"digest"}, {"label", "digest"})
        if self.algorithm not in ("sha256", "sha1", "md5") or not 6 <= self.digest_length <= 64:
            raise ValueError("algorithm is sha256, sha1 or md5; digest_length 6 to 64")

    def column(self, value: Column, label: Column) -> Column:
        return filled(self.format_template, label=F.upper(label), digest=F.substring(digest(value, self.algorithm), 1, self.digest_length))


@dataclass(frozen=True)
class Substitute:
    """Values come from a model, as a column of replacements."""

    instructions: str | None = None


METHODS = {"redact": Redact, "annotate": Annotate, "hash": Hash, "substitute": Substitute}


def method(kind: str, **options):
    """A replacement method by its name."""
    if kind.lower() not in METHODS:
        raise ValueError(f"no replacement method {kind!r}")
    return METHODS[kind.lower()](**options)


def no_pairs() -> Column:
    return F.array().cast(PAIRS)


def replacement_map(entities: Column, how) -> Column:
    """A replacement for each distinct value and label, in the order of first sight."""
    pairs = F.array_distinct(F.transform(F.filter(entities, lambda e: (e["value"] != "") & (e["label"] != "")), lambda e: F.struct(e["value"].alias("original"), e["label"].alias("label"))))
    return F.transform(pairs, lambda p: F.struct(p["original"].alias("original"), p["label"].alias("label"), how.column(p["original"], p["label"]).alias("synthetic")))


def parse_map(raw: Column) -> Column:
    """Replacements from JSON; entries without an original, a label or a synthetic value are left out."""
    items = F.try_variant_get(F.try_parse_json(raw), "$.replacements", "array<variant>")
    get = lambda v, p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    read = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.struct(get(v, "$.original").alias("original"), get(v, "$.label").alias("label"), get(v, "$.synthetic").alias("synthetic")))
    return F.filter(read, lambda r: (r["original"] != "") & (r["label"] != "") & (r["synthetic"] != ""))


def apply_map(text: Column, entities: Column, pairs: Column) -> Column:
    """The text with its spans replaced: by value and label, else by value, else left; the last entry counts."""

    def synthetic(e: Column) -> Column:
        exact = F.filter(pairs, lambda p: (p["original"] == e["value"]) & (p["label"] == e["label"]))
        loose = F.filter(pairs, lambda p: p["original"] == e["value"])
        last = lambda a: F.try_element_at(a, F.greatest(F.size(a), F.lit(1)))["synthetic"]
        return F.coalesce(last(exact), last(loose), spans.slice_of(text, e))

    ordered = spans._ranked(entities, lambda e: e["start_position"])
    return F.when((F.size(entities) > 0) & (F.size(pairs) > 0), spans._walk(text, ordered, synthetic, True)).otherwise(text)


def requested_pairs(pairs: Column, by_value: Column) -> Column:
    """A model's replacements, restricted to what was asked for, the first of each pair.

    A synthetic value that is itself an original becomes ``[SUBSTITUTE_<LABEL>_<n>]``,
    n counting such entries of the label; a number that is an original is passed over.
    """
    values = F.transform(by_value, lambda v: v["value"])
    asked = F.filter(pairs, lambda p: F.exists(by_value, lambda v: (v["value"] == p["original"]) & F.array_contains(v["labels"], p["label"])))
    first = F.filter(asked, lambda p, i: ~F.exists(F.slice(asked, 1, i), lambda x: (x["original"] == p["original"]) & (x["label"] == p["label"])))

    def repaired(p: Column, i: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.upper(p["label"]), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
        name = F.when(clean == "", F.lit("VALUE")).otherwise(clean)
        n = F.size(F.filter(F.slice(first, 1, i + 1), lambda x: (x["label"] == p["label"]) & F.array_contains(values, x["synthetic"])))
        tokens = F.transform(F.sequence(n, n + F.size(values)), lambda k: F.concat(F.lit("[SUBSTITUTE_"), name, F.lit("_"), k.cast("string"), F.lit("]")))
        free = F.try_element_at(F.filter(tokens, lambda t: ~F.array_contains(values, t)), F.lit(1))
        return F.struct(p["original"].alias("original"), p["label"].alias("label"), F.when(F.array_contains(values, p["synthetic"]), free).otherwise(p["synthetic"]).alias("synthetic"))

    return F.transform(first, repaired)


def replace(df: DataFrame, how, text: str = schemas.TEXT, pairs: str | None = None) -> DataFrame:
    """Adds the map and the replaced text; ``pairs``: a model's replacements (for Substitute)."""
    if isinstance(how, Substitute):
        if pairs is None:
            raise ValueError("Substitute needs a column of replacements")
        mapped = df.withColumn(schemas.MAP, requested_pairs(F.col(pairs), F.col(schemas.BY_VALUES)))
    else:
        mapped = df.withColumn(schemas.MAP, replacement_map(F.col(schemas.FINAL), how))
    return mapped.withColumn(schemas.OUTPUT, apply_map(F.col(text), F.col(schemas.FINAL), F.col(schemas.MAP)))


def placed(entities: Column, pairs: Column, replaced: Column) -> Column:
    """Spans of the synthetic values in the replaced text, found from left to right."""
    ordered = spans._ranked(entities, lambda e: e["start_position"], lambda e: e["end_position"])
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("source"), spans.no_spans().alias("out"))

    def step(acc: Column, e: Column) -> Column:
        hits = F.filter(pairs, lambda p: (p["original"] == e["value"]) & (p["label"] == e["label"]))
        value = F.coalesce(F.try_element_at(hits, F.greatest(F.size(hits), F.lit(1)))["synthetic"], e["value"])
        at = F.locate_at(replaced, value, acc["at"]) if hasattr(F, "locate_at") else F.call_function("locate", value, replaced, acc["at"] + 1) - 1
        found = F.array_append(acc["out"], spans.span(value, e["label"], at, at + F.length(value), F.lit(1.0), "replaced"))
        hit = F.struct((at + F.length(value)).alias("at"), e["end_position"].alias("source"), found.alias("out"))
        miss = F.struct(acc["at"].alias("at"), e["end_position"].alias("source"), acc["out"].alias("out"))
        return F.when(e["start_position"] < acc["source"], acc).when(at >= 0, hit).otherwise(miss)

    return F.aggregate(ordered, zero, step, lambda acc: acc["out"])
