"""Finding entities: a rule detector with the contract of a model, and the stages after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import spans
from ..functions.text import bound, tag_notation

#: Rules of the offline detector: label -> expression that Java's and RE2's dialects read alike.
RULES = {
    "email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "credit_debit_card": r"[0-9]{16}",
    "api_key": r"[0-9a-f]{40}",
    "url": r"https?://[A-Za-z0-9./?=&_#-]+",
    "phone_number": r"\+[0-9]{1,3}(?: [0-9]{2,4}){2,4}",
}
#: What a text has to contain for a rule to be tried at all.
SIGNS = {"email": "@", "url": "http", "phone_number": "+"}


def rule_spans(text: Column, label: str, pattern: str, score: float = 1.0) -> Column:
    """Spans of a rule's matches; their places come from the lengths of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), spans.no_spans().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["piece"])
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], spans.span(p["value"], F.lit(label), start, end, F.lit(score), "detector")).alias("out"))

    pairs = bound(F.split(text, pattern, -1), lambda pieces: F.transform(found, lambda v, i: F.struct(F.get(pieces, i).alias("piece"), v.alias("value"))))
    # one look through the texts that have no match, which are most
    sign = F.contains(text, F.lit(SIGNS[label])) if label in SIGNS else text.rlike(pattern)
    return F.when(sign, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(spans.no_spans())


def rules_found(text: Column, labels: list[str] | None = None) -> Column:
    """Spans of all rules, before overlaps are resolved."""
    use = [k for k in RULES if labels is None or k in labels]
    return F.concat(*(rule_spans(text, k, RULES[k]) for k in use)) if use else spans.no_spans()


def rule_answer(text: Column, labels: list[str] | None = None) -> Column:
    return answer_of(rules_found(text, labels))


def answer_of(found: Column) -> Column:
    """What a detector answers: JSON with a list of text, label, start, end and score."""
    items = F.transform(found, lambda e: F.struct(e["value"].alias("text"), e["label"].alias("label"), e["start_position"].alias("start"), e["end_position"].alias("end"), e["score"].alias("score")))
    return F.to_json(F.struct(items.alias("entities")))


def detect(df: DataFrame, text: str = schemas.TEXT, labels: list[str] | None = None, raw: str | None = None) -> DataFrame:
    """Adds raw answer, entities and tag notation. ``raw``: a column that has a model's answers instead.

    A null text has no entities. What the rules find is taken as it is, without the way
    through JSON; the raw answer is there for those who want to see it.
    """
    if raw:
        named = df.withColumn(schemas.RAW, F.col(raw)).withColumn("_hf_notation", tag_notation(text))
        return named.withColumn(schemas.ENTITIES, F.coalesce(spans.parse_raw(F.col(schemas.RAW), F.col(text)), spans.no_spans()))
    # the rules run once, also where both the answer and the spans are used
    found = df.withColumn("_hf_found", rules_found(F.col(text), labels))
    named = found.withColumn(schemas.RAW, answer_of(F.col("_hf_found"))).withColumn("_hf_notation", tag_notation(text))
    return named.withColumn(schemas.ENTITIES, F.coalesce(spans.resolve_overlaps(F.col("_hf_found")), spans.no_spans())).drop("_hf_found")


def validate(df: DataFrame, decisions: str, text: str = schemas.TEXT) -> DataFrame:
    return df.withColumn(schemas.ENTITIES, spans.apply_decisions(F.col(schemas.ENTITIES), F.col(decisions)))


def augment(df: DataFrame, suggestions: str, text: str = schemas.TEXT) -> DataFrame:
    """Adds suggested values, splits full names, resolves: a column each, so that lambdas don't nest."""
    added = df.withColumn("_hf_added", spans.add_suggestions(F.col(text), F.col(schemas.ENTITIES), F.col(suggestions)))
    named = added.withColumn("_hf_named", spans.split_full_names(F.col(text), F.col("_hf_added")))
    return named.withColumn(schemas.ENTITIES, spans.resolve_overlaps(F.col("_hf_named"))).drop("_hf_added", "_hf_named")


def finalize(df: DataFrame, text: str = schemas.TEXT, labels: list[str] | None = None) -> DataFrame:
    """Expands to all occurrences; final entities have allowed labels only, the tagged text has all."""
    wide = df.withColumn(schemas.ENTITIES, spans.expand_occurrences(F.col(text), F.col(schemas.ENTITIES)))
    out = wide.withColumn(schemas.TAGGED, spans.tagged_text(F.col(text), F.col(schemas.ENTITIES)))
    final = out.withColumn(schemas.FINAL, spans.allowed_labels(F.col(schemas.ENTITIES), labels))
    return final.withColumn(schemas.BY_VALUES, spans.group_by_value(F.col(schemas.FINAL)))
