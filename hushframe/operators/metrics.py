"""Measurements of a record: counts and scores, never texts or values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import contains_value, f1, ratio, size_bucket, strip, word_count

#: Labels that stand for one another.
SAME_LABELS = (
    ("access_token", "api_key", "auth_token", "bearer_token", "password", "secret_key", "session_id", "unique_id", "user_id"),
    ("full_name", "person_name", "user", "user_name", "username"),
    ("phone", "phone_number", "telephone"),
    ("email", "email_address"),
    ("cookie", "http_cookie", "session_cookie"),
)
#: Names of a column of expected entities, the first present counts.
EXPECTED_COLUMNS = ("ground_truth_entities", "gt_entities", "expected_entities")


#: A rewrite's scores, as records have them.
REWRITE_SCORES = {"utility_score": "double", "leakage_mass": "double", "weighted_leakage_rate": "double", "any_high_leaked": "boolean", "needs_human_review": "boolean", "needs_repair": "boolean"}


def label_key(label: Column) -> Column:
    name = F.lower(strip(label))
    return F.when(name != "", F.coalesce(*(F.when(name.isin(*c), F.lit(c[0])) for c in SAME_LABELS), name))


def label_counts(items: Column) -> Column:
    """Map of label to count, in the order of labels; empty labels don't count."""
    labels = F.filter(F.transform(items, lambda e: e["label"]), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<struct<label:string,n:bigint>>")
    zero = F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n"), none.alias("out"))
    ended = lambda acc: F.when(acc["n"] > 0, F.array_append(acc["out"], F.struct(acc["label"].alias("label"), acc["n"].alias("n")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        same = acc["label"] == x
        return F.struct(x.alias("label"), F.when(same, acc["n"] + 1).otherwise(1).cast("long").alias("n"), F.when(same, acc["out"]).otherwise(ended(acc)).alias("out"))

    return F.map_from_entries(F.aggregate(F.sort_array(labels), zero, step, ended))


def strict_counts(found: Column, expected: Column) -> Column:
    """tp, fp, fn over multisets of value and label: both lists in one order, and one walk over it."""
    named = lambda a, side: F.transform(F.filter(a, lambda e: e["value"].isNotNull() & e["label"].isNotNull()), lambda e: F.struct(e["value"].alias("value"), e["label"].alias("label"), F.lit(side).alias("g")))
    both = F.sort_array(F.concat(named(found, 0), named(expected, 1)))
    nothing, none = F.lit(None).cast("string"), F.lit(0)
    zero = F.struct(nothing.alias("value"), nothing.alias("label"), *(none.alias(k) for k in ("p", "g", "ps", "gs", "tp")))
    matched = lambda acc: acc["tp"] + F.least(acc["p"], acc["g"])

    def step(acc: Column, x: Column) -> Column:
        same = acc["value"].eqNullSafe(x["value"]) & acc["label"].eqNullSafe(x["label"])
        own = {"p": 1 - x["g"], "g": x["g"]}
        runs = [(F.when(same, acc[k]).otherwise(0) + v).alias(k) for k, v in own.items()]
        return F.struct(x["value"].alias("value"), x["label"].alias("label"), *runs, *((acc[f"{k}s"] + v).alias(f"{k}s") for k, v in own.items()), F.when(same, acc["tp"]).otherwise(matched(acc)).alias("tp"))

    return F.aggregate(both, zero, step, lambda acc: F.struct(matched(acc).alias("tp"), (acc["ps"] - matched(acc)).alias("fp"), (acc["gs"] - matched(acc)).alias("fn")))


@F.pandas_udf(schemas._struct(relaxed=schemas.L, compatible=schemas.L))
def _matched(found: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Sizes of the largest matching of found with expected spans of each row, also with like labels only, by augmenting paths."""

    def span(e: dict) -> tuple[int, int] | None:
        a, b = e["start_position"], e["end_position"]
        return (int(a), int(b)) if a is not None and b is not None and not pd.isna(a) and not pd.isna(b) and a >= 0 and b > a else None

    def fits(f: dict, g: dict, strictly: bool) -> bool:
        if strictly and (f["key"] is None or f["key"] != g["key"]):
            return False
        a, b = span(f), span(g)
        if a and b:
            return a[0] < b[1] and b[0] < a[1]
        return f["value"] is not None and f["value"] == g["value"]

    def one(fs, gs, strictly: bool) -> int | None:
        if fs is None or gs is None:
            return None
        options = [[i for i, f in enumerate(fs) if fits(f, g, strictly)] for g in gs]
        owner: dict[int, int] = {}
        for first in range(len(gs)):
            # breadth first from an unmatched expected span to a free found one
            came, queue, end = {}, [first], None
            while queue and end is None:
                g = queue.pop(0)
                for i in options[g]:
                    if i not in came:
                        came[i] = g
                        if i not in owner:
                            end = i
                            break
                        queue.append(owner[i])
            while end is not None:
                g = came[end]
                previous = next((i for i, o in owner.items() if o == g), None)
                owner[end] = g
                end = previous
        return len(owner)

    return pd.DataFrame({name: pd.array([one(f, g, strictly) for f, g in zip(found, expected, strict=True)], "Int64") for name, strictly in (("relaxed", False), ("compatible", True))})


def _matches(found: Column, expected: Column) -> Column:
    """Both counts, by one call; the only step of the metrics that leaves the JVM."""
    keyed = lambda a: F.transform(a, lambda e: F.struct(e["value"].alias("value"), e["start_position"].alias("start_position"), e["end_position"].alias("end_position"), label_key(e["label"]).alias("key")))
    return _matched(keyed(found), keyed(expected))


def relaxed_count(found: Column, expected: Column, compatible: bool = False) -> Column:
    """How many expected spans can each have a found span of their own that overlaps (else equals) them."""
    return _matches(found, expected)["compatible" if compatible else "relaxed"]


def expected_entities(df: DataFrame) -> Column | None:
    """Expected entities of the first column of EXPECTED_COLUMNS that is there: an array, a struct with one, or JSON of either."""
    name = next((c for c in EXPECTED_COLUMNS if c in df.columns), None)
    if name is None:
        return None
    kind, c = df.schema[name].dataType, F.col(name)
    slim = "array<struct<value:string,label:string,start_position:int,end_position:int>>"
    if isinstance(kind, T.StringType):
        return F.coalesce(F.from_json(c, f"struct<entities:{slim}>")["entities"], F.from_json(c, slim))
    if isinstance(kind, T.StructType):
        kind, c = kind["entities"].dataType, c["entities"]
    there = set(kind.elementType.names)
    of = lambda e, k, t: (e[k] if k in there else F.lit(None)).cast(t).alias(k)
    return F.transform(c, lambda e: F.struct(of(e, "value", "string"), of(e, "label", "string"), of(e, "start_position", "int"), of(e, "end_position", "int")))


def quality(df: DataFrame, found: str, expected: str) -> DataFrame:
    """Adds counts, precision, recall and F1: strict, relaxed, and relaxed with like labels."""
    counted = df.withColumns({"_s": strict_counts(F.col(found), F.col(expected)), "_m": _matches(F.col(found), F.col(expected))}).withColumns({"_r": F.col("_m.relaxed"), "_c": F.col("_m.compatible")})
    n, m = F.size(found), F.size(expected)
    out = {"ground_truth_entity_count": m, "entity_true_positive_count": F.col("_s.tp"), "entity_false_positive_count": F.col("_s.fp"), "entity_false_negative_count": F.col("_s.fn"), "entity_relaxed_count": F.col("_r"), "entity_relaxed_label_compatible_count": F.col("_c")}
    for name, hit, of, total in (("entity", F.col("_s.tp"), F.col("_s.tp") + F.col("_s.fp"), F.col("_s.tp") + F.col("_s.fn")), ("entity_relaxed", F.col("_r"), n, m), ("entity_relaxed_label_compatible", F.col("_c"), n, m)):
        precision, recall = ratio(hit, of), ratio(hit, total)
        out |= {f"{name}_precision": precision, f"{name}_recall": recall, f"{name}_f1": f1(precision, recall)}
    return counted.withColumns(out).drop("_s", "_m", "_r", "_c")


#: What ``quality`` adds.
QUALITY = ("ground_truth_entity_count", "entity_true_positive_count", "entity_false_positive_count", "entity_false_negative_count", "entity_relaxed_count", "entity_relaxed_label_compatible_count", *(f"{a}_{b}" for a in ("entity", "entity_relaxed", "entity_relaxed_label_compatible") for b in ("precision", "recall", "f1")))


def replacement_metrics(pairs: Column, entities: Column) -> dict[str, Column]:
    """Counts of replacements, repeated synthetic values, entities without one, and collisions."""
    synthetic, originals = F.transform(pairs, lambda p: p["synthetic"]), F.transform(pairs, lambda p: p["original"])
    valued = F.filter(entities, lambda e: e["value"] != "")
    missing = F.filter(valued, lambda e: ~F.array_contains(originals, e["value"]))
    collided = F.filter(valued, lambda e: F.array_contains(synthetic, e["value"]))
    distinct = lambda a: F.size(F.array_distinct(F.transform(a, lambda e: e["value"])))
    return {
        "replacement_count": F.size(pairs),
        "replacement_label_counts": label_counts(pairs),
        "replacement_duplicate_value_count": F.size(synthetic) - F.size(F.array_distinct(synthetic)),
        "replacement_missing_final_entity_count": F.size(missing),
        "replacement_missing_final_entity_label_counts": label_counts(missing),
        "replacement_missing_final_value_count": distinct(missing),
        "replacement_synthetic_original_collision_count": F.size(collided),
        "replacement_synthetic_original_collision_label_counts": label_counts(collided),
        "replacement_synthetic_original_collision_value_count": distinct(collided),
    }


def leaks(output: Column, entities: Column) -> dict[str, Column]:
    """Entities whose value the output still has."""
    left = F.filter(entities, lambda e: (e["value"] != "") & contains_value(output, e["value"]))
    return {"original_value_leak_count": F.size(left), "original_value_leak_label_counts": label_counts(left)}


def validation_chunks(candidates: Column, most: int) -> Column:
    return F.when(candidates <= 0, 0).otherwise(F.ceil(candidates / F.lit(most))).cast("int")


def model_calls(mode: str, strategy: str, grouped: Column, chunks: Column, repairs: Column | int = 0, by_model: bool = True) -> dict[str, Column]:
    """Nominal number of model calls of a record, by stage."""
    repairs = F.lit(repairs) if isinstance(repairs, int) else repairs
    when = lambda n: F.when(grouped, n).otherwise(0)
    mapped = when(F.lit(1)) if by_model and (mode == "rewrite" or strategy.lower() == "substitute") else F.lit(0)
    out = {"entity_detection": chunks + 2, "replace_map_generation": mapped}
    if mode == "rewrite":
        out |= {"latent_entity_detection": when(F.lit(1)), "rewrite_pipeline": when(F.lit(5)), "rewrite_evaluate": when(3 * (repairs + 1)), "rewrite_repair": when(repairs), "rewrite_final_judge": F.lit(0)}
    return out


def record_metrics(df: DataFrame, mode: str = "replace", strategy: str = "redact", text: str = schemas.TEXT, most: int = 100) -> DataFrame:
    """A record for each row: lengths, buckets, entity, replacement and leak counts, a rewrite's scores and repairs, estimated calls.

    Where the table has a column of expected entities, also how well they were found.
    """
    expected = expected_entities(df)
    if expected is not None:
        df = quality(df.withColumn("_hf_expected", expected), schemas.FINAL, "_hf_expected")
    final, pairs = F.col(schemas.FINAL), F.col(schemas.MAP)
    length, words = F.coalesce(F.length(text), F.lit(0)), F.coalesce(word_count(F.col(text)), F.lit(0))
    fields = {
        "record_type": F.lit("record"), "mode": F.lit(mode), "strategy": F.lit(strategy),
        "text_length_chars": length, "text_length_chars_bucket": size_bucket(length), "text_length_tokens": words, "text_length_tokens_bucket": size_bucket(words),
        "final_entity_count": F.size(final), "final_entity_label_counts": label_counts(final), "distinct_entity_label_count": F.size(F.array_distinct(F.transform(final, lambda e: e["label"]))),
        **replacement_metrics(pairs, final), **leaks(F.col(schemas.OUTPUT), final),
    }
    have = lambda *names: next((F.col(n) for n in names if n in df.columns), None)
    repairs = have("_hf_repair_iterations", "repair_iterations")
    if mode == "rewrite":
        scores = {n: have(n, f"_hf_{n}") for n in REWRITE_SCORES}
        fields |= {n: F.lit(None).cast(kind) if scores[n] is None else F.when(~F.isnan(scores[n]), scores[n]) if kind == "double" else scores[n] for n, kind in REWRITE_SCORES.items()}
        fields["repair_iterations"] = F.coalesce(repairs, F.lit(0)) if repairs is not None else F.lit(0)
    calls = model_calls(mode, strategy, F.size(schemas.BY_VALUES) > 0, validation_chunks(F.size(schemas.ENTITIES), most), F.coalesce(repairs, F.lit(0)) if repairs is not None else 0)
    fields |= {f"estimated_calls_{k}": v for k, v in calls.items()}
    if expected is not None:
        fields |= {c: F.col(c) for c in QUALITY}
    named = [c for c in (schemas.RECORD_ID,) if c in df.columns]
    return df.select(*named, *(v.alias(k) for k, v in fields.items()))


def throughput(elapsed: Column, **totals: Column) -> dict[str, Column]:
    return {f"{k}_per_sec": ratio(v, elapsed) for k, v in totals.items()}


def evaluation_metrics(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Verdicts and numbers of bad items of a judged result, with the columns ``keep``."""
    cols = [c.alias(a) for n in names for a, c in ((f"{n}_valid", F.col(f"{n}_valid")), (f"{n}_invalid_count", F.size(f"{n}_invalid")))]
    return df.select(*(keep or []), F.lit("evaluation_record").alias("record_type"), *cols)


