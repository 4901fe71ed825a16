"""Scores and decisions of rewriting under a privacy goal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of sensitivity and of importance.
SENSITIVITY = {"high": 1.0, "medium": 0.6, "low": 0.3}
IMPORTANCE = {"critical": 2.0, "important": 1.0}


@dataclass(frozen=True)
class Tolerance:
    repair_above: float
    repair_any_high: bool
    review_utility_below: float
    review_leakage_above: float


#: Presets of risk tolerance.
TOLERANCES = {
    "minimal": Tolerance(0.6, True, 0.6, 1.0),
    "low": Tolerance(1.0, True, 0.5, 2.0),
    "moderate": Tolerance(1.5, True, 0.4, 2.5),
    "high": Tolerance(2.0, False, 0.3, 3.0),
}


@dataclass(frozen=True)
class PrivacyGoal:
    protect: str = "names, numbers and other identifiers, and combinations or hints from which a person could be told"
    preserve: str = "meaning, quality and general use of the text"

    def __post_init__(self):
        for part in (self.protect, self.preserve):
            if not 10 <= len(part) <= 1000 or len(part.split()) < 3:
                raise ValueError("each part of a privacy goal has 10 to 1000 characters and at least 3 words")

    def prompt(self) -> str:
        return f"PROTECT: {self.protect}\nPRESERVE: {self.preserve}"


@dataclass(frozen=True)
class Rewrite:
    privacy_goal: PrivacyGoal = field(default_factory=PrivacyGoal)
    instructions: str | None = None
    risk_tolerance: str = "low"
    max_repair_iterations: int = 3
    strict_entity_protection: bool = False

    def __post_init__(self):
        if self.risk_tolerance not in TOLERANCES:
            raise ValueError(f"risk_tolerance is one of {', '.join(TOLERANCES)}")
        if self.max_repair_iterations < 0:
            raise ValueError("max_repair_iterations is 0 or more")

    @property
    def tolerance(self) -> Tolerance:
        return TOLERANCES[self.risk_tolerance]


def _weight(c: Column, weights: dict[str, float], default: float | None = None) -> Column:
    found = F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in weights.items()))
    return found if default is None else F.coalesce(found, F.lit(default))


def _total(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + value(x))


def sorted_answers(answers: Column, expected: Column, default: Callable[[Column], Column]) -> Column:
    """An answer for each expected id, in their order: the first given, else the default."""
    return F.transform(expected, lambda i: F.coalesce(F.try_element_at(F.filter(answers, lambda a: a["id"] == i), F.lit(1)), default(i)))


def unknown_quality(i: Column) -> Column:
    return F.struct(i.alias("id"), F.lit("unknown").alias("answer"))


def assumed_leak(i: Column) -> Column:
    """An answer that is missing counts as a certain leak."""
    return F.struct(i.alias("id"), F.lit("yes").alias("answer"), F.lit(1.0).alias("confidence"), F.lit("no answer").alias("reason"), F.array().cast("array<string>").alias("evidence"))


def no_agreement(i: Column) -> Column:
    return F.struct(i.alias("id"), F.lit(0.0).alias("score"), F.lit("no answer").alias("reason"))


def utility_score(scores: Column, importance: Column | None = None) -> Column:
    """Mean of scores, weighted by importance if there is one for each; 0 without scores."""
    flat = F.when(F.size(scores) > 0, _total(scores, lambda s: s) / F.size(scores)).otherwise(0.0)
    if importance is None:
        return flat
    pairs = F.arrays_zip(scores.alias("s"), importance.alias("w"))
    weight = lambda p: _weight(p["w"], IMPORTANCE, 1.0)
    weighted = _total(pairs, lambda p: p["s"] * weight(p)) / _total(pairs, weight)
    return F.when(F.size(scores) == 0, 0.0).when(F.size(scores) == F.size(importance), weighted).otherwise(flat)


def _asked(questions: Column, i: Column) -> Column:
    found = F.filter(questions, lambda q: q["id"] == i)
    return F.try_element_at(found, F.greatest(F.size(found), F.lit(1)))


def leakage_mass(answers: Column, questions: Column) -> Column:
    """Sum over leaked entities of sensitivity times confidence."""
    leaked = F.filter(answers, lambda a: (a["answer"] == "yes") & F.exists(questions, lambda q: q["id"] == a["id"]))
    return _total(leaked, lambda a: _weight(_asked(questions, a["id"])["sensitivity"], SENSITIVITY) * a["confidence"])


def any_high_leaked(answers: Column, questions: Column) -> Column:
    return F.exists(answers, lambda a: (a["answer"] == "yes") & F.exists(questions, lambda q: (q["id"] == a["id"]) & (q["sensitivity"] == "high")))


def weighted_leakage_rate(mass: Column, questions: Column) -> Column:
    """Mass over the weights of all questions; 0 if there are none."""
    most = _total(questions, lambda q: _weight(q["sensitivity"], SENSITIVITY))
    return F.when(most > 0, mass / most).otherwise(0.0)


def needs_repair(any_high: Column, mass: Column, tolerance: Tolerance) -> Column:
    return (F.lit(tolerance.repair_any_high) & any_high) | (mass > tolerance.repair_above)


def needs_review(rewritten: Column, any_high: Column, utility: Column, mass: Column, tolerance: Tolerance) -> Column:
    return rewritten.isNull() | any_high | (utility < tolerance.review_utility_below) | (mass > tolerance.review_leakage_above)


def protected(disposition: Column) -> Column:
    return F.filter(disposition, lambda d: d["protection_method_suggestion"] != "leave_as_is")


def privacy_questions(disposition: Column) -> Column:
    """A question for each entity to protect, numbered from 1."""
    text = lambda d: F.concat(F.lit("Could a stranger who reads only the new text name the "), d["entity_label"], F.lit(" '"), d["entity_value"], F.lit("'?"))
    return F.transform(protected(disposition), lambda d, i: F.struct((i + 1).alias("id"), text(d).alias("question"), d["sensitivity"].alias("sensitivity"), d["entity_label"].alias("entity_label"), d["entity_value"].alias("entity_value"), d["category"].alias("category")))


def renumbered(disposition: Column) -> Column:
    from ..schemas import DISPOSITION

    return F.transform(disposition, lambda d, i: F.struct(*(((i + 1) if k == "id" else d[k]).alias(k) for k in DISPOSITION.names)))


def consistent(d: Column, strict: bool = False) -> Column:
    """Whether an entity's risk and method agree: low leaves it as it is, high doesn't; strictly, neither occurs."""
    leave, risk = d["protection_method_suggestion"] == "leave_as_is", d["combined_risk_level"]
    if strict:
        return ~leave & (risk != "low")
    return ~((risk == "low") & ~leave) & ~((risk == "high") & leave)


def prompt_block(disposition: Column) -> Column:
    keep = ("entity_label", "entity_value", "sensitivity", "protection_method_suggestion", "protection_reason")
    return F.transform(protected(disposition), lambda d: F.struct(*(d[k].alias(k) for k in keep)))


def pairs_for_prompt(pairs: Column, block: Column) -> Column:
    """Replacements of the entities whose method is to replace."""
    return F.filter(pairs, lambda p: F.exists(block, lambda d: (d["protection_method_suggestion"] == "replace") & (d["entity_value"] == p["original"])))


def rewritten_text(answer: Column) -> Column:
    return F.when(F.regexp_replace(answer, r"(?U)\s+", "") != "", answer)


def leaked_items(answers: Column, questions: Column) -> Column:
    """What leaked, a line each, for the repair prompt."""
    leaked = F.filter(answers, lambda a: (a["answer"] == "yes") & F.exists(questions, lambda q: q["id"] == a["id"]))

    def line(a: Column) -> Column:
        q = _asked(questions, a["id"])
        evidence = F.when(F.size(a["evidence"]) > 0, F.concat(F.lit("\n  Evidence: "), F.array_join(F.transform(a["evidence"], lambda e: F.concat(F.lit('"'), e, F.lit('"'))), "; "))).otherwise("")
        head = F.concat(F.lit("- ["), F.upper(q["sensitivity"]), F.lit("] "), q["entity_label"], F.lit(': "'), q["entity_value"], F.lit('" -- '), q["question"])
        return F.concat(head, F.format_string(" (confidence_leakage_occurred: %.2f; reason: ", a["confidence"]), a["reason"], F.lit(")"), evidence)

    return F.array_join(F.transform(leaked, line), "\n")


#: What rows without entities get, which are passed through.
PASSED = {"utility_score": 1.0, "leakage_mass": 0.0, "weighted_leakage_rate": 0.0, "any_high_leaked": False, "needs_human_review": False, "repair_iterations": 0}


def pass_through(df: DataFrame, has_entities: Column, text: str, output: str) -> DataFrame:
    """Rows without entities keep their text and get the best scores."""
    fill = {c: F.when(has_entities, F.col(c)).otherwise(F.lit(v)) for c, v in PASSED.items() if c in df.columns}
    fill[output] = F.when(has_entities, F.col(output)).otherwise(F.col(text)) if output in df.columns else F.col(text)
    return df.withColumns(fill)


def score_rows(df: DataFrame, tolerance: Tolerance, compare: str, importance: str, answers: str, questions: str) -> DataFrame:
    """Adds utility, leakage, its rate, whether anything of high sensitivity leaked, and whether to repair."""
    scored = df.withColumns({"utility_score": utility_score(F.transform(compare, lambda c: c["score"]), F.col(importance)), "leakage_mass": leakage_mass(F.col(answers), F.col(questions)), "any_high_leaked": any_high_leaked(F.col(answers), F.col(questions))})
    scored = scored.withColumn("weighted_leakage_rate", weighted_leakage_rate(F.col("leakage_mass"), F.col(questions)))
    return scored.withColumn("needs_repair", needs_repair(F.col("any_high_leaked"), F.col("leakage_mass"), tolerance))


def repair_loop(df: DataFrame, evaluate: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], rounds: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Evaluates all rows once, then repairs and evaluates failing rows again, up to ``rounds`` times.

    ``keep`` writes a round's rows where all executors can read them and reads them
    back: a model's answers mustn't be asked for twice, and lineage is cut.
    """
    now = keep(evaluate(df.withColumn("repair_iterations", F.lit(0))), "round-0")
    for k in range(1, rounds + 1):
        failing = now.filter("needs_repair")
        if failing.isEmpty():
            break
        mended = repair(failing).drop("utility_score", "leakage_mass", "weighted_leakage_rate", "any_high_leaked", "needs_repair")
        again = evaluate(mended.withColumn("repair_iterations", F.lit(k)))
        now = keep(now.filter("not coalesce(needs_repair, false)").unionByName(again), f"round-{k}")
    return now
