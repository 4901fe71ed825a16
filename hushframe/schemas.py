"""Types of the nested columns, and the names of the columns that stages add."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()  # noqa: E741

ENTITY = _struct(id=S, value=S, label=S, start_position=I, end_position=I, score=D, source=S)
CANDIDATE = _struct(id=S, value=S, label=S, context_before=S, context_after=S)
RAW_DECISION = _struct(id=S, decision=S, proposed_label=S, reason=S)
DECISION = _struct(id=S, value=S, label=S, decision=S, proposed_label=S, reason=S)
AUGMENTED = _struct(value=S, label=S, reason=S)
LATENT = _struct(category=S, label=S, value=S, confidence=S, evidence=T.ArrayType(S), rationale=S)
BY_VALUE = _struct(value=S, labels=T.ArrayType(S))
REPLACEMENT = _struct(original=S, label=S, synthetic=S)
DOMAIN = _struct(domain=S, domain_confidence=D)
DISPOSITION = _struct(id=I, source=S, category=S, sensitivity=S, entity_label=S, entity_value=S, protection_reason=S, protection_method_suggestion=S, combined_risk_level=S)
MEANING_UNIT = _struct(id=I, aspect=S, unit=S, importance=S)
QUALITY_QA = _struct(id=I, aspect=S, importance=S, question=S, reference_answer=S)
PRIVACY_QA = _struct(id=I, question=S, sensitivity=S, entity_label=S, entity_value=S, category=S)
QUALITY_ANSWER = _struct(id=I, answer=S)
PRIVACY_ANSWER = _struct(id=I, answer=S, confidence=D, reason=S, evidence=T.ArrayType(S))
QA_COMPARE = _struct(id=I, score=D, reason=S)
FAILED = _struct(record_id=S, step=S, reason=S)

#: Columns that stages add beside the user's own.
TEXT, OUTPUT = "_hf_text", "_hf_text_out"
RAW, ENTITIES, BY_VALUES, TAGGED = "_hf_raw", "_hf_entities", "_hf_by_value", "_hf_tagged"
FINAL, MAP, RECORD_ID, ORDER = "final_entities", "_hf_map", "_hf_record_id", "_hf_order"
#: Names a result has beside the text column's own, which it suffixes.
SUFFIXES = ("_replaced", "_with_spans", "_rewritten")
RESULT_COLUMNS = ("final_entities", "utility_score", "leakage_mass", "weighted_leakage_rate", "any_high_leaked", "needs_human_review")
