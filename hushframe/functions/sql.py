"""Table functions for SQL, made of built-in functions: LATERAL joins with them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name of the function, and the columns it gives.
NAME, COLUMNS = "hf_spans", "id string, label string, value string, start_position int, end_position int, score double, source string"
_KIND = "array<struct<k0:int,start_position:int,end_position:int,label:string,value:string>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_sql(label: str, pattern: str, sign: str | None) -> str:
    """An array of a rule's matches in ``t``; their places come from the lengths of what lies between.

    A match begins with its negated length, so that sorted the longest comes first.
    """
    p, name = _quoted(pattern), _quoted(label)
    pairs = f"transform(regexp_extract_all(t, {p}, 0), (v, i) -> named_struct('piece', get(split(t, {p}, -1), i), 'value', v))"
    found = "named_struct('k0', - length(m.value), 'start_position', acc.at + length(m.piece), 'end_position', acc.at + length(m.piece) + length(m.value), 'label', {n}, 'value', m.value)".format(n=name)
    walked = f"aggregate({pairs}, named_struct('at', 0, 'out', cast(array() as {_KIND})), (acc, m) -> named_struct('at', acc.at + length(m.piece) + length(m.value), 'out', array_append(acc.out, {found})), acc -> acc.out)"
    tried = f"contains(t, {_quoted(sign)})" if sign else f"t rlike {p}"
    return f"case when {tried} then {walked} else cast(array() as {_KIND}) end"


def spans_function(rules: dict[str, str], signs: dict[str, str], name: str = NAME) -> str:
    """The statement that makes the function: all rules' matches, of overlapping ones the longest, then the first."""
    every = "concat(" + ", ".join(rule_sql(k, p, signs.get(k)) for k, p in rules.items()) + ")"
    kept = f"aggregate(sort_array({every}), cast(array() as {_KIND}), (acc, e) -> if(exists(acc, x -> x.start_position < e.end_position and e.start_position < x.end_position), acc, array_append(acc, e)))"
    told = "concat_ws('_', s.label, s.start_position, s.end_position) as id, s.label, s.value, s.start_position, s.end_position, cast(1.0 as double) as score, 'detector' as source"
    return f"create or replace temporary function {name}(t string) returns table ({COLUMNS}) return select {told} from (select explode({kept}) as s)"


def register(spark: SparkSession, labels: list[str] | None = None, name: str = NAME) -> str:
    """Makes the rule detector a table function of the session: ``from docs d, lateral hf_spans(d.text) s``; gives its name."""
    from ..operators.detect import RULES, SIGNS

    spark.sql(spans_function({k: p for k, p in RULES.items() if labels is None or k in labels}, SIGNS, name))
    return name
