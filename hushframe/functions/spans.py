"""Column functions on arrays of entity spans: the span algebra.

A span is ``schemas.ENTITY``; offsets are code points, half open. All functions take
and return columns, so that a plan stays in the JVM; per-row costs are quadratic in a
row's spans at most.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENTITY
from .text import bound, count_of, entity_tag, needle_pattern, occurrences, strip, tag_notation  # noqa: F401

KIND = f"array<{ENTITY.simpleString()}>"
CONTEXT = 32
#: Occurrences whose texts are cut out one by one, each from the text's beginning; more are taken from one search.
FEW = 8


def no_spans() -> Column:
    return F.array().cast(KIND)


def span(value: Column, label: Column, start: Column, end: Column, score: Column, source: str) -> Column:
    """A span whose id is made of its label and place."""
    name = F.concat_ws("_", label, start.cast("string"), end.cast("string"))
    parts = (("id", name), ("value", value), ("label", label), ("start_position", start.cast("int")), ("end_position", end.cast("int")), ("score", score.cast("double")), ("source", F.lit(source)))
    return F.struct(*(v.alias(k) for k, v in parts))


def relabel(e: Column, label: Column) -> Column:
    """The span under another label; its id stays."""
    return F.struct(*((label if k == "label" else e[k]).alias(k) for k in ENTITY.names))


def _ranked(entities: Column, *keys) -> Column:
    """Spans in the order of the keys; spans of equal keys keep their order."""
    wrapped = F.transform(entities, lambda e, i: F.struct(*(k(e).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("i"), e.alias("e")))
    return F.transform(F.sort_array(wrapped), lambda w: w["e"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start_position"] < b["end_position"]) & (b["start_position"] < a["end_position"])


def by_place(entities: Column) -> Column:
    return _ranked(entities, lambda e: e["start_position"], lambda e: e["end_position"], lambda e: e["label"])


def _pairwise(entities: Column) -> Column:
    longest = _ranked(entities, lambda e: e["start_position"] - e["end_position"], lambda e: e["start_position"], lambda e: e["end_position"], lambda e: e["label"])
    kept = F.aggregate(longest, no_spans(), lambda acc, e: F.when(F.exists(acc, lambda x: overlap(x, e)), acc).otherwise(F.array_append(acc, e)))
    return by_place(kept)


def resolve_overlaps(entities: Column) -> Column:
    """Keeps the longest of overlapping spans; on ties the first, then the shorter, then the smaller label.

    Of the spans of one place the first by label stays whatever the others are, so these
    are made one beforehand; only if spans overlap then are they compared pair by pair.
    """
    start, end = (lambda e: e["start_position"]), (lambda e: e["end_position"])

    def settled(placed: Column) -> Column:
        overlaps = F.filter(placed, lambda e, i: F.coalesce(start(e) >= end(e), F.lit(True)) | ((i > 0) & F.coalesce(end(F.get(placed, i - 1)) > start(e), F.lit(True))))
        return F.when(F.size(overlaps) == 0, placed).otherwise(_pairwise(placed))

    def distinct(placed: Column) -> Column:
        same = lambda e, o: (start(o) == start(e)) & (end(o) == end(e)) & (start(e) < end(e))
        return F.filter(placed, lambda e, i: ~F.coalesce(same(e, F.get(placed, i - 1)), F.lit(False)))

    return bound(bound(by_place(entities), distinct), settled)


def parse_raw(raw: Column, text: Column) -> Column:
    """A detector's JSON answer as resolved spans; what isn't well-formed is left out.

    Values aren't compared with the text, scores aren't filtered.
    """
    items = F.try_variant_get(F.try_parse_json(raw), "$.entities", "array<variant>")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    read = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.struct(strip(get(v, "$.text", "string")).alias("value"), strip(get(v, "$.label", "string")).alias("label"), get(v, "$.start", "int").alias("s"), get(v, "$.end", "int").alias("e"), F.coalesce(get(v, "$.score", "double"), F.lit(0.0)).alias("score")))
    fine = F.filter(read, lambda r: F.coalesce((r["value"] != "") & (r["label"] != "") & (r["s"] >= 0) & (r["e"] > r["s"]) & (r["e"] <= F.length(text)), F.lit(False)))
    return resolve_overlaps(F.transform(fine, lambda r: span(r["value"], r["label"], r["s"], r["e"], r["score"], "detector")))


def validation_candidates(text: Column, entities: Column, window: int = CONTEXT) -> Column:
    def one(e: Column) -> Column:
        start, end = e["start_position"], e["end_position"]
        before = F.greatest(start - window, F.lit(0))
        return F.struct(e["id"].alias("id"), e["value"].alias("value"), e["label"].alias("label"), F.substring(text, before + 1, start - before).alias("context_before"), F.substring(text, end + 1, F.lit(window)).alias("context_after"))

    return F.transform(entities, one)


def _last(items: Column, predicate) -> Column:
    found = F.filter(items, predicate)
    return F.try_element_at(found, F.greatest(F.size(found), F.lit(1)))


def apply_decisions(entities: Column, decisions: Column) -> Column:
    """Drops, relabels or keeps spans by id; the last proper decision counts, without one a span stays."""
    verdict = lambda d: F.lower(strip(d["decision"]))
    slim = F.transform(decisions, lambda d: F.struct(*(d[k].alias(k) for k in ("id", "decision", "proposed_label"))))
    proper = F.filter(F.coalesce(slim, F.array().cast("array<struct<id:string,decision:string,proposed_label:string>>")), lambda d: (strip(d["id"]) != "") & verdict(d).isin("keep", "reclass", "drop"))
    paired = F.transform(entities, lambda e: F.struct(e.alias("e"), _last(proper, lambda d: strip(d["id"]) == e["id"]).alias("d")))
    stay = F.filter(paired, lambda p: F.coalesce(verdict(p["d"]) != "drop", F.lit(True)))
    label = lambda p: strip(p["d"]["proposed_label"])
    return F.transform(stay, lambda p: F.when((verdict(p["d"]) == "reclass") & (label(p) != ""), relabel(p["e"], label(p))).otherwise(p["e"]))


def merge_decisions(answers: Column, candidates: Column) -> Column:
    """Decisions of several answers as one list: known ids, no empty verdicts, the first of an id."""
    flat = F.filter(F.flatten(answers), lambda d: d["decision"].isNotNull())
    known = F.filter(flat, lambda d: F.exists(candidates, lambda c: c["id"] == d["id"]))
    first = F.filter(known, lambda d, i: ~F.exists(F.slice(known, 1, i), lambda x: x["id"] == d["id"]))

    def filled(d: Column) -> Column:
        c = _last(candidates, lambda c: c["id"] == d["id"])
        return F.struct(d["id"].alias("id"), c["value"].alias("value"), c["label"].alias("label"), d["decision"].alias("decision"), F.coalesce(d["proposed_label"], F.lit("")).alias("proposed_label"), d["reason"].alias("reason"))

    return F.transform(first, filled)


def enrich_decisions(decisions: Column, candidates: Column) -> Column:
    """Value and label of the candidate beside each decision whose id is known."""
    known = F.filter(decisions, lambda d: F.exists(candidates, lambda c: c["id"] == d["id"]))

    def filled(d: Column) -> Column:
        c = _last(candidates, lambda c: c["id"] == d["id"])
        return F.struct(d["id"].alias("id"), c["value"].alias("value"), c["label"].alias("label"), d["decision"].alias("decision"), d["proposed_label"].alias("proposed_label"), d["reason"].alias("reason"))

    return F.transform(known, filled)


def spans_of(text: Column, needle: Column, label: Column, score: Column, source: str, as_in_text: bool = False) -> Column:
    """A span at every occurrence of a value."""
    one = lambda value, at: span(value, label, at, at + F.length(needle), score, source)
    if not as_in_text:
        return F.transform(occurrences(text, needle), lambda at: one(needle, at))

    def taken(starts: Column) -> Column:
        few = F.transform(starts, lambda at: one(F.substring(text, at + 1, F.length(needle)), at))
        found = lambda: F.regexp_extract_all(text, needle_pattern(needle), F.lit(0))
        return F.when(F.size(starts) <= FEW, few).otherwise(bound(found(), lambda v: F.transform(starts, lambda at, i: one(F.get(v, i), at))))

    return bound(occurrences(text, needle), taken)


def split_full_names(text: Column, entities: Column) -> Column:
    """Adds the parts of full names at all their occurrences, unless a part is one letter or a known value."""
    names = F.filter(entities, lambda e: e["label"] == "full_name")

    def parts(e: Column) -> Column:
        words = F.split(strip(e["value"]), r"(?U)\s+", -1)
        label = lambda i: F.when(i == 0, F.lit("first_name")).when(i == F.size(words) - 1, F.lit("last_name")).otherwise(F.lit("middle_name"))
        each = F.transform(words, lambda w, i: F.struct(w.alias("part"), label(i).alias("label"), e["score"].alias("score")))
        return F.when(F.size(words) >= 2, each).otherwise(F.slice(each, 1, 0))

    known = F.transform(entities, lambda e: F.lower(e["value"]))
    every = F.filter(F.flatten(F.transform(names, parts)), lambda p: (F.length(p["part"]) > 1) & ~F.array_contains(known, F.lower(p["part"])))
    fresh = F.filter(every, lambda p, i: ~F.exists(F.slice(every, 1, i), lambda x: F.lower(x["part"]) == F.lower(p["part"])))
    return F.concat(entities, F.flatten(F.transform(fresh, lambda p: spans_of(text, p["part"], p["label"], p["score"], "name_split"))))


def add_suggestions(text: Column, entities: Column, suggestions: Column) -> Column:
    """Adds suggested values at all their occurrences (before names are split)."""
    proper = F.filter(F.coalesce(suggestions, F.array().cast("array<struct<value:string,label:string,reason:string>>")), lambda s: (strip(s["value"]) != "") & (strip(s["label"]) != ""))
    return F.concat(entities, F.flatten(F.transform(proper, lambda s: spans_of(text, strip(s["value"]), strip(s["label"]), F.lit(1.0), "augmenter"))))


def first_of_value(entities: Column) -> Column:
    """The first span of each value, whatever its case."""
    return F.filter(entities, lambda e, i: ~F.exists(F.slice(entities, 1, i), lambda x: F.lower(x["value"]) == F.lower(e["value"])))


def expand_occurrences(text: Column, entities: Column) -> Column:
    """Spans at all occurrences of the values, under the first label of each; then resolved."""
    more = F.flatten(F.transform(first_of_value(entities), lambda e: spans_of(text, e["value"], e["label"], F.lit(1.0), "propagation", as_in_text=True)))
    return resolve_overlaps(F.concat(entities, more))


def _walk(text: Column, entities: Column, replacement, checked: bool) -> Column:
    """The text with each span replaced, spans in the given order; those before the end of the last are skipped."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        start, end = e["start_position"], e["end_position"]
        bad = start < acc["at"]
        if checked:
            bad = bad | (end <= start) | (end > F.length(text))
        moved = F.struct(end.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), replacement(e)).alias("out"))
        return F.when(bad, acc).otherwise(moved)

    return F.aggregate(entities, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def slice_of(text: Column, e: Column) -> Column:
    return F.substring(text, e["start_position"] + 1, e["end_position"] - e["start_position"])


def tagged_text(text: Column, entities: Column, notation: Column | None = None) -> Column:
    """The text with its spans tagged, in the notation that its own characters disturb least."""
    notation = tag_notation(text) if notation is None else notation
    ordered = _ranked(entities, lambda e: e["start_position"], lambda e: e["end_position"])
    return F.when(F.size(entities) > 0, _walk(text, ordered, lambda e: entity_tag(slice_of(text, e), e["label"], notation), False)).otherwise(text)


def group_by_value(entities: Column) -> Column:
    """Distinct values in code-point order, each with its labels in order."""
    values = F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["value"])))
    labels = lambda v: F.array_sort(F.array_distinct(F.transform(F.filter(entities, lambda e: e["value"] == v), lambda e: e["label"])))
    return F.transform(values, lambda v: F.struct(v.alias("value"), labels(v).alias("labels")))


def allowed_labels(entities: Column, labels: list[str] | None) -> Column:
    return entities if labels is None else F.filter(entities, lambda e: e["label"].isin(*labels))


def order_candidates(candidates: Column, entities: Column) -> Column:
    """Candidates in the order of their spans; a candidate without a span is an error."""
    place = lambda c: _last(entities, lambda e: e["id"] == c["id"])
    found = lambda c: F.when(F.exists(entities, lambda e: e["id"] == c["id"]), place(c)).otherwise(F.raise_error(F.concat(F.lit("candidate without a span: "), c["id"])))
    wrapped = F.transform(candidates, lambda c: F.struct(found(c)["start_position"].alias("a"), found(c)["end_position"].alias("b"), c["id"].alias("i"), c.alias("c")))
    return F.transform(F.sort_array(wrapped), lambda w: w["c"])


def chunks(items: Column, most: int) -> Column:
    """Runs of at most ``most`` items."""
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(most))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(most)))).otherwise(F.slice(F.array(items), 1, 0))


def excerpt(text: Column, mine: Column, entities: Column, window: int, notation: Column) -> Column:
    """The text around some spans, with all spans inside it tagged."""
    first = F.greatest(F.array_min(F.transform(mine, lambda e: e["start_position"])) - window, F.lit(0))
    last = F.least(F.array_max(F.transform(mine, lambda e: e["end_position"])) + window, F.length(text))
    inside = F.filter(entities, lambda e: (e["start_position"] >= first) & (e["end_position"] <= last))
    moved = F.transform(inside, lambda e: F.struct(*((e[k] - first if k in ("start_position", "end_position") else e[k]).alias(k) for k in ENTITY.names)))
    return F.when(F.size(mine) > 0, tagged_text(F.substring(text, first + 1, last - first), moved, notation)).otherwise("")


def skeleton(candidates: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.transform(candidates, lambda c: F.struct(c["id"].alias("id"), c["value"].alias("value"), c["label"].alias("label"), nothing.alias("decision"), nothing.alias("proposed_label"), nothing.alias("reason")))


def text_chunks(text: Column, length: int, shared: int) -> Column:
    """Overlapping pieces of a text with their offsets; the last one reaches its end."""
    if length < 1 or shared < 0 or shared >= length:
        raise ValueError("a chunk needs a length of at least 1 and an overlap below it")
    n = F.length(text)
    more = F.ceil(F.greatest(n - length, F.lit(0)) / (length - shared)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), more), lambda i: i * (length - shared))
    each = F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(length)).alias("text")))
    return F.when(n > 0, each).otherwise(F.slice(each, 1, 0))


def shifted(entities: Column, offset: Column) -> Column:
    return F.transform(entities, lambda e: span(e["value"], e["label"], e["start_position"] + offset, e["end_position"] + offset, e["score"], "detector"))


def without_subsets(entities: Column) -> Column:
    """Without spans that lie within a longer one."""
    within = lambda e, o: (o["start_position"] <= e["start_position"]) & (o["end_position"] >= e["end_position"]) & ((o["start_position"] < e["start_position"]) | (o["end_position"] > e["end_position"]))
    return F.filter(entities, lambda e: ~F.exists(entities, lambda o: within(e, o)))


def deduplicated(entities: Column) -> Column:
    """One span of each label, value (whatever its case) and place: that of the best score."""
    keyed = F.transform(entities, lambda e: F.struct(e["label"].alias("label"), F.lower(strip(e["value"])).alias("value"), e["start_position"].alias("s"), e["end_position"].alias("e"), e["score"].alias("score"), e.alias("span")))
    same = lambda a, b: (a["s"] == b["s"]) & (a["e"] == b["e"]) & (a["label"] == b["label"]) & (a["value"] == b["value"])
    best = lambda group: bound(F.array_max(F.transform(group, lambda x: x["score"])), lambda top: F.try_element_at(F.filter(group, lambda x: x["score"] == top), F.lit(1))["span"])

    def once(every: Column) -> Column:
        first = F.filter(every, lambda e, i: ~F.exists(F.slice(every, 1, i), lambda x: same(x, e)))
        return F.transform(first, lambda e: bound(F.filter(every, lambda x: same(x, e)), best))

    return bound(keyed, once)


def final_spans(entities: Column, flat: bool) -> Column:
    """What a detector's server answers: each span once and, unless ``flat``, without those within longer ones."""
    return deduplicated(entities if flat else without_subsets(entities))
