"""Registered queries: each operator on whole tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import spans, text
from .operators import analysis, artifacts, detect, joins, judge, medians, metrics, model, replace, rewrite
from .operators.detect import RULES
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias(schemas.TEXT))


def _found(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """doc_id, text and final entities of the rule detector."""
    out = detect.detect(_docs(spark, sf_dir), labels=list(labels) or None)
    return out.withColumn(schemas.FINAL, F.col(schemas.ENTITIES)).withColumn(schemas.BY_VALUES, spans.group_by_value(F.col(schemas.ENTITIES)))


# ---------------------------------------------------------------- SQL of detection

EMAIL, IPV4, CARD = RULES["email"], RULES["ipv4"], RULES["credit_debit_card"]


def _sql_spans(label: str, table: str = "documents", key: str = "doc_id") -> str:
    """SQL for key, label, value, s, e of a rule's matches."""
    p = RULES[label]
    return f"""select {key}, '{label}' as label, v[i] as value,
        cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) as integer) as s,
        cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) as integer) as e
        from (select {key}, string_split_regex(text, '{p}') as p, regexp_extract_all(text, '{p}') as v from {table}), lateral (select unnest(range(1, len(v) + 1)) as i)"""


_ALL = " union all ".join(_sql_spans(k) for k in RULES)
#: Spans of all rules after overlap resolution, by a fold over each document's list.
_RESOLVED = f"""with raw as ({_ALL}),
  lists as (select doc_id, list({{'s': s, 'e': e, 'label': label, 'value': value}} order by s - e, s, e, label) as l from raw group by doc_id),
  kept as (select doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, c: case when len(list_filter(acc, lambda a: a.s < c[1].e and c[1].s < a.e)) > 0 then acc else list_concat(acc, c) end) as k from lists),
  spans as (select doc_id, u.label as label, u.value as value, u.s as s, u.e as e from (select doc_id, unnest(k) as u from kept))"""


def _each(df: DataFrame, items: Column | str, name: str) -> DataFrame:
    """doc_id and each item. Of a plain explode Catalyst makes a filter too, which would work the items out twice."""
    return df.select("doc_id", F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def _above_0(df: DataFrame, count: str) -> DataFrame:
    """Rows whose count is above 0. A plain filter goes below the columns it is made of, and would work them all out again, once for each time they are named."""
    return df.withColumn(count, F.explode_outer(F.array(count))).filter(F.col(count) > 0)


def _exploded(df: DataFrame) -> DataFrame:
    e = _each(df, schemas.FINAL, "e")
    return e.select("doc_id", F.col("e.label").alias("label"), F.col("e.value").alias("value"), F.col("e.start_position").alias("s"), F.col("e.end_position").alias("e"))


# ---------------------------------------------------------------- scans and projections


@query("select doc_id, lang, source, n_chars, length(text) as chars from documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("chars"))


@query("select doc_id, lang, length(text) as chars from documents order by doc_id limit 10")
def preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.slice_rows(_table(spark, sf_dir, "documents"), "doc_id", 0, 10).select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("select doc_id, source from documents order by doc_id limit 25 offset 40")
def slice_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.slice_rows(_table(spark, sf_dir, "documents"), "doc_id", 40, 25).select("doc_id", "source")


@query("select doc_id, text as final_entities__input, text || '!' as text__kept, source from documents")
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("final_entities"), F.concat("text", F.lit("!")).alias("text__kept"), "source")
    return tables.keep_apart(frame, "final_entities").frame


@query(f"select doc_id, text, regexp_replace(text, '{EMAIL}', '[REDACTED_EMAIL]', 'g') as text_replaced from documents")
def project_user_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.engine import user_columns

    out = replace.replace(_found(spark, sf_dir, "email"), replace.Redact())
    return user_columns(out, "text").select("doc_id", "text", "text_replaced")


@query(f"select doc_id, label, value, s, e from ({_sql_spans('email')} union all {_sql_spans('ipv4')})")
def filter_allowed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.detect(_docs(spark, sf_dir), labels=["email", "ipv4"])
    return _exploded(out.withColumn(schemas.FINAL, spans.allowed_labels(F.col(schemas.ENTITIES), ["email", "ipv4"])))


@query(f"select doc_id, regexp_matches(text, '{'|'.join(RULES.values())}') as has_entities from documents")
def has_entities_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", (F.size(schemas.FINAL) > 0).alias("has_entities"))


# ---------------------------------------------------------------- detection and spans


def _rule_query(label: str, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _each(_docs(spark, sf_dir), detect.rule_spans(F.col(schemas.TEXT), label, RULES[label]), "e")
        return found.groupBy("doc_id", F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = name
    query(f"select doc_id, value, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '{RULES[label]}')) as value from documents) group by doc_id, value")(run)


for _label, _name in (("email", "detect_email"), ("ipv4", "detect_ipv4"), ("credit_debit_card", "detect_card"), ("api_key", "detect_key")):
    _rule_query(_label, _name)


@query(f"{_RESOLVED} select doc_id, label, value, s, e from spans")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules through the detector's JSON contract, parsed and resolved."""
    return _exploded(_found(spark, sf_dir))


def _needle_sql(needle: str) -> str:
    n = len(needle)
    return f"""with c as (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as p from documents),
      w as (select doc_id, p, {' || '.join(f"coalesce(lead(ch, {k}) over o, '')" for k in range(n))} as word, coalesce(lag(ch) over o, ' ') as before, coalesce(lead(ch, {n}) over o, ' ') as after from c window o as (partition by doc_id order by p))
      select doc_id, cast(p - 1 as integer) as start from w where lower(word) = '{needle}' and not regexp_matches(before, '[A-Za-z0-9_]') and not regexp_matches(after, '[A-Za-z0-9_]')"""


@query(_needle_sql("the"))
def occurrence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_docs(spark, sf_dir), text.occurrences(F.col(schemas.TEXT), F.lit("the")), "start")


_LINES = "select l_orderkey, l_linenumber, min(l_partkey) as pk, min(l_suppkey) as sk, cast(min(l_quantity) as integer) as q from lineitem group by l_orderkey, l_linenumber"
_LABELS = ("city", "email", "ssn")
_SPAN_SQL = f"select l_orderkey as id, cast((pk * 7 + l_linenumber * 13) % 60 as integer) as s, cast((pk * 7 + l_linenumber * 13) % 60 + 3 + q % 15 as integer) as e, case sk % 3 when 0 then 'city' when 1 then 'email' else 'ssn' end as label, l_linenumber as n from ({_LINES})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out by order once: lines, and the orders made of them, need no other exchange
    dealt = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("int").alias("q"))
    start = ((F.col("pk") * 7 + F.col("l_linenumber") * 13) % 60).cast("int")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("sk") % 3 + 1).cast("int"))
    return lines.select(F.col("l_orderkey").alias("id"), start.alias("s"), (start + 3 + F.col("q") % 15).alias("e"), label.alias("label"), F.col("l_linenumber").alias("n"), "pk", "sk", "q")


def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and spans of each order, from its lines (an order has few)."""
    rows = _lines(spark, sf_dir)
    value = F.concat(F.lit("v"), F.col("pk").cast("string"))
    one = F.struct("n", spans.span(value, F.col("label"), F.col("s"), F.col("e"), F.lit(1.0), "detector").alias("e"))
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["e"]).alias("spans"))


@query(
    f"""with raw as ({_SPAN_SQL}), lists as (select id, list({{'s': s, 'e': e, 'label': label}} order by s - e, s, e, label) as l from raw group by id),
    kept as (select id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, c: case when len(list_filter(acc, lambda a: a.s < c[1].e and c[1].s < a.e)) > 0 then acc else list_concat(acc, c) end) as k from lists)
    select id, u.s as s, u.e as e, u.label as label from (select id, unnest(k) as u from kept)"""
)
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line_spans(spark, sf_dir).select("id", F.explode(spans.resolve_overlaps(F.col("spans"))).alias("u"))
    return out.select("id", F.col("u.start_position").alias("s"), F.col("u.end_position").alias("e"), F.col("u.label").alias("label"))


@query(f"with r as ({_SPAN_SQL}) select distinct id, s, e, label from r a where not exists (select 1 from r b where b.id = a.id and b.s <= a.s and b.e >= a.e and (b.s < a.s or b.e > a.e))")
def remove_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line_spans(spark, sf_dir).select("id", F.explode(spans.without_subsets(F.col("spans"))).alias("u"))
    return out.select("id", F.col("u.start_position").alias("s"), F.col("u.end_position").alias("e"), F.col("u.label").alias("label")).distinct()


@query(f"select id, label, s, e, count(*) as n from ({_SPAN_SQL}) group by id, label, s, e")
def deduplicate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each span is there before, which it is once after."""
    same = F.transform("spans", lambda e: spans.span(F.lit("x"), e["label"], e["start_position"], e["end_position"], e["score"], "detector"))
    both = _line_spans(spark, sf_dir).withColumn("all", same).withColumn("once", spans.deduplicated(F.col("all")))
    each = both.select("id", "all", F.explode("once").alias("u"))
    n = F.size(F.filter("all", lambda e: e["id"] == F.col("u.id")))
    return each.select("id", F.col("u.label").alias("label"), F.col("u.start_position").alias("s"), F.col("u.end_position").alias("e"), n.cast("long").alias("n"))


def _count_sql(marks: tuple[str, ...], c: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in marks)


_NOTATION_SQL = "[" + ", ".join(f"{{'n': {_count_sql(marks, 'text')}, 'r': {i}, 'name': '{name}'}}" for i, (name, marks) in enumerate(text.NOTATIONS)) + "]"


@query(f"select kind, id, list_min({_NOTATION_SQL}).name as notation from (select 'document' as kind, doc_id as id, text from documents union all select 'page', page_id, html from pages)")
def tag_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = _table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("kind", "id", text.tag_notation("text").alias("notation"))


@query(
    f"""select doc_id, case n when 'xml' then regexp_replace(text, '({EMAIL})', '<email>\\1</email>', 'g') when 'bracket' then regexp_replace(text, '({EMAIL})', '[[\\1|email]]', 'g')
    when 'paren' then regexp_replace(text, '({EMAIL})', '((SENSITIVE:email|\\1))', 'g') else regexp_replace(text, '({EMAIL})', '<<SENSITIVE:email>>\\1<</SENSITIVE:email>>', 'g') end as tagged
    from (select doc_id, text, list_min({_NOTATION_SQL}).name as n from documents)"""
)
def tag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, "email")
    return found.select("doc_id", spans.tagged_text(F.col(schemas.TEXT), F.col(schemas.FINAL)).alias("tagged"))


@query(f"{_RESOLVED} select doc_id, value, array_to_string(list_sort(list_distinct(list(label))), ',') as labels from spans group by doc_id, value")
def entities_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _each(_found(spark, sf_dir), schemas.BY_VALUES, "v")
    return out.select("doc_id", F.col("v.value").alias("value"), F.array_join("v.labels", ",").alias("labels"))


@query(f"{_RESOLVED} select s.doc_id, s.label || '_' || s.s || '_' || s.e as id, substr(d.text, greatest(s.s - 32, 0) + 1, s.s - greatest(s.s - 32, 0)) as context_before, substr(d.text, s.e + 1, 32) as context_after from spans s join documents d using (doc_id)")
def validation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _found(spark, sf_dir).select("doc_id", F.explode(spans.validation_candidates(F.col(schemas.TEXT), F.col(schemas.FINAL))).alias("c"))
    return out.select("doc_id", F.col("c.id").alias("id"), F.col("c.context_before").alias("context_before"), F.col("c.context_after").alias("context_after"))


def _decisions() -> Column:
    """A decision for each span, from its place: none, keep, reclass or drop; with a second one for some."""
    kind = lambda e, n: F.element_at(F.array(*map(F.lit, ("none", "keep", "reclass", "drop"))), (e["start_position"] + n) % 4 + 1)
    one = lambda e, n: F.struct(e["id"].alias("id"), kind(e, n).alias("decision"), F.when(e["end_position"] % 2 == 0, F.lit("place")).otherwise("").alias("proposed_label"), F.lit("r").alias("reason"))
    return F.concat(F.transform("spans", lambda e: one(e, F.lit(0))), F.transform(F.filter("spans", lambda e: e["end_position"] % 5 == 0), lambda e: one(e, F.lit(1))))


_VERDICT = "case when e % 5 = 0 and (s + 1) % 4 > 0 then (s + 1) % 4 else s % 4 end"


@query(f"select distinct id, s, e, case when v = 2 and e % 2 = 0 then 'place' else label end as label from (select *, {_VERDICT} as v from (select distinct id, s, e, label from ({_SPAN_SQL}))) where v <> 3")
def decisions_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_spans(spark, sf_dir).withColumn("decisions", _decisions())
    out = rows.select("id", F.explode(F.array_distinct(F.transform(spans.apply_decisions(F.col("spans"), F.col("decisions")), lambda e: F.struct(e["start_position"].alias("s"), e["end_position"].alias("e"), e["label"].alias("label"))))).alias("u"))
    return out.select("id", "u.s", "u.e", "u.label")


@query(f"select id, name, decision from (select id, label || '_' || s || '_' || e as name, case when s % 4 = 0 then (case when e % 5 = 0 then 'keep' end) else list_value('keep', 'reclass', 'drop')[s % 4] end as decision from (select distinct id, s, e, label from ({_SPAN_SQL}))) where decision is not null")
def decisions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.transform(_decisions(), lambda d: F.struct(d["id"].alias("id"), F.when(d["decision"] != "none", d["decision"]).alias("decision"), d["proposed_label"].alias("proposed_label"), d["reason"].alias("reason")))
    rows = _line_spans(spark, sf_dir).withColumn("answers", F.array(clean)).withColumn("candidates", F.transform("spans", lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"), e["label"].alias("label"))))
    out = rows.select("id", F.explode(spans.merge_decisions(F.col("answers"), F.col("candidates"))).alias("d"))
    return out.select("id", F.col("d.id").alias("name"), F.col("d.decision").alias("decision"))


@query(f"select id, name, cast((row_number() over (partition by id order by s, e, name) - 1) // 2 as integer) as chunk from (select distinct id, s, e, label || '_' || s || '_' || e as name from ({_SPAN_SQL}))")
def chunk_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_spans(spark, sf_dir).withColumn("spans", spans.by_place(F.array_distinct(F.transform("spans", lambda e: spans.span(F.lit("x"), e["label"], e["start_position"], e["end_position"], e["score"], "detector")))))
    ordered = spans.order_candidates(F.transform("spans", lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"), e["label"].alias("label"))), F.col("spans"))
    out = rows.select("id", F.posexplode(spans.chunks(ordered, 2)).alias("chunk", "items"))
    return out.select("id", F.explode(F.transform("items", lambda c: c["id"])).alias("name"), "chunk")


@query(f"select doc_id, string_agg(substr(text, greatest(s - 20, 0) + 1, s - greatest(s - 20, 0)) || '<email>' || value || '</email>' || substr(text, e + 1, 20), '' order by s) as excerpts from ({_sql_spans('email')}) join documents using (doc_id) group by doc_id")
def chunk_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda e: spans.excerpt(F.col(schemas.TEXT), F.array(e), F.array(e), 20, F.lit("xml"))
    found = _found(spark, sf_dir, "email").filter(F.size(schemas.FINAL) > 0)
    return found.select("doc_id", F.array_join(F.transform(schemas.FINAL, one), "").alias("excerpts"))


@query("select doc_id, cast(i * 256 as integer) as start, length(substr(text, i * 256 + 1, 384)) as n from documents, lateral (select unnest(range(0, case when length(text) = 0 then 0 else cast(ceil(greatest(length(text) - 384, 0) / 256.0) as bigint) + 1 end)) as i)")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", F.explode(spans.text_chunks(F.col(schemas.TEXT), 384, 128)).alias("c"))
    return out.select("doc_id", F.col("c.offset").alias("start"), F.length("c.text").cast("long").alias("n"))


@query("with p as (select l_orderkey as id, min(l_partkey) as k from lineitem group by l_orderkey) select id, case when k % 2 = 0 then 2 else 0 end as n_first, case when k % 2 = 0 then 1 else 2 end as n_last from p")
def split_full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ann Berg as one full name in a text of four names, or Berg known before."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("k"))
    even = F.col("k") % 2 == 0
    body = F.lit("Ann Berg met ann; Berg")
    full = spans.span(F.when(even, F.lit("Ann Berg")).otherwise("Zoe Berg"), F.lit("full_name"), F.lit(0), F.lit(8), F.lit(1.0), "detector")
    known = F.when(even, F.array(full, spans.span(F.lit("BERG"), F.lit("last_name"), F.lit(4), F.lit(8), F.lit(1.0), "detector"))).otherwise(F.array(full))
    split = spans.split_full_names(body, known)
    count = lambda label: F.size(F.filter("s", lambda e: e["label"] == label))
    return rows.select("id", split.alias("s")).select("id", count("first_name").alias("n_first"), count("last_name").alias("n_last"))


@query(_needle_sql("and").replace("cast(p - 1 as integer) as start", "count(*) as n").rstrip() + " group by doc_id")
def expand_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span expanded to all its occurrences."""
    docs = _docs(spark, sf_dir)
    one = lambda at: spans.span(F.lit("and"), F.lit("word"), at, at + 3, F.lit(1.0), "detector")
    seed = F.transform(F.slice(text.occurrences(F.col(schemas.TEXT), F.lit("and")), 1, 1), one)
    wide = docs.withColumn("seed", seed).select("doc_id", F.size(spans.expand_occurrences(F.col(schemas.TEXT), F.col("seed"))).cast("long").alias("n"))
    return _above_0(wide, "n")


# ---------------------------------------------------------------- replacement

_VALUES = f"{_RESOLVED} select distinct value, label from spans"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_found(spark, sf_dir)).select("value", "label").distinct()


@query(f"select value, '[REDACTED_' || upper(label) || ']' as synthetic from ({_VALUES})")
def redact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("value", replace.Redact().column(F.col("value"), F.col("label")).alias("synthetic"))


@query(f"select value, '<' || value || ', ' || label || '>' as synthetic from ({_VALUES})")
def annotate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("value", replace.Annotate().column(F.col("value"), F.col("label")).alias("synthetic"))


def _hash_query(algorithm: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _values(spark, sf_dir).select("value", replace.Hash(algorithm, 16).column(F.col("value"), F.col("label")).alias("synthetic"))

    run.__name__ = f"hash_{algorithm}"
    query(f"select value, '<HASH_' || upper(label) || '_' || substr({algorithm}(value), 1, 16) || '>' as synthetic from ({_VALUES})")(run)


for _algorithm in ("sha256", "sha1", "md5"):
    _hash_query(_algorithm)


def _replaced_sql(synthetic: str) -> str:
    """SQL that replaces all resolved spans of each document."""
    return f"""{_RESOLVED}, o as (select doc_id, list(s order by s) as ss, list(e order by s) as es, list({synthetic} order by s) as rs from spans group by doc_id)
      select d.doc_id, case when o.ss is null then text else array_to_string(list_transform(range(1, len(ss) + 1), lambda i: substr(text, case when i = 1 then 1 else es[i-1] + 1 end, ss[i] - case when i = 1 then 0 else es[i-1] end) || rs[i]), '') || substr(text, es[len(es)] + 1) end as replaced
      from documents d left join o using (doc_id)"""


@query(_replaced_sql("'[REDACTED_' || upper(label) || ']'"))
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace.replace(_found(spark, sf_dir), replace.Redact()).select("doc_id", F.col(schemas.OUTPUT).alias("replaced"))


@query(_replaced_sql("'<HASH_' || upper(label) || '_' || substr(sha256(value), 1, 12) || '>'"))
def hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace.replace(_found(spark, sf_dir), replace.Hash()).select("doc_id", F.col(schemas.OUTPUT).alias("replaced"))


@query(_replaced_sql("'<' || value || ', ' || label || '>'"))
def annotate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace.replace(_found(spark, sf_dir), replace.Annotate()).select("doc_id", F.col(schemas.OUTPUT).alias("replaced"))


@query(f"{_RESOLVED} select distinct doc_id, value as original, label, '[REDACTED_' || upper(label) || ']' as synthetic from spans")
def replacement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _each(_found(spark, sf_dir), replace.replacement_map(F.col(schemas.FINAL), replace.Redact()), "p")
    return out.select("doc_id", "p.original", "p.label", "p.synthetic")


def _partial_map() -> Column:
    """A map without the values of an odd length, whose synthetic values are sometimes the originals."""
    keep = F.filter(schemas.FINAL, lambda e: F.length(e["value"]) % 2 == 0)
    return F.transform(keep, lambda e: F.struct(e["value"].alias("original"), e["label"].alias("label"), F.when(F.length(e["value"]) % 4 == 0, e["value"]).otherwise("x").alias("synthetic")))


@query(f"{_RESOLVED} select doc_id, count(*) as missing, count(distinct value) as missing_values from spans where length(value) % 2 = 1 group by doc_id")
def replacement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.replacement_metrics(F.col("pairs"), F.col(schemas.FINAL))
    out = _found(spark, sf_dir).withColumn("pairs", _partial_map()).select("doc_id", m["replacement_missing_final_entity_count"].cast("long").alias("missing"), m["replacement_missing_final_value_count"].cast("long").alias("missing_values"))
    return _above_0(out, "missing")


@query(f"{_RESOLVED} select doc_id, count(*) as collisions, count(distinct value) as collided_values from spans where length(value) % 4 = 0 group by doc_id")
def replacement_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.replacement_metrics(F.col("pairs"), F.col(schemas.FINAL))
    out = _found(spark, sf_dir).withColumn("pairs", _partial_map()).select("doc_id", m["replacement_synthetic_original_collision_count"].cast("long").alias("collisions"), m["replacement_synthetic_original_collision_value_count"].cast("long").alias("collided_values"))
    return _above_0(out, "collisions")


@query(f"{_RESOLVED} select doc_id, count(*) as leaks from spans s join documents d using (doc_id) where contains(d.text, s.value) and not regexp_full_match(value, '[0-9]+') and length(value) > 4 group by doc_id")
def value_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values still in a text that wasn't changed (those that need no boundaries)."""
    plain = F.filter(schemas.FINAL, lambda e: ~e["value"].rlike("^[0-9]+$"))
    out = _found(spark, sf_dir).withColumn("plain", plain)
    return _above_0(out.select("doc_id", metrics.leaks(F.col(schemas.TEXT), F.col("plain"))["original_value_leak_count"].cast("long").alias("leaks")), "leaks")


@query(f"{_RESOLVED} select doc_id, value as original, case when length(value) % 4 = 0 then '[SUBSTITUTE_' || upper(label) || '_' || row_number() over (partition by doc_id, label, length(value) % 4 = 0 order by s) || ']' else 'x' end as synthetic from (select doc_id, value, label, min(s) as s from spans group by doc_id, value, label) where length(value) % 2 = 0")
def substitute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _found(spark, sf_dir).withColumn("pairs", _partial_map())
    kept = out.select("doc_id", F.explode(replace.requested_pairs(F.col("pairs"), F.col(schemas.BY_VALUES))).alias("p"))
    return kept.select("doc_id", "p.original", "p.synthetic")


# ---------------------------------------------------------------- scalars and metrics


@query("select doc_id, case when n < 1 then '0' when n < 128 then '1-127' when n < 512 then '128-511' when n < 2048 then '512-2047' when n < 8192 then '2048-8191' else '8192+' end as bucket from (select doc_id, length(text) as n from documents)")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.size_bucket(F.length(schemas.TEXT)).alias("bucket"))


@query("select lang, avg(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) as avg_tokens, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) as tokens from documents group by lang")
def average_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _table(spark, sf_dir, "documents").select("lang", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    return counted.groupBy("lang").agg(F.avg("n").alias("avg_tokens"), F.sum("n").alias("tokens"))


@query(f"{_RESOLVED} select label, count(*) as n, count(distinct value) as n_values from spans group by label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    counts = found.select(F.explode(metrics.label_counts(F.col(schemas.FINAL))).alias("label", "k")).groupBy("label").agg(F.sum("k").alias("n"))
    values = _exploded(found).groupBy("label").agg(F.countDistinct("value").alias("n_values"))
    return counts.join(values, "label")


@query("select doc_id, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}')), 1, 12) as head, '5' as version from documents")
def record_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _table(spark, sf_dir, "documents").select("doc_id", text.record_id("doc_id", "source").alias("r"))
    return made.select("doc_id", F.substring("r", 1, 12).alias("head"), F.substring("r", 13, 1).alias("version"))


_PAD = lambda b: "".join(f"{x ^ b:02x}" for x in b"run-key".ljust(64, b"\0"))


@query(f"select doc_id, sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(text)))) as hash from documents")
def record_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.keyed_hash(F.col(schemas.TEXT), b"run-key").alias("hash"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found: the rules' spans; expected: those of an even start, and one more."""
    even = F.filter(schemas.FINAL, lambda e: e["start_position"] % 2 == 0)
    extra = F.array(spans.span(F.lit("zz"), F.lit("city"), F.lit(1), F.lit(3), F.lit(1.0), "truth"))
    return _found(spark, sf_dir).withColumn("expected", F.concat(even, extra))


_PRF = f"""{_RESOLVED}, f as (select doc_id, value, label, count(*) as p, count_if(s % 2 = 0) as g from spans group by doc_id, value, label),
  t as (select doc_id, sum(least(p, g)) as tp, sum(p) as p, sum(g) as g from f group by doc_id)"""


@query(f"{_PRF} select d.doc_id, cast(coalesce(tp, 0) as integer) as tp, cast(coalesce(p - tp, 0) as integer) as fp, cast(coalesce(g - tp, 0) + 1 as integer) as fn, case when p > 0 then round(tp / p, 9) end as precision, round(coalesce(tp, 0) / (coalesce(g, 0) + 1), 9) as recall from documents d left join t using (doc_id)")
def entity_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    counted = _truth(spark, sf_dir).withColumn("c", metrics.strict_counts(F.col(schemas.FINAL), F.col("expected")))
    return counted.select("doc_id", "c.tp", "c.fp", "c.fn", F.round(text.ratio(c["tp"], c["tp"] + c["fp"]), 9).alias("precision"), F.round(text.ratio(c["tp"], c["tp"] + c["fn"]), 9).alias("recall"))


@query(f"{_RESOLVED} select d.doc_id, count(case when s % 2 = 0 then 1 end) as matched, count(case when s % 2 = 0 then 1 end) as matched_alike from documents d left join spans s using (doc_id) group by d.doc_id")
def relaxed_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest matching of found and expected spans (here: resolved, so each overlaps its own only)."""
    far = F.transform("expected", lambda e: F.when(e["value"] == "zz", spans.span(e["value"], e["label"], F.lit(1 << 30), F.lit((1 << 30) + 2), F.lit(1.0), "truth")).otherwise(e))
    rows = _truth(spark, sf_dir).withColumn("expected", far)
    return rows.select("doc_id", metrics.relaxed_count(F.col(schemas.FINAL), F.col("expected")).alias("matched"), metrics.relaxed_count(F.col(schemas.FINAL), F.col("expected"), True).alias("matched_alike"))


@query("select o_orderkey as id, cast(2 + case when k <= 0 then 0 else ceil(k / 7.0) end as integer) as entity_detection, case when k > 0 then 1 else 0 end as replace_map_generation, case when k > 0 then 5 else 0 end as rewrite_pipeline, case when k > 0 then 3 * (1 + k % 3) else 0 end as rewrite_evaluate, case when k > 0 then k % 3 else 0 end as rewrite_repair from (select o_orderkey, cast(o_custkey % 40 as integer) as k from orders)")
def model_call_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_custkey") % 40).cast("int")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), k.alias("k"))
    calls = metrics.model_calls("rewrite", "substitute", F.col("k") > 0, metrics.validation_chunks(F.col("k"), 7), F.col("k") % 3)
    return rows.select("id", *(calls[n].cast("int").alias(n) for n in ("entity_detection", "replace_map_generation", "rewrite_pipeline", "rewrite_evaluate", "rewrite_repair")))


@query(f"{_RESOLVED} select doc_id, count(*) as final_entity_count, count_if(length(value) % 2 = 1) as new_values, count_if(label = 'api_key' and not (length(value) >= 20 and regexp_matches(value, '[A-Za-z]') and regexp_matches(value, '[0-9]'))) as weak_keys from spans group by doc_id")
def artifact_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.filter(schemas.FINAL, lambda e: F.length(e["value"]) % 2 == 0)
    rows = _found(spark, sf_dir).withColumn("seed", even).filter(F.size(schemas.FINAL) > 0)
    out = artifacts.artifact_rows(rows, "doc_id", "seed", schemas.FINAL, schemas.FINAL)
    return out.select("doc_id", F.col("final_entity_count").cast("long").alias("final_entity_count"), F.col("augmented_new_value_count").cast("long").alias("new_values"), F.col("weak_api_key_shape_count").cast("long").alias("weak_keys"))


@query(f"{_RESOLVED} select doc_id, substr(sha256('{{\"end\": ' || e || ', \"label\": \"' || label || '\", \"row\": ' || doc_id || ', \"start\": ' || s || '}}'), 1, 16) as signature from spans")
def entity_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", F.explode(F.transform(schemas.FINAL, lambda e: artifacts.signature(e, F.col("doc_id")))).alias("signature"))


@query(f"{_RESOLVED} select doc_id, length(text) as text_length_chars, coalesce(n, 0) as final_entity_count, coalesce(v, 0) as replacement_count, 0 as missing from documents left join (select doc_id, count(*) as n, count(distinct (value, label)) as v from spans group by doc_id) using (doc_id)")
def record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace.replace(_found(spark, sf_dir), replace.Redact()).withColumn(schemas.RECORD_ID, F.col("doc_id"))
    m = metrics.record_metrics(done)
    long = lambda c, a: F.col(c).cast("long").alias(a)
    return m.select(F.col(schemas.RECORD_ID).alias("doc_id"), *(long(c, c) for c in ("text_length_chars", "final_entity_count", "replacement_count")), F.col("replacement_missing_final_entity_count").alias("missing"))


# ---------------------------------------------------------------- rewriting


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, answers and scores of each order, from its lines (distinct by number)."""
    level = lambda c: F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (c % 3 + 1).cast("int"))
    q = F.struct(F.col("n").alias("id"), F.lit("?").alias("question"), level(F.col("sk")).alias("sensitivity"), F.lit("name").alias("entity_label"), F.col("pk").cast("string").alias("entity_value"), F.lit("direct").alias("category"))
    a = F.struct(F.col("n").alias("id"), F.when(F.col("pk") % 3 == 0, "yes").otherwise("no").alias("answer"), (F.col("q") % 5 / 4).alias("confidence"), F.lit("r").alias("reason"), F.array().cast("array<string>").alias("evidence"))
    s = F.struct(F.col("n").alias("id"), (F.col("pk") % 5 / 4).alias("score"), F.lit("r").alias("reason"))
    i = F.struct(F.col("n").alias("id"), F.when(F.col("sk") % 2 == 0, "critical").otherwise("important").alias("importance"))
    rows = _lines(spark, sf_dir).groupBy("id").agg(*(F.sort_array(F.collect_list(c)).alias(n) for n, c in (("questions", q), ("answers", a), ("scores", s), ("items", i))))
    return rows.withColumn("importance", F.transform("items", lambda x: x["importance"]))


_W = "case sk % 3 when 0 then 1.0 when 1 then 0.6 else 0.3 end"
_RW = f"""with r as (select l_orderkey as id, l_linenumber as n, pk, sk, q from ({_LINES})),
  t as (select id, sum(case when sk % 2 = 0 then 2.0::double else 1.0::double end * (pk % 5 / 4)) / sum(case when sk % 2 = 0 then 2.0::double else 1.0::double end) as utility,
    sum(case when pk % 3 = 0 then cast({_W} as double) * (q % 5 / 4) else 0 end) as mass, sum(cast({_W} as double)) as most, bool_or(pk % 3 = 0 and sk % 3 = 0) as high from r group by id)"""


@query(f"{_RW} select id, round(utility, 6) as utility_score from t")
def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("id", F.round(rewrite.utility_score(F.transform("scores", lambda s: s["score"]), F.col("importance")), 6).alias("utility_score"))


@query(f"{_RW} select id, round(mass, 6) as leakage_mass, high as any_high_leaked from t")
def leakage_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.col("questions"), F.col("answers")
    return _answers(spark, sf_dir).select("id", F.round(rewrite.leakage_mass(a, q), 6).alias("leakage_mass"), rewrite.any_high_leaked(a, q).alias("any_high_leaked"))


@query(f"{_RW} select id, round(mass / most + 1e-9, 6) as weighted_leakage_rate from t")
def weighted_leakage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("m", rewrite.leakage_mass(F.col("answers"), F.col("questions")))
    return rows.select("id", F.round(rewrite.weighted_leakage_rate(F.col("m"), F.col("questions")) + 1e-9, 6).alias("weighted_leakage_rate"))


@query(f"{_RW} select id, high or round(mass, 9) > 1.0 as needs_repair, high or round(mass, 9) > 2.0 or round(utility, 9) < 0.5 as needs_review from t")
def repair_and_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rewrite.score_rows(_answers(spark, sf_dir), rewrite.TOLERANCES["low"], "scores", "importance", "answers", "questions")
    mass, utility = F.round("leakage_mass", 9), F.round("utility_score", 9)
    low = rewrite.TOLERANCES["low"]
    return scored.select("id", rewrite.needs_repair(F.col("any_high_leaked"), mass, low).alias("needs_repair"), rewrite.needs_review(F.lit("x"), F.col("any_high_leaked"), utility, mass, low).alias("needs_review"))


@query(f"with r as (select l_orderkey as id, l_linenumber as n, pk from ({_LINES})), x as (select id, unnest(range(1, 8)) as n from (select distinct id from r)) select x.id, cast(x.n as integer) as n, case when r.pk is null then 'yes' when r.pk % 3 = 0 then 'yes' else 'no' end as answer from x left join r using (id, n)")
def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each of the ids 1 to 7, those that are missing as leaks."""
    rows = _answers(spark, sf_dir)
    full = rewrite.sorted_answers(F.col("answers"), F.sequence(F.lit(1), F.lit(7)), rewrite.assumed_leak)
    return rows.select("id", F.explode(full).alias("a")).select("id", F.col("a.id").alias("n"), F.col("a.answer").alias("answer"))


@query(f"select id, cast(row_number() over (partition by id order by n) as integer) as n, 'Could a stranger who reads only the new text name the name ''' || pk || '''?' as question from (select l_orderkey as id, l_linenumber as n, pk, sk from ({_LINES})) where sk % 4 <> 0")
def privacy_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.struct(F.col("n").alias("id"), F.lit("x").alias("source"), F.lit("direct").alias("category"), F.lit("high").alias("sensitivity"), F.lit("name").alias("entity_label"), F.col("pk").cast("string").alias("entity_value"), F.lit("r").alias("protection_reason"), F.when(F.col("sk") % 4 == 0, "leave_as_is").otherwise("replace").alias("protection_method_suggestion"), F.lit("high").alias("combined_risk_level"))
    rows = _lines(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list(d)).alias("d"))
    return rows.select("id", F.explode(rewrite.privacy_questions(F.col("d"))).alias("q")).select("id", F.col("q.id").alias("n"), F.col("q.question").alias("question"))


@query("select doc_id, case when doc_id % 3 = 0 then text else text || '!' end as output, case when doc_id % 3 = 0 then 1.0::double else 0.25::double end as utility_score, doc_id % 3 <> 0 as needs_human_review from documents")
def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumns({"output": F.concat(schemas.TEXT, F.lit("!")), "utility_score": F.lit(0.25), "needs_human_review": F.lit(True)})
    return rewrite.pass_through(rows, F.col("doc_id") % 3 != 0, schemas.TEXT, "output").select("doc_id", "output", "utility_score", "needs_human_review")


# ---------------------------------------------------------------- models and judges


@query(f"select doc_id, v.value as original, '<' || upper(v.value) || '>' as synthetic from (select distinct doc_id, value from ({_sql_spans('email')})) v")
def model_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutes from a (deterministic) model, asked only where there are entities."""
    found = _found(spark, sf_dir, "email")
    pairs = F.transform(schemas.BY_VALUES, lambda v: F.struct(v["value"].alias("original"), F.lit("email").alias("label"), F.concat(F.lit("<"), F.upper(v["value"]), F.lit(">")).alias("synthetic")))
    asked = found.select("doc_id", schemas.BY_VALUES, F.concat(F.lit("Replace. ANSWER:"), F.to_json(F.struct(pairs.alias("replacements")))).alias("prompt")).withColumn("some", F.size(schemas.BY_VALUES) > 0)
    kind = schemas._struct(replacements=schemas.T.ArrayType(schemas.REPLACEMENT))
    got = model.model_column(asked, "prompt", "answer", kind, when="some")
    out = got.select("doc_id", F.explode(replace.requested_pairs(F.col("answer.replacements"), F.col(schemas.BY_VALUES))).alias("p"))
    return out.select("doc_id", "p.original", "p.synthetic")


@query("select doc_id as record_id, 'rewrite' as step from documents where doc_id % 7 = 3")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias(schemas.RECORD_ID))
    return model.missing_records(ids, ids.filter(f"{schemas.RECORD_ID} % 7 <> 3"), "rewrite").select("record_id", "step")


@query("select d.doc_id, quality, coalesce(toxic, -1) as toxic from documents d left join labels using (doc_id)")
def join_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return joins.join_keeping(docs, _table(spark, sf_dir, "labels"), "doc_id", {"toxic": F.lit(-1)}).select("doc_id", "quality", "toxic")


@query("select d.doc_id, d.lang, quality, toxic from documents d join labels using (doc_id)")
def join_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.join_new(docs, _table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("select doc_id, case when q is null then null when q = 1 then true else false end as detection_valid, case when q = 0 then 1 else 0 end as bad from (select d.doc_id, max(quality) as q from documents d left join labels using (doc_id) group by d.doc_id)")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as judges' answers: none is no verdict, 0 a bad item."""
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = _table(spark, sf_dir, "documents").select("doc_id").distinct().join(labels, "doc_id", "left")
    answer = F.when(F.col("q") == 1, '{"all_valid":true,"items":[]}').when(F.col("q") == 0, '{"all_valid":false,"items":[{"value":"v","label":"l","reason":"r"}]}').otherwise("not json")
    some = F.array(F.struct(F.lit("v").alias("value"), F.array(F.lit("l")).alias("labels")))
    settled = judge.settle(rows.withColumn("raw", answer).withColumn(schemas.BY_VALUES, some), judge.JUDGES["detection"], "raw")
    return settled.select("doc_id", "detection_valid", F.size("detection_invalid").alias("bad"))


@query("select o_orderkey as id, case when v is null then null when v then 1.0 when t = 0 or b = 0 then null else round(greatest(0.0, (t - b) / t::double), 6) end as fraction, case when v is null then 'Unavailable' when t = 0 and v then 'Satisfied' when not v and b = 0 then 'Not Satisfied' when b <= 0 then 'Satisfied' when t - b = 0 then 'Not Satisfied' else 'Partially Satisfied' end as badge from (select o_orderkey, case o_orderkey % 3 when 0 then true when 1 then false end as v, cast(o_custkey % 5 as integer) as t, least(cast(o_custkey % 7 as integer), cast(o_custkey % 5 as integer)) as b from orders)")
def verdict_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.col("o_custkey") % 5).cast("int")
    b = F.least((F.col("o_custkey") % 7).cast("int"), t)
    v = F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(judge.valid_fraction(v, b, t), 6).alias("fraction"), judge.badge(v, t - b, t).alias("badge"))


# ---------------------------------------------------------------- roll-ups


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurement records: a case a user, a record an event."""
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    from .sources.records import MEASUREMENT

    name = F.element_at(F.array(*map(F.lit, ("record", "stage", "ndd_workflow", "evaluation_record"))), (k % 4 + 1).cast("int"))
    is_ = lambda n: k % 4 == n
    config = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")))
    values = {
        "record_type": name, "run_id": F.concat(F.lit("run"), F.col("user_id").cast("string")),
        "run_tags": F.struct(F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")).alias("workload_id"), config.alias("config_id")),
        "stage": F.when(is_(1), F.lit(analysis.PIPELINE)), "workflow_name": F.when(is_(2), F.lit("detect")), "status": F.when(F.col("event_type") == "error", "ERROR").otherwise("completed"), "elapsed_sec": F.when(is_(1) | is_(2), F.floor("value") + 1.0),
        "text_length_tokens": F.when(is_(0), k % 100), "final_entity_count": F.when(is_(0), k % 8), "ground_truth_entity_count": F.when(is_(0) & (k % 3 > 0), k % 7),
        "entity_true_positive_count": F.when(is_(0), k % 5), "entity_false_positive_count": F.when(is_(0), k % 3), "entity_false_negative_count": F.when(is_(0), k % 2),
        "original_value_leak_count": F.when(is_(0), k % 16), "original_value_leak_label_counts": F.when(is_(0), F.create_map(F.col("event_type"), k % 6)),
        "observed_total_requests": F.when(is_(2), k % 9), "observed_failed_requests": F.when(is_(2), k % 4), "observed_total_tokens": F.when(is_(2), k),
        "detection_valid": F.when(is_(3) & (k % 3 > 0), k % 3 == 1), "detection_invalid_entity_count": F.when(is_(3), k % 3),
        "model_usage": F.when(is_(2), F.create_map(F.col("event_type"), F.struct(F.lit("a").alias("model_alias"), F.struct((k % 4).alias("failed_requests"), (k % 9).alias("total_requests")).alias("request_usage"), F.struct(k.alias("total_tokens")).alias("token_usage")))),
    }

    def fitted(field) -> Column:
        kind = field.dataType.simpleString()
        if field.name not in values:
            return F.lit(None).cast(kind).alias(field.name)
        if field.name in ("run_tags", "model_usage"):  # missing members are null
            return F.from_json(F.to_json(values[field.name]), kind).alias(field.name)
        return values[field.name].cast(kind).alias(field.name)

    return e.select(*map(fitted, MEASUREMENT.fields))


_EVENTS = "select *, event_id as k, event_id % 4 as t, 'run' || user_id as case_id, floor(value) + 1.0::double as sec from events"
_CASES = f"""with m as ({_EVENTS}), c as (select case_id, any_value('w' || (user_id % 3)) as workload_id, any_value(case when user_id % 5 > 0 then 'c' || (user_id % 5) end) as config_id, count_if(t = 0) as record_count,
  cast(sum(case when t = 0 then k % 100 end) as bigint) as input_text_tokens_total, sum(case when t = 1 then sec end) as pipeline_elapsed_sec, count_if(t = 2 and event_type = 'error') as error_ndd_workflow_count,
  count_if((t = 1 or t = 2) and event_type = 'error') > 0 as case_failed, cast(sum(case when t = 0 then k % 8 end) as bigint) as final_entity_count, count_if(t = 0 and k % 8 = 0) as empty_detection_count,
  cast(sum(case when t = 0 then k % 5 end) as bigint) as tp, cast(sum(case when t = 0 then k % 3 end) as bigint) as fp, cast(sum(case when t = 0 then k % 2 end) as bigint) as fn,
  cast(coalesce(sum(case when t = 2 then k % 9 end), 0) as bigint) as observed_total_requests, cast(coalesce(sum(case when t = 2 then k % 4 end), 0) as bigint) as observed_failed_requests,
  count_if(t = 3 and k % 3 > 0) as detection_judged_record_count, count_if(t = 3 and k % 3 = 1) as detection_valid_record_count, cast(sum(case when t = 0 then k % 16 end) as bigint) as leaks from m group by case_id)"""


@query(
    f"""{_CASES} select case_id, workload_id, config_id, record_count, input_text_tokens_total, pipeline_elapsed_sec, error_ndd_workflow_count, case_failed, final_entity_count, empty_detection_count, observed_total_requests,
    case when observed_total_requests > 0 then round(observed_failed_requests / observed_total_requests, 9) end as observed_failed_request_rate, case when tp + fp > 0 then round(tp / (tp + fp), 9) end as entity_precision,
    case when detection_judged_record_count > 0 then round(detection_valid_record_count / detection_judged_record_count, 9) end as detection_valid_rate from c"""
)
def case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.case_rows(_measurements(spark, sf_dir))
    rounded = [F.round(c, 9).alias(c) for c in ("observed_failed_request_rate", "entity_precision", "detection_valid_rate")]
    return out.select("case_id", "workload_id", "config_id", "record_count", "input_text_tokens_total", "pipeline_elapsed_sec", "error_ndd_workflow_count", "case_failed", "final_entity_count", "empty_detection_count", "observed_total_requests", *rounded)


@query(
    f"""{_CASES} select workload_id, config_id, count(distinct case_id) as case_count, count_if(case_failed) as failed_case_count, cast(sum(record_count) as bigint) as total_record_count, median(pipeline_elapsed_sec) as median_pipeline_elapsed_sec,
    median(final_entity_count) as median_final_entity_count, cast(sum(tp) as bigint) as sum_entity_true_positive_count, round(sum(tp) / (sum(tp) + sum(fn)), 9) as micro_entity_recall, count_if(leaks > 0) as leaking_case_count from c group by workload_id, config_id"""
)
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.group_rows(analysis.case_rows(_measurements(spark, sf_dir)))
    return out.select("workload_id", "config_id", "case_count", "failed_case_count", "total_record_count", "median_pipeline_elapsed_sec", "median_final_entity_count", "sum_entity_true_positive_count", F.round("micro_entity_recall", 9).alias("micro_entity_recall"), "leaking_case_count")


@query(
    f"""with m as ({_EVENTS}) select 'w' || (user_id % 3) as workload_id, event_type as model_name, count(distinct case_id) as case_count, count(*) as workflow_count, cast(sum(k % 9) as bigint) as requests,
    case when sum(k % 9) > 0 then round(sum(k % 4) / sum(k % 9), 9) end as failed_rate, median(k % 9) as median_requests from m where t = 2 and (k % 9 > 0 or k % 4 > 0 or k > 0) group by 1, 2"""
)
def model_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = analysis.usage_rows(_measurements(spark, sf_dir)).withColumn("config_id", F.lit(None).cast("string"))
    out = analysis.usage_group_rows(usage)
    return out.select("workload_id", "model_name", "case_count", "workflow_count", F.col("sum_observed_total_requests").alias("requests"), F.round("observed_failed_request_rate", 9).alias("failed_rate"), F.col("median_observed_total_requests").alias("median_requests"))


@query(f"with m as ({_EVENTS}) select case_id, event_type as label, cast(sum(k % 6) as bigint) as n from m where t = 0 group by case_id, event_type having sum(k % 6) <> 0")
def count_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.case_rows(_measurements(spark, sf_dir))
    return out.select("case_id", F.explode("original_value_leak_label_counts").alias("label", "n"))


@query("select user_id, median(value) as median_value, sum(case when event_type = 'error' then 1 end) as errors, case when count(*) > 0 then round(count_if(event_type = 'error') / count(*), 9) end as rate from events group by user_id")
def median_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    error, events = F.col("event_type") == "error", _table(spark, sf_dir, "events")
    sums = [F.sum(F.when(error, F.lit(1))).alias("errors"), F.round(text.ratio(F.count_if(error), F.count(F.lit(1))), 9).alias("rate")]
    return medians.rolled_up(events, ["user_id"], sums, ["value"], tables.kept)


_PRICED = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"select l_returnflag, {', '.join(f'median(cast({c} as double)) as median_{c}' for c in _PRICED)} from lineitem group by l_returnflag")
def median_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a few large groups, none of which a task holds: parts of 1,000 values at most are put in order."""
    return medians.medians(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], _PRICED, tables.kept, most=1000, parts=64)


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.concat(F.lit("rewrite-repair-"), (F.col("event_id") % 4).cast("string"))
    kinds = F.when(F.col("event_type") == "error", step).when(F.col("event_type") == "click", "entity-detection").otherwise("elsewhere")
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("record_id"), kinds.alias("step"), F.lit("r").alias("reason"))


@query("select count_if(event_type = 'click') as detection, count_if(event_type = 'error') as repair, count_if(event_type not in ('click', 'error')) as other from events")
def failure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.failure_counts(_failed(spark, sf_dir)).select("detection", "repair", "other")


@query("select count(distinct event_id % 4) as repair_rounds from events where event_type = 'error'")
def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.repair_rounds(_failed(spark, sf_dir))


@query("select r_name as workload, n_name as config from region cross join nation")
def workload_cross_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.grid(_table(spark, sf_dir, "region").select(F.col("r_name").alias("workload")), _table(spark, sf_dir, "nation").select(F.col("n_name").alias("config")))


@query(f"select conv_id, turn, regexp_replace(regexp_replace(text, '{EMAIL}', '[REDACTED_EMAIL]', 'g'), '{CARD}', '[REDACTED_CREDIT_DEBIT_CARD]', 'g') as replaced from conversations")
def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").withColumnRenamed("text", schemas.TEXT)
    found = detect.detect(rows, labels=["email", "credit_debit_card"]).withColumn(schemas.FINAL, F.col(schemas.ENTITIES))
    return replace.replace(found, replace.Redact()).select("conv_id", "turn", F.col(schemas.OUTPUT).alias("replaced"))


@query(_replaced_sql("'[REDACTED_' || upper(label) || ']'"))
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of the documents is written as, redacted; the SQL is that of the batch."""
    from .streaming.stream import redact_stream

    return redact_stream(spark, f"{sf_dir}/documents.parquet", "doc_id").select("doc_id", "replaced")


from . import asking_queries, reading_queries, run_queries, stage_queries  # noqa: E402, F401
