"""More registered queries: single functions of the stages, of scores and of records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import spans, text
from .operators import analysis, detect, judge, metrics, replace, rewrite
from .plans import columns, domains, prompts
from .queries import _LINES, _PRF, _RESOLVED, _RW, _SPAN_SQL, _above_0, _answers, _decisions, _docs, _each, _found, _line_spans, _lines, _needle_sql, _sql_spans, _table, _truth, query


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---------------------------------------------------------------- detection


@query(_needle_sql("and"))
def augmented_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggested value at all its occurrences; suggestions without a value or a label count for nothing."""
    made = F.array(*(F.struct(F.lit(v).alias("value"), F.lit(k).alias("label"), F.lit("r").alias("reason")) for v, k in ((" And ", " conjunction"), ("  ", "blank"), ("the", " "))))
    found = _docs(spark, sf_dir).withColumn("all", spans.add_suggestions(F.col(schemas.TEXT), spans.no_spans(), made))
    return _each(found, "all", "e").select("doc_id", F.col("e.start_position").alias("start"))


@query(f"select id, label, s from (select id, label, s, row_number() over (partition by id, s % 5 order by n) as k from ({_SPAN_SQL})) where k = 1")
def first_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of each value, which is there in capitals and small letters."""
    value = lambda e: F.concat(F.when(e["start_position"] % 2 == 0, "Val").otherwise("vAL"), (e["start_position"] % 5).cast("string"))
    named = _line_spans(spark, sf_dir).withColumn("spans", F.transform("spans", lambda e: spans.span(value(e), e["label"], e["start_position"], e["end_position"], e["score"], "detector")))
    out = named.select("id", F.explode(spans.first_of_value(F.col("spans"))).alias("e"))
    return out.select("id", F.col("e.label").alias("label"), F.col("e.start_position").alias("s"))


@query(f"select id, cast(s + 7 as integer) as s, cast(e + 7 as integer) as e, label || '_' || (s + 7) || '_' || (e + 7) as name from ({_SPAN_SQL})")
def shifted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line_spans(spark, sf_dir).select("id", F.explode(spans.shifted(F.col("spans"), F.lit(7))).alias("e"))
    return out.select("id", F.col("e.start_position").alias("s"), F.col("e.end_position").alias("e"), F.col("e.id").alias("name"))


@query(
    f"""with r as (select id, label || '_' || s || '_' || e as name, s, e, n from ({_SPAN_SQL})), c as (select r.id, name, arg_max('v' || pk, r.n) as value from r join ({_LINES}) l on l.l_orderkey = r.id and l.l_linenumber = r.n group by r.id, name)
    select distinct r.id, r.name, c.value, list_value('none', 'keep', 'reclass', 'drop')[(s + k) % 4 + 1] as decision from r join c on c.id = r.id and c.name = r.name, (values (0), (1)) as t(k) where k = 0 or e % 5 = 0"""
)
def decisions_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beside decisions; one of an unknown id is left out."""
    stranger = F.array(F.struct(F.lit("nobody_0_1").alias("id"), F.lit("drop").alias("decision"), F.lit("").alias("proposed_label"), F.lit("r").alias("reason")))
    rows = _line_spans(spark, sf_dir).withColumn("decisions", F.concat(_decisions(), stranger)).withColumn("candidates", F.transform("spans", lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"), e["label"].alias("label"))))
    out = rows.select("id", F.explode(spans.enrich_decisions(F.col("decisions"), F.col("candidates"))).alias("d"))
    return out.select("id", F.col("d.id").alias("name"), F.col("d.value").alias("value"), F.col("d.decision").alias("decision")).distinct()


_RAW = (
    '{"entities": [{"text": " Ann ", "label": "name", "start": 0, "end": 3, "score": 0.5}]}',
    '{"entities": [{"text": "Ann", "label": "name", "start": "0", "end": "3", "score": "0.5"}, 7, null, {"text": "", "label": "x", "start": 0, "end": 1}]}',
    '{"entities": {"text": "Ann"}}',
    "not JSON",
    '{"entities": [{"text": "Ann", "label": "name", "start": -1, "end": 3}, {"text": "Ann", "label": "name", "start": 3, "end": 3}, {"text": "Ann", "label": "name", "start": 0, "end": 99999999}]}',
    '{"entities": [{"text": "Ann", "label": "name", "start": 0, "end": 3}, {"text": "Anne", "label": "name", "start": 0, "end": 4}]}',
    "{}",
)
_RAW_COUNT = (1, 1, 0, 0, 0, 1, 0)


@query(f"select doc_id, cast(case when length(text) >= 4 then list_value{_RAW_COUNT}[doc_id % 7 + 1] else 0 end as integer) as n from documents where length(text) >= 4")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed, ill-formed and overlapping answers of a detector."""
    rows = _docs(spark, sf_dir).filter(F.length(schemas.TEXT) >= 4).withColumn(schemas.RAW, F.element_at(F.array(*map(F.lit, _RAW)), (F.col("doc_id") % 7 + 1).cast("int")))
    return columns.step("parse-raw")(rows).select("doc_id", F.size(schemas.ENTITIES).alias("n"))


@query(f"{_RESOLVED} select doc_id, count(*) as n from spans group by doc_id")
def steps_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's JSON answer parsed, and candidates made of it, by named steps."""
    rows = _docs(spark, sf_dir).withColumn(schemas.RAW, detect.rule_answer(F.col(schemas.TEXT)))
    out = columns.apply_steps(rows, ["parse-raw", ("candidates", {"window": 8})]).select("doc_id", F.size("_hf_candidates").cast("long").alias("n"))
    return _above_0(out, "n")


@query(f"{_RESOLVED} select distinct doc_id, value, label from spans")
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _found(spark, sf_dir).select("doc_id", F.explode(judge.judged_entities(F.col(schemas.BY_VALUES))).alias("e"))
    return out.select("doc_id", F.col("e.value").alias("value"), F.col("e.label").alias("label"))


@query(f"select doc_id, s, cast(s + coalesce(sum(16 - length(value)) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding), 0) as integer) as placed from ({_sql_spans('email')})")
def synthetic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the replacements of e-mail addresses stand in the replaced text."""
    done = replace.replace(_found(spark, sf_dir, "email"), replace.Redact())
    both = done.withColumn("there", replace.placed(F.col(schemas.FINAL), F.col(schemas.MAP), F.col(schemas.OUTPUT)))
    out = both.select("doc_id", F.explode(F.arrays_zip(F.col(schemas.FINAL).alias("e"), F.col("there").alias("t"))).alias("p"))
    return out.select("doc_id", F.col("p.e.start_position").alias("s"), F.col("p.t.start_position").alias("placed"))


# ---------------------------------------------------------------- domains and prompts

_DOMAIN = "case lang when 'en' then 'LEGAL' when 'de' then 'medical_clinical' when 'fr' then 'NO_SUCH' end"


def _guidance_sql(at: int) -> str:
    of = lambda k: _sql_text(domains.DOMAINS[k][at] if at < len(domains.DOMAINS[k]) else domains.DOMAINS[k][1])
    return f"case lang when 'en' then {of('LEGAL')} when 'de' then {of('MEDICAL_CLINICAL')} else {of('OTHER')} end"


@query(f"select doc_id, {_guidance_sql(1)} as quality, {_guidance_sql(2)} as privacy from documents")
def domain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rewrite keeps and hides, by domain in any case; unknown domains and none are the last."""
    rows = _table(spark, sf_dir, "documents").withColumn("domain", F.expr(_DOMAIN))
    return rows.select("doc_id", domains.quality_guidance(F.col("domain")).alias("quality"), domains.privacy_guidance(F.col("domain")).alias("privacy"))


@query("select doc_id, 'In ' || coalesce(lang, '') || ' from <<SOURCE>>: ' || coalesce(source, '') || '.' as prompt from documents")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places are filled once: what is filled in isn't looked at again."""
    lang = F.concat(F.col("lang"), F.lit(" from <<SOURCE>>"))
    rows = _table(spark, sf_dir, "documents")
    made = prompts.fill_columns("In <<LANG>>: <<SOURCE>>.", {"LANG": F.coalesce(lang, F.lit(" from <<SOURCE>>")), "SOURCE": F.col("source")})
    return rows.select("doc_id", made.alias("prompt"))


# ---------------------------------------------------------------- metrics

_NAMES = {" API_Key ": "access_token", "phone": "phone", "Email_Address": "email", "city": "city", "session_cookie": "cookie", "USER": "full_name", " ": None}


@query("select n_nationkey as k, name, key from nation, (values " + ", ".join(f"({_sql_text(a)}, {_sql_text(b) if b else 'null'})" for a, b in _NAMES.items()) + ") as t(name, key)")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.array(*map(F.lit, _NAMES))).alias("name"))
    key = metrics.label_key(F.col("name"))
    return rows.select("k", "name", F.when(key != "", key).alias("key"))


@query("select id, cast(least(a, b) as bigint) as matched, cast(greatest(least(a, b - 1), 0) as bigint) as matched_alike from (select o_orderkey as id, o_custkey % 5 as a, o_orderkey % 6 as b from orders)")
def chain_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of spans in which each overlaps two: taking the first that fits would leave some without."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).cast("int").alias("a"), (F.col("o_orderkey") % 6).cast("int").alias("b"))
    label = lambda i: F.when(i % 2 == 0, "even").otherwise("odd")

    def chain(n: str, first: int, last: int, turn: int):
        one = lambda i: spans.span(F.lit("x"), label(i + turn), i * 10 + first, i * 10 + last, F.lit(1.0), "x")
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), one)).otherwise(spans.no_spans())

    both = rows.select("id", chain("a", 5, 20, 0).alias("found"), chain("b", 0, 15, 1).alias("expected"))
    return both.select("id", metrics.relaxed_count(F.col("found"), F.col("expected")).alias("matched"), metrics.relaxed_count(F.col("found"), F.col("expected"), True).alias("matched_alike"))


@query(
    f"""{_PRF}, x as (select d.doc_id, coalesce(tp, 0) as tp, coalesce(p, 0) as p, coalesce(g, 0) + 1 as g from documents d left join t using (doc_id)),
    y as (select *, case when p > 0 then tp / p end as pr, tp / g as re from x)
    select doc_id, cast(g as integer) as ground_truth_entity_count, cast(tp as integer) as entity_true_positive_count, round(re, 9) as entity_recall, case when pr + re > 0 then round(2 * pr * re / (pr + re), 9) end as entity_f1 from y"""
)
def truth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of rows that have a column of expected entities (as JSON)."""
    done = replace.replace(_truth(spark, sf_dir), replace.Redact()).withColumn("gt_entities", F.to_json("expected")).withColumn(schemas.RECORD_ID, F.col("doc_id"))
    m = metrics.record_metrics(done)
    return m.select(F.col(schemas.RECORD_ID).alias("doc_id"), "ground_truth_entity_count", "entity_true_positive_count", F.round("entity_recall", 9).alias("entity_recall"), F.round("entity_f1", 9).alias("entity_f1"))


_EDGE = r"[^\p{L}\p{N}]"


@query("select doc_id, cast(" + " + ".join(f"cast(regexp_matches(text, '(^|{_EDGE}){v}($|{_EDGE})') as integer)" for v in ("the", "12", "123456")) + " as bigint) as leaks from documents where text is not null")
def leaks_at_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short values and numbers are still there only between edges that aren't letters or digits."""
    some = F.array(*(spans.span(F.lit(v), F.lit("x"), F.lit(0), F.lit(1), F.lit(1.0), "x") for v in ("the", "12", "123456", "")))
    rows = _docs(spark, sf_dir).filter(F.col(schemas.TEXT).isNotNull())
    return rows.select("doc_id", metrics.leaks(F.col(schemas.TEXT), some)["original_value_leak_count"].cast("long").alias("leaks"))


@query("select user_id, case when c > 0 and e > 0 then round(2 * (e / n) * (e / c) / (e / n + e / c), 9) end as f1, round(n / (c + 0.5), 9) as rows_per_sec from (select user_id, count(*) as n, count_if(event_type = 'error') as e, count_if(event_type = 'click') as c from events group by user_id)")
def rates_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type") == "click").alias("c"))
    speed = metrics.throughput(F.col("c") + 0.5, rows=F.col("n"))
    f1 = text.f1(text.ratio(F.col("e"), F.col("n")), text.ratio(F.col("e"), F.col("c")))
    return sums.select("user_id", F.round(f1, 9).alias("f1"), *(F.round(v, 9).alias(k) for k, v in speed.items()))


@query("select count(*) as rows, count(text) as texts, min(length(text)) as min_chars, max(length(text)) as max_chars, avg(length(text)) as mean_chars from documents")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.text_statistics(_table(spark, sf_dir, "documents"), "text")
    return out.withColumns({c: F.col(c).cast("long") for c in ("min_chars", "max_chars")})


@query(f"{_RESOLVED}, c as (select label, count(*) as n from spans group by label) select label, n, cast(row_number() over (order by n desc, label) as integer) as place from c")
def label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.label_frequency(_found(spark, sf_dir), schemas.FINAL)


@query(f"select l_orderkey as id, 'evaluation_record' as record_type, bool_and(pk % 3 <> 0) as name_valid, cast(count_if(pk % 3 = 0) as integer) as name_invalid_count from ({_LINES}) group by l_orderkey")
def verdict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("name_invalid", F.filter("answers", lambda a: a["answer"] == "yes")).withColumn("name_valid", F.size("name_invalid") == 0)
    return metrics.evaluation_metrics(rows, ["name"], keep=["id"])


_KEYS = ("sk-{0}", "SK_{0}", "Bearer  {0}", "plain {0}", "{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}a", " akia{0}", "x")


@query("select n_nationkey as k, i, case when i in (0, 1, 2, 4, 5) then true else false end as key from nation, range(0, 7) as t(i)")
def key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*(F.concat(*(F.col("n_nationkey").cast("string") if p is None else F.lit(p) for p in _parts(t))) for t in _KEYS))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(made).alias("i", "value"))
    return rows.select(F.col("n_nationkey").alias("k"), F.col("i").cast("long").alias("i"), text.looks_like_key(F.col("value")).alias("key"))


def _parts(template: str) -> list[str | None]:
    out: list[str | None] = []
    for n, piece in enumerate(template.split("{0}")):
        out += ([None] if n else []) + [piece]
    return out


@query("select n_nationkey as k, lower(n_name) || ' of ' || n_nationkey as key from nation")
def value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("  "), F.col("n_name"), F.lit(" \n\t OF  "), F.col("n_nationkey").cast("string"), F.lit(" "))
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), text.value_key(messy).alias("key"))


# ---------------------------------------------------------------- rewriting


def _dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each line of an order, as a list."""
    method = F.when(F.col("sk") % 4 == 0, "leave_as_is").when(F.col("sk") % 4 == 1, "generalize").otherwise("replace")
    d = F.struct(F.col("n").alias("id"), F.lit("x").alias("source"), F.lit("direct").alias("category"), F.lit("high").alias("sensitivity"), F.lit("name").alias("entity_label"), F.col("pk").cast("string").alias("entity_value"), F.lit("r").alias("protection_reason"), method.alias("protection_method_suggestion"), F.when(F.col("q") % 2 == 0, "high").otherwise("low").alias("combined_risk_level"))
    return _lines(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list(d)).alias("d"))


_METHOD = "case sk % 4 when 0 then 'leave_as_is' when 1 then 'generalize' else 'replace' end"


@query(f"select l_orderkey as id, cast(pk as varchar) as entity_value, {_METHOD} as method from ({_LINES}) where sk % 4 <> 0")
def disposition_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dispositions(spark, sf_dir).select("id", F.explode(rewrite.prompt_block(F.col("d"))).alias("b"))
    return out.select("id", F.col("b.entity_value").alias("entity_value"), F.col("b.protection_method_suggestion").alias("method"))


@query(f"select distinct l_orderkey as id, cast(pk as varchar) as original from ({_LINES}) where sk % 4 in (2, 3)")
def pairs_for_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements of the entities whose method is to replace."""
    pairs = F.transform("d", lambda d: F.struct(d["entity_value"].alias("original"), d["entity_label"].alias("label"), F.lit("s").alias("synthetic")))
    rows = _dispositions(spark, sf_dir).withColumn("pairs", pairs).withColumn("block", rewrite.prompt_block(F.col("d")))
    return rows.select("id", F.explode(rewrite.pairs_for_prompt(F.col("pairs"), F.col("block"))).alias("p")).select("id", F.col("p.original").alias("original")).distinct()


@query(f"select l_orderkey as id, l_linenumber as n, not (q % 2 <> 0 and m <> 'leave_as_is') and not (q % 2 = 0 and m = 'leave_as_is') as consistent, m <> 'leave_as_is' and q % 2 = 0 as strictly from (select *, {_METHOD} as m from ({_LINES}))")
def consistent_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _dispositions(spark, sf_dir).select("id", F.explode("d").alias("d"))
    return out.select("id", F.col("d.id").alias("n"), rewrite.consistent(F.col("d")).alias("consistent"), rewrite.consistent(F.col("d"), True).alias("strictly"))


@query(f"""select l_orderkey as id, string_agg('- [' || case sk % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end || '] name: "' || pk || '" -- ? (confidence_leakage_occurred: ' || printf('%.2f', q % 5 / 4) || '; reason: r)', chr(10) order by l_linenumber) as leaked from ({_LINES}) where pk % 3 = 0 group by l_orderkey""")
def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaked, a line each, for the prompt of a repair."""
    rows = _answers(spark, sf_dir).select("id", rewrite.leaked_items(F.col("answers"), F.col("questions")).alias("leaked"))
    return rows.filter("leaked <> ''")


@query(
    f"{_RW} select id, level, (any_high and high) or round(mass, 9) > above as needs_repair, high or round(utility, 9) < low or round(mass, 9) > most_mass as needs_review from t, (values "
    + ", ".join(f"('{k}', {v.repair_above}::double, {str(v.repair_any_high).lower()}, {v.review_utility_below}::double, {v.review_leakage_above}::double)" for k, v in rewrite.TOLERANCES.items())
    + ") as l(level, above, any_high, low, most_mass)"
)
def tolerance_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is repaired and reviewed at each level of tolerance."""
    scored = rewrite.score_rows(_answers(spark, sf_dir), rewrite.TOLERANCES["low"], "scores", "importance", "answers", "questions")
    high, mass, utility = F.col("any_high_leaked"), F.round("leakage_mass", 9), F.round("utility_score", 9)
    each = [F.struct(F.lit(k).alias("level"), rewrite.needs_repair(high, mass, v).alias("needs_repair"), rewrite.needs_review(F.lit("x"), high, utility, mass, v).alias("needs_review")) for k, v in rewrite.TOLERANCES.items()]
    return scored.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.level", "x.needs_repair", "x.needs_review")


@query("select doc_id, case when doc_id % 3 = 2 then 'x' || doc_id end as rewritten from documents")
def rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite that is blank is none."""
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " \n\u00a0").otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return _table(spark, sf_dir, "documents").select("doc_id", rewrite.rewritten_text(given).alias("rewritten"))
