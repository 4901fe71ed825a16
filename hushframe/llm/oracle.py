"""SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from . import mixing, quality

_WORD = r"[^\x20\x09-\x0D]+"

_VALUE = {r: f"case when {b} > 0 then ({u} * {a}) // {b} else 0 end" for r, (a, b, u, _) in quality.RATIOS.items()}


def _bucket(ratio: str) -> str:
    cut = f"greatest(length(bin(v_{ratio})) - {quality.BITS}, 0)"
    return f"((v_{ratio} >> {cut}) << {cut})"


def _quartiles(by: str, name: str) -> str:
    at = lambda r, q: f"list_sort(list({_bucket(r)}))[cast(ceil({q} * count(*) / 4.0) as integer)]::double as {name}{q}_{r}"
    group = f" group by {by}" if by else ""
    return f"select {by + ', ' if by else ''}count(*) as {name}_docs, {', '.join(at(r, q) for r in quality.RATIOS for q in (1, 2, 3))} from m where n_words > 0{group}"


def _drawn(name: str, q: int, r: str, above: str) -> str:
    return f"(({name}_docs * {name}{q}_{r} + {quality.DRAWN} * {above}) / ({name}_docs + {quality.DRAWN}))"


def _quarter(q: int, r: str) -> str:
    return _drawn("own", q, r, _drawn("lang", q, r, f"all{q}_{r}"))


def _fence(r: str, low: bool) -> str:
    q, step = (1, f"{_quarter(2, r)} - {_quarter(1, r)}") if low else (3, f"{_quarter(3, r)} - {_quarter(2, r)}")
    return f"{_quarter(q, r)} {'-' if low else '+'} {quality.SPREAD} * greatest({step}, {quality.RATIOS[r][3]}::double)"


_WITHIN = " and ".join([f"v_{r} <= {_fence(r, False)}" for r in quality.RATIOS] + [f"v_{r} >= {_fence(r, True)}" for r in quality.BOTH_SIDES])

OP9 = f"""with t as (select row_number() over () as k, doc_id, lang, source, coalesce(text, '') as text from documents),
  w as (select k, unnest(l) as word, generate_subscripts(l, 1) as p from (select k, regexp_extract_all(text, '{_WORD}') as l from t)),
  g as (select k, p, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as tri from w window o as (partition by k order by p)),
  r as (select k, p, count(*) over (partition by k, tri) > 1 and tri is not null as hit from g),
  c as (select k, hit or coalesce(lag(hit, 1) over o, false) or coalesce(lag(hit, 2) over o, false) as inside from r window o as (partition by k order by p)),
  reps as (select k, count(case when inside then 1 end) as n_repeat_words from c group by k),
  lines as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select k, unnest(string_split(text, chr(10))) as line from t) where regexp_matches(line, '{_WORD}') group by k),
  words as (select k, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars from w group by k),
  p as (select t.k, doc_id, lang, source, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(regexp_extract_all(text, '[^A-Za-z\\x20\\x09-\\x0D\\x{{80}}-\\x{{10FFFF}}]')) as bigint) as n_marks, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
    from t left join words on words.k = t.k left join lines on lines.k = t.k left join reps on reps.k = t.k),
  m as (select *, {", ".join(f"{v} as v_{r}" for r, v in _VALUE.items())} from p),
  l2 as ({_quartiles("lang, source", "own")}), l1 as ({_quartiles("lang", "lang")}), l0 as ({_quartiles("", "all")})
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed, not failed and coalesce({_WITHIN}, true) as kept
  from (select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed, l2.* exclude (lang, source), l1.* exclude (lang), l0.* from m left join l2 on m.lang is not distinct from l2.lang and m.source is not distinct from l2.source left join l1 on m.lang is not distinct from l1.lang cross join l0)"""

OP10 = f"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size, md5('{mixing.SEED}/' || doc_id) as h from documents),
  s as (select source, cast(sum(size) as bigint) as ss, row_number() over (order by source nulls last) as n from d group by source),
  w as (select *, list_value{mixing.WEIGHTS}[cast((n - 1) % {len(mixing.WEIGHTS)} + 1 as integer)] as w, {mixing.MAX_EPOCHS} * ss as cap from s),
  o as (select *, row_number() over (order by cap / w::double, n) as k from w),
  v as (select *, (sum(ss) over () - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over (order by k rows between current row and unbounded following))::double as level from o),
  f as (select *, coalesce(least(cap::double, w * (select level from v where cap >= w * level order by k limit 1)), 0) as target from v),
  x as (select d.*, ss, target, case when ss > 0 then floor(target / ss) else 0 end as whole, sum(size) over (partition by source order by h, doc_id, size rows unbounded preceding) as upto from d join f using (source)),
  y as (select *, target - whole * ss as room from x)
  select doc_id, size, ss as source_size, round(target, 6) as target, cast(whole * size + case when upto <= room then size when upto - size <= room then round(room - upto + size) else 0 end as bigint) as taken from y"""

OP12 = f"""with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
  m as (select doc_id, t, part, regexp_extract_all(t, '{_WORD}') as w, min(doc_id) over (partition by t) as first from d),
  l as (select doc_id as id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
  f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as fails from m left join l on m.doc_id = l.id),
  c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
  k as (select unnest([1, 2, 3, 4, 5]) as k),
  o as (select [a.k, b.k, c.k, d.k, e.k] as o from k a, k b, k c, k d, k e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
  s as (select part, o, k as step, o[k] as f, sum(n) as n, sum(case when len(list_filter(o[1:k], lambda x: fails[x])) = 0 then n else 0 end) as kept, sum(case when fails[o[k]] then n else 0 end) as failing,
      sum(case when here then n else 0 end) as removed, sum(case when here then good else 0 end) as good_lost, sum(case when here then toxic else 0 end) as toxic_lost, sum(case when fails[o[k]] and len(list_filter(fails, lambda x: x)) = 1 then n else 0 end) as alone
    from (select *, fails[o[k]] and len(list_filter(o[1:k - 1], lambda x: fails[x])) = 0 as here from c, o, k) group by all)
  select part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(failing - removed as bigint) as redundant, cast(alone as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from s"""

OP13 = """with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
  n as (select doc_id, t, w, len(w) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
  c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
  p as (select *, array_to_string(w[1:a], '') as pre, array_to_string(w[a + 1:b], '') as mid, array_to_string(w[b + 1:], '') as suf from c)
  select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""

ORACLE_SQL = {"op9_quality": OP9, "op10_mixing": OP10, "op12_filter_audit": OP12, "op13_fill_in_middle": OP13}
