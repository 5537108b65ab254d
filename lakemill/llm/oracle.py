"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from math import comb

from . import mixing, quality_rules, url_filter

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = url_filter.LOWER


def op1() -> str:
    """Same grid, tests and choice as the operator; the binomial tail is summed term by term."""
    rules = {
        "symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"), "capitals": ("capitals", "word_chars"), "shouts": ("shouts", "word_chars"),
    }
    names = tuple(rules)
    share = lambda n: f"case when {rules[n][1]} > 0 then {rules[n][0]}::double / {rules[n][1]} else 0 end"
    alpha = quality_rules.MAX_FALSE_REJECTION
    tail = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({alpha}::double) + (n - j) * ln(1 - {alpha}::double))))"
    return rf"""
with w as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
r as (select doc_id, lang, t, row_number() over () as row, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from w),
g as (select row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from r, unnest(range(1, greatest(len(w) - 1, 1))) u(i)),
often as (select row, i from (select row, i, count(*) over (partition by row, gram) as k from g) where k > 1),
hit as (select row, count(distinct i + d)::bigint as n from often, unnest([0, 1, 2]) v(d) group by row),
base as (select row, doc_id, lang, t, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words,
    len(lines) as n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as capitals, length(t) - length(replace(t, '!', '')) as shouts
  from r left join hit using (row)),
f as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, {', '.join(f'{share(n)} as r_{n}' for n in names)} from base),
known as (select lang, min(quality) as good, {', '.join(f'any_value(r_{n}) as r_{n}' for n in names)} from f join (select distinct doc_id, quality from labels) l using (doc_id)
  where not base_failed and quality in (0, 1) group by lang, t having min(quality) = max(quality)),
long as ({' union all '.join(f"select lang as stratum, good, '{n}' as rule, r_{n} as value from known" for n in names)}),
tests as (select stratum, rule, cutoff, count(*) filter (good = 1) as n, count(*) filter (good = 0) as n_bad, count(*) filter (good = 1 and value > cutoff) as k, count(*) filter (good = 0 and value > cutoff) as k_bad
  from long, unnest({list(quality_rules.GRID)}::double[]) c(cutoff) group by all),
strata as (select count(*) as n_strata from (select distinct stratum from long)),
tail as (select *, case when k >= n * {alpha}::double then 1.0 else {tail} end as p from tests),
safe as (select *, min((p <= {quality_rules.ERROR}::double / 2 / ((select n_strata from strata) * {len(names)}))::int) over (partition by stratum, rule order by cutoff desc) as ok from tail),
best as (select stratum, rule, cutoff from (select *, row_number() over (partition by stratum, rule order by k_bad / n_bad - {quality_rules.GOOD_WEIGHT} * k / n desc, cutoff desc) as place from safe where ok = 1 and k_bad > 0 and k_bad / n_bad - {quality_rules.GOOD_WEIGHT} * k / n > 0) where place = 1),
single as (select stratum, {', '.join(f"max(cutoff) filter (rule = '{n}') as c_{n}" for n in names)} from best group by stratum),
hits as (select stratum, good, {' + '.join(f"case when c_{n} is not null then {1 << i} else 0 end" for i, n in enumerate(names))} as every, {' + '.join(f"case when r_{n} > c_{n} then {1 << i} else 0 end" for i, n in enumerate(names))} as hit
  from known join single on known.lang is not distinct from single.stratum),
sets as (select stratum, every, s, count(*) filter (good = 1) as n, count(*) filter (good = 0) as n_bad, count(*) filter (good = 1 and hit & s > 0) as k, count(*) filter (good = 0 and hit & s > 0) as k_bad
  from hits, unnest(range(1, {1 << len(names)})) u(s) where s & every = s group by all),
joint as (select *, case when k >= n * {alpha}::double then 1.0 else {tail} end as p, case bit_count(s) {' '.join(f'when {m} then {comb(len(names), m) * len(quality_rules.GRID) ** m}::double' for m in range(1, len(names) + 1))} end as ways from sets),
chosen as (select stratum, s from (select *, row_number() over (partition by stratum order by s = every desc, k_bad / n_bad - {quality_rules.GOOD_WEIGHT} * k / n desc, s) as place
  from joint where bit_count(s) = 1 or p <= {quality_rules.ERROR}::double / 2 / (select n_strata from strata) / {len(names) - 1} / ways) where place = 1),
cuts as (select single.stratum, {', '.join(f"case when s & {1 << i} > 0 then c_{n} end as c_{n}" for i, n in enumerate(names))} from single join chosen on single.stratum is not distinct from chosen.stratum),
judged as (select f.*, case when base_failed then 'base' {' '.join(f"when r_{n} > c_{n} then '{n}'" for n in names)} end as broken_rule from f left join cuts on f.lang is not distinct from cuts.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken_rule is null as kept, broken_rule from judged"""


def op5() -> str:
    rest = "case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    order = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in order)
    return rf"""
with a as (select page_id, html, coalesce(url, '') as url, {rest} as rest from pages),
b as (select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) as query from a),
c as (select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') as plain from b),
d as (select *, case when plain <> '' then plain || regexp_replace(path, '/+$', '') || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end end as key from c),
listed as (select distinct key from d where regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '\*\*\*|%%%|###') and key is not null),
e as (select d.*, listed.key is not null as listed from d left join listed on d.key = listed.key)
select page_id, host, path, case {rule} end as rule, case {verdict} when listed then 'block' else 'allow' end as verdict, listed from e"""


def op8() -> str:
    """Every pair that shares a shingle, counted; components by reachability."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) u(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
root as (select a as doc_id, min(least(a, b)) as root from reach group by a)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, d.doc_id) as component_id, d.doc_id = coalesce(root, d.doc_id) as kept
from documents d left join n using (doc_id) left join root using (doc_id)"""


def op9() -> str:
    targets = mixing.TARGETS
    values = ", ".join(f"('{k}', {v}::double)" for k, v in targets.items())
    uniform = lambda text: f"('0x' || substr(md5({text}), 1, 13))::ubigint::double / {float(1 << 52)!r}::double"
    return rf"""
with recursive t(name, target) as (values {values}),
c as (select source, count(*)::double as n, any_value(target) as target from documents left join t on source = name group by source),
sums as (select sum(n) as total, coalesce(sum(target), 0) as given, coalesce(sum(n) filter (target is null), 0) as others from c),
l as (select *, greatest(0.0::double, 1 - given) * {mixing.REST}::double as rest from sums),
r as (select source, (case when target is not null then target else rest * n / others end) / (given + case when others > 0 then rest else 0 end) * total / n as rate from c, l),
p(source, rate, k, p, total) as (select source, rate, 0, exp(-rate), exp(-rate) from r
  union all select source, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) from p where k < 200),
d as (select row_number() over () as row, doc_id, source, {uniform(f"'{mixing.SEED}|' || coalesce(doc_id::varchar, 'null')")} as u from documents),
n as (select row, d.doc_id, d.source, any_value(rate) as rate, count(*) filter (total <= u) as copies from d join p on d.source is not distinct from p.source group by row, d.doc_id, d.source)
select doc_id, source, i as copy, copies, rate, {uniform(f"'{mixing.SEED}-shuffle|' || coalesce(doc_id::varchar, 'null') || '|' || i::varchar")} as place
from n, unnest(range(0, copies)) x(i)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op5_url_filter": op5(), "op8_minhash_dedup": op8(), "op9_mixing": op9()}
