"""SQL (DuckDB) for the operators that SQL can express over their whole tables."""

from __future__ import annotations

from .urls import LIMIT, LONG_SUFFIXES, RULES, STRONGEST, WEAKEST, Z

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

JACCARD = rf"""
with recursive w as (select doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from met join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 90 * (na.n + nb.n - i)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(r.b) as component_id
from documents d left join n on n.doc_id = d.doc_id join reach r on r.a = d.doc_id group by d.doc_id
"""

_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
items as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark where item_id is not null),
windows as (
  select distinct item, 10 as n, array_to_string(ws[i:i+9], ' ') as k from items, range(1, len(ws) - 8) r(i) where len(ws) >= 10
  union select distinct item, len(ws), array_to_string(ws, ' ') from items where len(ws) between 1 and 9),
sizes as (select distinct n from windows),
places as (select doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') as k from w, sizes, range(1, len(ws) - n + 2) r(i) where len(ws) >= n),
hits as (select doc_id, i, p.n, item from places p join windows x on p.n = x.n and p.k = x.k),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered c on c.doc_id = w.doc_id left join found f on f.doc_id = w.doc_id
"""


def _urls() -> str:
    fits = [(len(rule), rule, said, f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')") for said, rule in RULES for h, _, p in [rule.partition("/")]]
    pick = lambda k: "case " + " ".join(f"when {f[3]} then '{f[k]}'" for f in sorted(fits, reverse=True)) + " end"
    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)

    def level(inner: str, outer: str, prior: str) -> str:
        return f"""
s_{inner} as (
  select coalesce(greatest({WEAKEST}, least({STRONGEST}, 1 / (case when r > 0 then r end) - 1)), {STRONGEST}) as strength from (
    select sum(spread / (p * (1 - p)) - (groups - 1)) / nullif(sum(case when free > 0 then free end), 0) as r from (
      select o."{outer}", groups, pages, bad, bad / pages as p, pages - squares / pages - (groups - 1) as free, sum(g.n * power(g.k / g.n - bad / pages, 2)) as spread
      from (select "{inner}", "{outer}", sum(n) as n, sum(k) as k from hosts group by 1, 2) g
      join (select "{outer}", sum(n) as pages, sum(k) as bad, count(*) as groups, sum(n * n) as squares from (select "{inner}", "{outer}", sum(n) as n, sum(k) as k from hosts group by 1, 2) group by 1) o on g."{outer}" = o."{outer}"
      where groups > 1 and bad > 0 and bad < pages group by 1, 2, 3, 4, squares))),
p_{inner} as (
  select g."{inner}", strength * prior + k as a, strength * (1 - prior) + n - k as b
  from (select "{inner}", "{outer}", sum(n) as n, sum(k) as k from hosts group by 1, 2) g, s_{inner} {prior})"""

    return rf"""
with parts as (select page_id, translate(regexp_extract(coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
  regexp_extract(coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, ''), '^[^/?#]*([^?#]*)', 1) as path from pages),
marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
seen as (select host, bad from parts join marks on try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) as bigint) = doc_id where host <> ''),
hosts as (select host, case when {two} in ({long}) then {three} else {two} end as domain, case when {two} in ({long}) then {two} else string_split(host, '.')[-1] end as suffix, '*' as everything,
  cast(count(*) as double) as n, cast(sum(bad) as double) as k from seen group by host),
top as (select (sum(k) + 0.5) / (sum(n) + 1.0) as prior from hosts),
{level("suffix", "everything", ", top")},
{level("domain", "suffix", "join (select suffix as key, a / (a + b) as prior from p_suffix) u on u.key = g.suffix")},
{level("host", "domain", "join (select domain as key, a / (a + b) as prior from p_domain) u on u.key = g.domain")},
blocked as (select host from p_host where a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT})
select page_id, host, path, {pick(1)} as rule, coalesce({pick(2)}, case when host in (select host from blocked) then 'block' else 'allow' end) as verdict from parts
"""


URLS = _urls()
