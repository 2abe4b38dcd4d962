"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from d, unnest(range(1, len(w) - 48)) t(i)),
first as (select h, min(doc_id) as f from win group by h),
hit as (select distinct doc_id, i from win join first using (h) where f < doc_id),
island as (select doc_id, i, sum(case when i > prev + 50 then 1 else 0 end) over (partition by doc_id order by i) as g
           from (select doc_id, i, lag(i, 1, -1000) over (partition by doc_id order by i) as prev from hit)),
run as (select doc_id, min(i) as a, max(i) + 50 as b from island group by doc_id, g),
gone as (select doc_id, sum(b - a) as n from run group by doc_id),
edge as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 1) as x, a as y from run
         union all select d.doc_id, coalesce(max(b), 1), len(any_value(w)) + 1 from d left join run using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(array_to_string(w[x:y - 1], ' '), ' ' order by x) as k from edge join d using (doc_id) where y > x group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""

OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
win as (select doc_id, i, md5(substr(x, 2 * i + 1, 100)) as h from d, unnest(range(0, n - 49)) t(i)),
first as (select h, min(doc_id) as f from win group by h),
hit as (select doc_id, i from win join first using (h) where f < doc_id),
island as (select doc_id, i, sum(case when i > prev + 50 then 1 else 0 end) over (partition by doc_id order by i) as g
           from (select doc_id, i, lag(i, 1, -1000) over (partition by doc_id order by i) as prev from hit)),
run as (select doc_id, min(i) as a, max(i) + 50 as b from island group by doc_id, g),
gone as (select doc_id, sum(b - a) as m, count(*) as s from run group by doc_id),
edge as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as p, a as q from run
         union all select d.doc_id, coalesce(max(b), 0), any_value(n) from d left join run using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' order by p) as k from edge join d using (doc_id) where q > p group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(m, 0)::bigint as n_removed, coalesce(s, 0)::bigint as n_spans, sha256(unhex(coalesce(k, ''))) as kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id)
"""

OP7 = r"""
with raw as (select doc_id, i, l, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as t
             from (select doc_id, generate_subscripts(s, 1) as i, unnest(s) as l from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null))),
line as (select *, row_number() over (partition by doc_id order by i) as p from raw where t <> ''),
win as (select doc_id, p, md5(concat_ws(chr(10), t, t2, t3)) as h from
        (select *, lead(t) over w as t2, lead(t, 2) over w as t3 from line window w as (partition by doc_id order by p)) where t3 is not null),
first as (select h, min((doc_id, p)) as f from win group by h),
hit as (select doc_id, p from win join first using (h) where f < (doc_id, p)),
gone as (select distinct doc_id, p + k as p from hit, unnest([0, 1, 2]) t(k)),
away as (select doc_id, i from line join gone using (doc_id, p)),
kept as (select doc_id, string_agg(l, chr(10) order by i) as k from raw anti join away using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_lines, coalesce(g, 0)::bigint as n_removed, case when d.text is not null then sha256(coalesce(k, '')) end as kept_sha256
from documents d left join (select doc_id, count(*) as n from line group by doc_id) using (doc_id)
left join (select doc_id, count(*) as g from away group by doc_id) using (doc_id) left join kept using (doc_id)
"""

OP8 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from documents union select both_ways.b, r from reach join both_ways on both_ways.a = reach.doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(r)::bigint as component_id, doc_id = min(r) as kept
from reach left join n using (doc_id) group by doc_id, n
"""

_RULES = {
    "symbol_share": ("n_symbols / nullif(word_chars, 0)", "word_chars", 0.85, 6.0),
    "dup_line_share": ("n_dup_lines / nullif(n_lines, 0)", "n_lines", 0.99, 2.0),
    "repeat_share": ("n_repeat_words / nullif(n_words, 0)", "n_words", 0.99, 2.0),
    "mean_word": ("word_chars / nullif(n_words, 0)", None, 0.85, 6.0),
}


def _quality() -> str:
    gamma = "(1.01::double / 0.99::double)"
    rules = " union all ".join(f"select lang, source, '{r}' as rule, {v} as value from s where not base_failed" for r, (v, *_) in _RULES.items())
    levels = {2: "lang, source,", 1: "lang,", 0: ""}
    upper, spreads = ("case rule " + " ".join(f"when '{r}' then {rule[i]}::double" for r, rule in _RULES.items()) + " end" for i in (2, 3))
    q = []
    for n, keys in levels.items():
        q.append(f"""m{n} as (select {keys} rule, bucket, sum(n) as n from fine group by {keys} rule, bucket),
r{n} as (select *, sum(n) over (partition by {keys} rule order by bucket) as upto, sum(n) over (partition by {keys} rule) as rows_,
         case when bucket = -1073741824 then 0.0 else pow({gamma}, bucket) * 1.000000001::double end as v from m{n}),
q{n} as (select {keys} rule, max(rows_) as rows_, min(case when upto >= 0.5::double * rows_ then v end) as mid, min(case when upto >= ({upper})::double * rows_ then v end) as high from r{n} group by {keys} rule)""")
    fence = f"mid + ({spreads}) * (high - mid)"
    limit = []
    for r in _RULES:
        pick = [
            f"(select {fence} from q2 where q2.lang is not distinct from s.lang and q2.source is not distinct from s.source and rule = '{r}' and rows_ >= 100)",
            f"(select {fence} from q1 where q1.lang is not distinct from s.lang and rule = '{r}' and rows_ >= 100)",
            f"(select {fence} from q0 where rule = '{r}')",
        ]
        limit.append(f"coalesce({', '.join(pick)}) as max_{r}")
    noise = {r: f" - 3.0::double * sqrt({v} * (1 - {v}) / {among})" if among else "" for r, (v, among, *_) in _RULES.items()}
    over = {r: f"coalesce({v}{noise[r]} > max_{r}, false)" for r, (v, *_) in _RULES.items()}
    failed = ", ".join(f"case when {x} then '{r}' end" for r, x in over.items())
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as w from documents),
tri as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from d, unnest(range(1, len(w) - 1)) t(i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
rep as (select doc_id, count(distinct i + k) as n from twice, unnest([0, 1, 2]) t(k) group by doc_id),
ln as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as dup from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
s0 as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n_lines, 0) as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
       from d left join rep using (doc_id) left join ln using (doc_id)),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s0),
fine as (select lang, source, rule, case when value > 0 then ceil(ln(value) / ln({gamma}))::int else -1073741824 end as bucket, count(*) as n from ({rules}) where value is not null group by all),
{', '.join(q)},
t as (select *, {', '.join(limit)} from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({' or '.join(over.values())}) as kept, concat_ws(',', {failed}) as failed_rules, {', '.join(f'round(max_{r}, 6) as max_{r}' for r in _RULES)} from t
"""


OP4 = _quality()

OP9 = r"""
with p as (select page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '\.$', ''), '') as host, date '2024-01-01' + ((page_id * 7919) % 365)::int as fetched from pages),
h as (select distinct host as key from p where host is not null union select distinct array_to_string(string_split(host, '.')[2:], '.') from p where len(string_split(host, '.')) > 2),
x as (select key, ('0x' || substr(md5(key), 1, 6))::bigint as x from h),
e as (select key, date '2024-01-01' + ((x * (i + 1) * 37) % 365)::int as listed, ['block', 'allow', 'drop'][((x + i) % 3 + 1)::int] as action from x, unnest([0, 1, 2]) t(i)),
one as (select key, listed, max(action) as action from e group by key, listed),
iv as (select *, lead(listed) over (partition by key order by listed) as until from one),
k as (select distinct host, fetched, array_to_string(string_split(host, '.')[c:], '.') as key, c from (select distinct host, fetched from p where host is not null), unnest(range(1, len(string_split(host, '.')) + 1)) t(c)),
v as (select host, fetched, arg_min(action, c) as action, arg_min(k.key, c) as entry_key, arg_min(listed, c) as entry_listed from k join iv on k.key = iv.key and action <> 'drop' and listed <= fetched and (until is null or fetched < until) group by host, fetched)
select page_id, p.host, p.fetched, coalesce(action <> 'block', true) as kept, entry_key, entry_listed from p left join v on v.host = p.host and v.fetched = p.fetched
"""
