"""DuckDB twins of the operator queries that SQL can express."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, template_sets

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD}')"


OP1 = f"""
with d as (select row_number() over () as k, doc_id, {_words("coalesce(text, '')")} as w from documents),
b as (select distinct item_id, {_words("text")} as w from benchmark where text is not null),
win as (
  select item_id, list_slice(w, s + 1, s + 10) as win
  from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from b where len(w) > 0)),
pos as (select k, w, unnest(range(1, len(w) + 1)) as p from d),
hit as (
  select distinct k, p, len(win) as n, item_id
  from pos join win on w[p] = win[1] and list_slice(w, p, p + len(win) - 1) = win),
covered as (select k, count(distinct p + i) as n_hit from (select k, p, unnest(range(0, n)) as i from hit) group by k),
items as (select k, count(distinct item_id) as n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as s from hit group by k),
-- of ten words with at most two others between them, three in a row stand together at one of these places
three as (select distinct item_id, win, o, win[o + 1] as a, win[o + 2] as b, win[o + 3] as c from win, (values (0), (3), (6)) t(o) where len(win) = 10),
met as (
  select distinct k, item_id, win, w, p - o - g as p
  from (select k, w, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from pos) join three using (a, b, c), (values (0), (1), (2)) t(g) where p - o - g >= 1),
near as (
  select k, p, item_id from met where w[p] = win[1] and list_slice(w, p, p + 9) <> win
  and regexp_matches(array_to_string(list_slice(w, p, p + 11), ' '), '^' || array_to_string(win, ' ([^ ]+ )*') || '( |$)')),
nears as (select k, count(distinct p) as n_near, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as near_items from near group by k)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near, coalesce(near_items, '') as near_items
from d left join covered using (k) left join items using (k) left join nears using (k)
"""

OP3 = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) as s from documents),
g as (select s, count(*) as group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) as keep_id from t group by s)
select doc_id, keep_id, group_size::bigint as group_size, doc_id = keep_id as kept, s as text_sha256 from t join g using (s)
"""


def _op4() -> str:
    quote = lambda x: "'" + x + "'"
    listed = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    templates = ", ".join(f"({quote(t['label'])}, {listed(t['tokens'])}, {t['need']}, {t['width']})" for t in template_sets(TEMPLATES, 0.8))
    starts = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " and ".join(f"w[i + {k + 1}] = {quote(x)}" for k, x in enumerate(words))
        starts.append(f"select k, i, {quote(label)} as label from pos where {test}")
    return f"""
with d as (select row_number() over () as k, doc_id, {_words("coalesce(text, '')")} as w from documents),
pos as (select k, w, unnest(range(0, len(w))) as i from d),
base as (select k, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as labels
  from ({" union all ".join(starts)}) group by k),
t(label, tokens, need, width) as (values {templates}),
hopeful as (select k, w, t.* from d join t on len(list_intersect(w, tokens)) >= need),
blocks as (select k, label, tokens, need, list_slice(w, s + 1, s + width) as b
  from (select *, unnest(range(0, greatest(len(w) - width, 0) + 1)) as s from hopeful)),
met as (select k, list(distinct label) as labels, max(len(list_intersect(b, tokens)) / len(tokens)) as best
  from blocks where len(list_intersect(b, tokens)) >= need group by k)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from d left join base using (k) left join met using (k)
"""


OP7 = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from d),
class as (select min(doc_id) as rep, s, len(s) as n from sets where len(s) > 0 group by s),
tok as (select rep, n, unnest(s) as x from class),
freq as (select x, count(*) as f from tok group by x),
ranked as (select rep, n, x, row_number() over (partition by rep order by f, x) as k from tok join freq using (x)),
prefix as (select rep, n, x from ranked where k <= n - ceil(0.8 * n) + 1),
cand as (select distinct a.rep as a, b.rep as b from prefix a join prefix b on a.x = b.x and a.rep < b.rep and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
link as (
  select a, b from cand join class p on p.rep = a join class q on q.rep = b
  where 100 * len(list_intersect(p.s, q.s)) >= 80 * (p.n + q.n - len(list_intersect(p.s, q.s)))),
edge as (select a, b from link union select b, a from link),
reach(a, b) as (select rep, rep from class union select r.a, edge.b from reach r join edge on edge.a = r.b),
comp as (select a as rep, min(b) as component from reach group by a)
select sets.doc_id, len(sets.s)::bigint as n_shingles, coalesce(component, sets.doc_id) as component_id,
  sets.doc_id = coalesce(component, sets.doc_id) as kept
from sets left join class on class.s = sets.s and len(sets.s) > 0 left join comp using (rep)
"""


OP11 = """
with recursive bits(i, k, v) as (select i, 0, i from range(256) t(i) union all select i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from bits where k < 8),
crc as (select list(v order by i) as tab from bits where k = 8),
own as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as tok,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
conv as (
  select c, n, c - c % 100 as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda x: ord(x)::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 as h
  from (select c, count(*) as n from own group by c), crc),
headed as (select k.*, least(h, coalesce(b.n, 0)) as m from conv k left join (select c as bc, n from conv) b on bc = k.base),
turns as (
  select k.c, pos + 1 as d, t, tok from headed k join own o on o.c = k.base and pos < h
  union all select k.c, pos - h + m + 1, t, tok from headed k join own o on o.c = k.c and pos >= h),
places as (
  select c, d, t, sha256(string_agg(tok, '') over (partition by c order by d)) as key from turns
  union all select c, 0, '', '' from conv),
chained as (select *, lag(key) over (partition by c order by d) as up from places),
node as (select key, d, min(c) as conv_id, count(*) as n_convs, min(up) as up, (count(*) - 1) * any_value(length(t)) as saved from chained group by key, d),
child as (select up, count(*) as n_children from node where up is not null group by up),
own_amounts as (select node.*, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf from node left join child on child.up = node.key),
total as (
  select a.key, sum(leaf) as n_leaves, sum(saved) as saved_tokens
  from own_amounts v join places a on a.c = v.conv_id and a.d <= v.d group by a.key),
ending as (select key, sha256(string_agg(cast(c as varchar), ',' order by c)) as s from (select c, arg_max(key, d) as key from places group by c) group by key)
select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children::bigint as n_children, n_leaves::bigint as n_leaves,
  saved_tokens::bigint as saved_tokens, coalesce(s, sha256('')) as ends_sha256
from own_amounts v join total using (key) left join node p on p.key = v.up left join ending on ending.key = v.key
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op3_exact_dedup": OP3, "op4_license_scan": _op4(), "op7_near_dedup": OP7, "op11_prefix_trie": OP11}
