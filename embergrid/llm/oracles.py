"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
win as (
  select distinct item_id, least(13, len(words)) as n, array_to_string(words[k : k + least(13, len(words)) - 1], ' ') as s
  from (select item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) as k from i where len(words) > 0)),
ng as (
  select doc_id, n, k, array_to_string(words[k : k + n - 1], ' ') as s
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as k from w, (select distinct n from win) where len(words) >= n)),
occ as (select distinct doc_id, ng.n, k, item_id from ng join win using (s) where ng.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from occ) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from occ) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from w left join hit using (doc_id) left join it using (doc_id)
"""

#: All pairs that share a shingle: for the small tables only.
OP5 = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 75 * (x.n + y.n - p.k)),
e as (select a, b from l union all select b, a from l),
c(doc_id, root) as (select doc_id, doc_id from documents union select e.b, c.root from c join e on e.a = c.doc_id)
select c.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c.root) as component_id from c left join n on n.doc_id = c.doc_id group by c.doc_id
"""

OP7 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, lag(role) over w as prev,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as n_text, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as n_role
  from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n_text + case when prev = role then 7 else n_role + 7 + 7 end) as bigint) as formatted_chars
from e group by conv_id
"""

OP10 = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as s from documents),
g as (select *, sha256(s) as text_sha256, first_value(doc_id) over (partition by s order by n desc, doc_id) as keep_id, count(*) over (partition by s) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

OP12 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
q as (select item_id, t, count(*) as times from (select item_id, unnest(words) as t from i) group by all),
total as (select count(*)::bigint as nn, sum(len(words))::bigint as ll from d where len(words) > 0),
tf as (select doc_id, n, t, count(*) as tf from (select doc_id, len(words)::bigint as n, unnest(words) as t from d) where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by t),
impact as (select doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)) as f from tf, total),
s as (select item_id, doc_id, sum(times * w * f)::bigint as score from q join w using (t) join impact using (t) group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""

ORACLES = {"op1_decontamination": OP1, "op5_jaccard_join": OP5, "op7_chat_formatting": OP7, "op10_exact_dedup": OP10, "op12_lexical_search": OP12}
