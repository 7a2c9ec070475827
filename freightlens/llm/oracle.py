"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

# Words and lines as the contracts define them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# A-Z and a-z, the only letters that the contracts lower.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = rf"""
with docs as (select doc_id, {_WORDS} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 49], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as i from docs)),
firsts as (select g, min(doc_id) as first_doc from windows group by g),
hit as (
  select distinct doc_id, i + k as p
  from (select doc_id, i from windows join firsts using (g) where first_doc < doc_id),
       range(50) as r(k)),
gone as (select doc_id, list(p) as ps from hit group by doc_id),
kept as (
  select doc_id, w, list_filter(w, lambda x, i: not list_contains(coalesce(ps, []), i)) as k
  from docs left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, (len(w) - len(k))::bigint as n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256
from kept
"""

_ESCAPED = r"""replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"""

CHAT = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
    filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### : </turn>') + 1 + length({_ESCAPED.format('text')})
    + length(replace({_ESCAPED.format('role')}, ':', '\\:')))::bigint as formatted_chars
from rows group by conv_id
"""

URLS = rf"""
with cut as (
  select page_id, case when contains(url, '://')
    then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest
  from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(rest, '/(.|\n)*$') as path
  from cut),
rules(verdict, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits as (
  select page_id, host, path, verdict, h || p as rule
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from (select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as k
      from fits)
where k = 1
"""

NEAR_DUPLICATES = rf"""
with recursive docs as (select doc_id, {_WORDS} as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (
  select x, y from common join sizes s on s.doc_id = x join sizes t on t.doc_id = y
  where c >= 0.8 * (s.n + t.n - c)),
reach(doc_id, other) as (
  select doc_id, doc_id from docs
  union select doc_id, y from reach join links on x = other)
select doc_id, min(other) as class_id from reach group by doc_id
"""

# crc32 of `<doc_id>:<run>`, bit by bit; 3988292384 is its reversed polynomial.
SPELLING = rf"""
with recursive runs as (
  select doc_id, r, count(*) as k
  from (select doc_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) as r
        from documents)
  where length(r) >= 6 group by all),
octets as (
  select r, k, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || r, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)]
      else [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] end)) as o
  from runs),
hashed as (
  select r, k, xor(4294967295, list_reduce(
    flatten(list_transform(o, lambda x: list_transform(range(8), lambda b: (x::bigint >> b) & 1))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::bigint)) as h
  from octets),
counted as (
  select case when h % 199 = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2)
    else r end as word, sum(k)::bigint as n
  from hashed group by 1),
words as (select word, n from counted where length(word) >= 6 and n >= 5),
gone as (
  select word, i, left(word, i::int) || substr(word, i::int + 2) as v
  from (select word, unnest(range(length(word))) as i from words)),
near as (
  select a.word as x, b.word as y from gone a join gone b using (i, v) where a.word <> b.word
  union select a.word, b.word from gone a join words b on a.v = b.word
  union select b.word, a.word from gone a join words b on a.v = b.word),
best as (
  select x as word, count(*)::bigint as n_near,
    arg_min(y, (-w.n, y)) as f, max(w.n) as f_n
  from near join words w on w.word = y group by x),
formed as (
  select word, case when f_n >= 5 * n then f end as form, n, coalesce(n_near, 0)::bigint as n_near,
    case when f_n >= 5 * n then f_n end as form_n
  from words left join best using (word)),
way(word, root) as (
  select word, word from formed
  union all select way.word, form from way join formed on formed.word = root where form is not null),
roots as (select way.word, root from way join formed on formed.word = root where form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

NEGATIVES = """
with fine as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_inner_product(a.v, b.v)::bigint as score
  from fine a join fine b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id,
  (row_number() over (partition by anchor_id, positive_id
    order by score desc, other_id))::integer as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id
  order by score desc, other_id) <= 3
"""

# Words as this contract defines them; A-Z are lowered first.
_FOLDED = rf"""regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = rf"""
with docs as (select doc_id, {_FOLDED} as w from documents),
items as (select item_id, {_FOLDED} as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)),
places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from docs, (select distinct n from windows) where len(w) >= n)),
found as (select doc_id, item_id, i, n from places join windows using (n, g)),
hits as (
  select doc_id, count(distinct p)::bigint as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found))
  group by doc_id),
listed as (
  select doc_id, count(*)::bigint as n_items,
    string_agg(item_id::varchar, ',' order by item_id::varchar) as names
  from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join listed using (doc_id)
"""

SQL = {
    "op4_substrings": SUBSTRINGS,
    "op6_chat": CHAT,
    "op7_urls": URLS,
    "op9_near_duplicates": NEAR_DUPLICATES,
    "op11_spelling": SPELLING,
    "op12_negatives": NEGATIVES,
    "op13_decontamination": DECONTAMINATION,
}
