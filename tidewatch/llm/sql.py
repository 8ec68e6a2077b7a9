"""SQL of queries, or of the parts of them, that DuckDB can run on whole tables."""

from __future__ import annotations

# Words, sets of their five-word runs, all pairs of sets by shared runs, and what links connect.
NGRAM_JOIN = r"""
with recursive words as (
  select row_number() over () as k, doc_id, coalesce(text, '') as t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then ['!' || t] when len(w) < 5 then [array_to_string(w, ' ') || ' '] else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) end as g from words
), d as (select row_number() over () as s, g, len(g) as n, count(*) as copies, min(doc_id) as least_id from sets group by g
), r as (select s, n, unnest(g) as x from d
), links as (select a.s as a, b.s as b from r a join r b on a.x = b.x and a.s <> b.s group by a.s, b.s, a.n, b.n having 9 * count(*) >= 4 * (a.n + b.n)
), reach(s, o) as (select s, s from d union select reach.s, links.b from reach join links on links.a = reach.o
), class as (select reach.s, min(d.least_id) as class_id from reach join d on d.s = reach.o group by reach.s
), linked as (select links.a as s, sum(d.copies) as n from links join d on d.s = links.b group by links.a)
select sets.doc_id, class.class_id, (coalesce(linked.n, 0) + d.copies - 1)::bigint as n_links, d.copies::bigint as copies
from sets join d on sets.g = d.g join class using (s) left join linked using (s)
"""

# Test items that stand in a document word by word.
EXACT_LEAKS = r"""
with d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+'), ' ') || ' ' as t from documents
), i as (select item_id, array_to_string(w, ' ') as t, len(w) as n from (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') as w from benchmark where text is not null) where len(w) > 0
)
select d.doc_id, i.item_id, i.n::int as item_words from d join i on contains(d.t, ' ' || i.t || ' ')
"""

# The payload of every text and its Netpbm file.
MEDIA_BYTES = r"""
with p as (select doc_id, strlen(coalesce(text, ''))::bigint as n, greatest(1, (strlen(coalesce(text, '')) + 575) // 576)::bigint * 576 as size, coalesce(text, '') as t from documents
), b as (select doc_id, n, size, encode(t) || from_hex(repeat('ff', size - n)) as payload from p
), m as (select *, encode('P5' || chr(10) || '24 ' || size // 24 || chr(10) || '255' || chr(10)) || payload as media from b)
select doc_id, n as n_bytes, size as payload_bytes, sha256(payload) as payload_sha256, octet_length(media)::bigint as media_bytes, sha256(media) as media_sha256 from m
"""

# Sizes and targets of sources: those with the least cap for their weight are capped, as many as it takes until no other is above its own.
MIX_TARGETS = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (select source, sum(size)::bigint as n from d group by source
), w as (select source, n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s
), o as (select *, row_number() over (order by 2.0::double * n / weight, source) as k, (select 1.5::double * sum(n) from s) as total from w
), c as (select *, (total - coalesce(sum(2.0::double * n) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by k rows between current row and unbounded following) as rate from o
), f as (select min(k) as k from c where weight * rate <= 2 * n
), t as (select source, n, case when c.k < coalesce(f.k, 1000000000) then 2.0::double * n else weight * (select rate from c x join f on x.k = f.k) end as target from c, f)
select d.doc_id, d.size, t.n as source_size, round(t.target, 3) as target from d join t on d.source is not distinct from t.source
"""

# Host, path and the longest rule.
URL_RULES = r"""
with p as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages
), h as (select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from p
), r(rule, top, start) as (values ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/'))
select page_id, host, path, (select arg_max(rule, length(rule)) from r where (host = top or ends_with(host, '.' || top)) and starts_with(path, start)) as rule from h
"""

# Groups of texts that are equal without blanks.
EXACT_DEDUP = r"""
with d as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents
), k as (select *, row_number() over w as rn, first_value(doc_id) over w as keep_id from d window w as (partition by t order by length(raw) desc, doc_id nulls last))
select doc_id, keep_id, count(*) over (partition by t) as group_size, rn = 1 as kept, sha256(t) as text_sha256 from k
"""

# Cuts by four numbers from the hash of the id.
FIM = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), r as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r
), o as (select *, case form when 'plain' then t when 'psm' then '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) else '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) end as output from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars, sha256(output) as output_sha256, sha256(t) as restored_sha256 from o
"""

# All scores of anchors, then the bands below each anchor's best rows of its label.
HARD_NEGATIVES = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), n as (select p.*, s.id as negative_id, s.score as negative_score from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 80 * p.positive_score and 100 * p.positive_score)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id))::int as rank, negative_id, positive_score, negative_score from n qualify rank <= 5
"""
