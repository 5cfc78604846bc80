"""Plain SQL of the operators that SQL can express, for tables that fit one machine."""

#: Every 400-byte string by its hash; starts that occur twice, merged to runs; the bytes between the runs.
OP1 = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
k as (select doc_id, i, md5(substr(x, 2 * i + 1, 800)) as g from (select doc_id, x, unnest(range(0, n - 399)) as i from h where n >= 400)),
r as (select doc_id, i from k where g in (select g from k group by g having count(*) > 1)),
m as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end as f from r),
s as (select doc_id, i, sum(f) over (partition by doc_id order by i) as s from m),
runs as (select doc_id, s, min(i) as a, max(i) + 400 as z from s group by doc_id, s),
gaps as (select doc_id, s, a, z, coalesce(lag(z) over (partition by doc_id order by s), 0) as q from runs),
parts as (select g.doc_id, sum(z - a) as n_removed, count(*) as n_spans, max(z) as z,
 string_agg(substr(h.x, 2 * q + 1, 2 * (a - q)), '' order by s) as head from gaps g join h using (doc_id) group by g.doc_id)
select h.doc_id, cast(h.n as bigint) as n_bytes, cast(coalesce(p.n_removed, 0) as bigint) as n_removed, cast(coalesce(p.n_spans, 0) as bigint) as n_spans,
 sha256(unhex(case when p.doc_id is null then h.x else p.head || substr(h.x, 2 * p.z + 1) end)) as kept_sha256
from h left join parts p on p.doc_id = h.doc_id"""

#: All pairs that share a shingle, counted; reachable documents by recursion over the links.
OP4 = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as (select doc_id, case when len(ws) >= 2 then list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) else ws end as sh from w),
e as (select doc_id, unnest(sh) as g from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from pairs join sets sx on sx.doc_id = x join sets sy on sy.doc_id = y where 100 * k >= 80 * (len(sx.sh) + len(sy.sh) - k)),
u as (select x as a, y as b from links union all select y, x from links),
reach(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, u.b from reach r join u on u.a = r.c),
least as (select doc_id, min(c) as component_id from reach group by doc_id)
select sets.doc_id, cast(len(sh) as bigint) as n_shingles, component_id, sets.doc_id = component_id as kept from sets join least using (doc_id)"""

#: Every window of 13 words by its hash and the smallest document that holds it; covered words go.
OP11 = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
k as (select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select g, min(doc_id) as least from k group by g),
c as (select distinct doc_id, unnest(range(i, i + 13)) as j from k join f using (g) where doc_id > least),
p as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as j from w),
s as (select p.doc_id, string_agg(x, ' ' order by j) as t from p anti join c on c.doc_id = p.doc_id and c.j = p.j group by p.doc_id),
n as (select doc_id, count(*) as n from c group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, sha256(coalesce(s.t, '')) as kept_sha256
from w left join n on n.doc_id = w.doc_id left join s on s.doc_id = w.doc_id"""

#: All scores of the anchors, ranked; positives joined to the rows inside their windows.
OP13 = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
 list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
 from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
 cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
 from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other) as r from s where same) where r <= 5),
n as (select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
 row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank
 from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
