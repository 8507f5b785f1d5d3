"""SQL of the operators that SQL can express, for DuckDB on tables of the size that is checked."""

from __future__ import annotations

#: Pages as they are in the tables: one article, tags taken off, its blocks kept apart.
HTML = r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
b as (select page_id, unnest(string_split_regex(body, '</?(?:p|h[1-6]|div|ul|ol|li|section)\b[^>]*>')) as part, generate_subscripts(string_split_regex(body, '</?(?:p|h[1-6]|div|ul|ol|li|section)\b[^>]*>'), 1) as pos from a),
c as (select page_id, pos, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(part, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t from b),
e as (select page_id, string_agg(t, chr(10) || chr(10) order by pos) as text from c where t <> '' group by page_id)
select a.page_id, a.url, coalesce(e.text, '') as text, length(coalesce(e.text, ''))::bigint as n_chars from a left join e on a.page_id = e.page_id"""

#: Every pair of one label by its cosine; components by recursion.
LATTICE = r"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
n as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.u) = len(b.u) where list_dot_product(a.u, b.u) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, least(vec_id, coalesce((select min(r.b) from r where r.a = vec_id), vec_id)) as component_id, vec_id = least(vec_id, coalesce((select min(r.b) from r where r.a = vec_id), vec_id)) as kept from embeddings"""

#: Every window of 20 words, numbered among its equals.
SUBSTRING = r"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
win as (select doc_id, p, array_to_string(list_slice(ws, p, p + 19), ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from d)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from win) where r > 1),
gone as (select distinct doc_id, p + i as pos from again, range(0, 20) t(i)),
kept as (select w.doc_id, count(*) as n_words, count(gone.pos) as n_removed, string_agg(word, ' ' order by w.pos) filter (gone.pos is null) as txt from w left join gone on w.doc_id = gone.doc_id and w.pos = gone.pos group by w.doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(txt, '')) as kept_sha256 from d left join kept on d.doc_id = kept.doc_id"""

#: Payloads and, of equal large ones, the last page.
WARC = r"""with p as (select page_id, coalesce(html, '') as h from pages), g as (select h, max(page_id) as chosen from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h)::bigint as payload_bytes, sha1(p.h) as payload_digest, case when page_id < chosen then 'revisit' else 'response' end as record_type, case when page_id < chosen then chosen end as refers_to from p left join g on p.h = g.h"""
