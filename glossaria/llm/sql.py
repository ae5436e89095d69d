"""DuckDB SQL for those queries that SQL can express over whole tables."""

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
with n as (select doc_id, {LOWER_AZ} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t
"""


OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as keeper from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h) as payload_bytes, sha1(p.h) as payload_digest,
  case when keeper <> page_id then 'revisit' else 'response' end as record_type, case when keeper <> page_id then keeper end as refers_to
from p left join g on p.h = g.h
"""

OP10 = f"""
with recursive d as (select doc_id, list_filter(string_split_regex({LOWER_AZ}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, chr(1))]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1)))) end as g from d),
shingle as (select doc_id, unnest(g) as x from s),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingle a join shingle b on a.x = b.x and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 80 * (len(x.g) + len(y.g) - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id as id, doc_id as node from documents union select reach.id, edge.b from reach join edge on edge.a = reach.node)
select s.doc_id, len(s.g) as n_shingles, r.component_id from s join (select id, min(node) as component_id from reach group by id) r on r.id = s.doc_id
"""


OP13 = """
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from t group by all having count(distinct id) >= 3),
l as (select lang, count(*) as v, sum(n) as total from k group by lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*) as n from t join k on t.lang = k.lang and t.term = k.term group by all),
s as (select lang, source, sum(n) as total from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0)::hugeint + 1)) // (coalesce(s.total, 0)::hugeint + l.v) as p,
  1 + (1000000000 * (k.n::hugeint + 1)) // (l.total::hugeint + l.v) as q
  from g join k on g.lang = k.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join s on s.lang = g.lang and s.source = g.source),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item, coalesce(x.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from terms)
select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, encode(item)))::int as rank from every
union all select lang, source, 'term', item, value::bigint, rank::int from ranked where rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op5_warc_index_merge": OP5, "op10_jaccard_join": OP10, "op13_source_divergence": OP13}
