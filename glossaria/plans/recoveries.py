"""Queries that recover texts and check references: templates, harvests, histories, backing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery, references, source_history, templates
from ..sources import history
from . import views as v
from .registry import query
from .texts import lines


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("text"))


@query("template_texts")
def template_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and attributes of whole pages by the markup scanner (a table function)."""
    return templates.extract_texts(spark, _pages(spark, sf).withColumnRenamed("file", "path"))


@query("harvested_texts")
def harvested_texts(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.harvest(_pages(spark, sf), F.array(F.lit("the")))


@query("best_harvested_text")
def best_harvested_text(spark: SparkSession, sf: str) -> DataFrame:
    return recovery.best_text(recovery.harvest(_pages(spark, sf)), "file")


@query("snapshot_recovery", f"""with {v.VALUES}, k as (select key from vals where locale = 'fr'), s as (select split_part(key, '.', 2) || '.' || split_part(key, '.', 3) as key, arg_min(value, ord) as value from vals where locale = 'en' and value <> '' group by 1)
select k.key, s.value, s.key as variant from k join s on s.key = split_part(k.key, '.', 2) || '.' || split_part(k.key, '.', 3)""")
def snapshot_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Keys looked up without their first segment in a snapshot that dropped it."""
    rows = v.values(spark, sf)
    snapshot = rows.where("locale = 'en'").withColumn("key", F.regexp_replace("key", r"^[^.]*\.", ""))
    return recovery.from_snapshot(rows.where("locale = 'fr'"), snapshot)


@query("history_recovery", """with c as (select o_custkey as path, o_orderkey as hash, o_orderdate as ts, o_orderpriority = '1-URGENT' as speaks, lag(o_orderpriority = '1-URGENT', 1, false) over (partition by o_custkey order by o_orderdate desc, o_orderkey) as after from orders),
r as (select *, row_number() over (partition by path order by case when speaks or after then 0 else 1 end, ts desc, hash) as n from c) select cast(path as varchar) as key, cast(hash as varchar) as hash from r where n = 1""")
def history_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits per customer: urgent ones speak of translation; each customer's key is in every commit."""
    o = v.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.format_string("%012d", "o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.when(F.col("o_orderpriority") == "1-URGENT", "i18n").otherwise("other").alias("message"))
    keys = o.select(F.col("path").alias("key")).distinct()
    blobs = o.select("path", "hash", F.col("path").alias("key"), F.lit("x").alias("value"))
    return recovery.from_history(keys, o, blobs).select("key", F.col("hash").cast("long").cast("string").alias("hash"))


@query("recent_commits", """with m as (select max(o_orderdate) - interval 90 day as since from orders), y as (select o_custkey, o_orderkey, o_orderdate from orders, m where o_orderdate >= since),
r as (select * from y union all select o_custkey, o_orderkey, o_orderdate from orders where o_custkey not in (select o_custkey from y)) select o_custkey, o_orderkey from r qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 2""")
def recent_commits(spark: SparkSession, sf: str) -> DataFrame:
    o = v.read(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"))
    now = o.agg(F.max("ts")).first()[0]
    return history.recent(o, F.lit(now), 90, 2).select(F.col("path").alias("o_custkey"), F.col("hash").alias("o_orderkey"))


@query("version_diff", "with o as (select lang as path, unnest(string_split(text, chr(10))) as line from documents), n as (select lang as path, unnest(string_split(replace(text, 'an', 'en'), chr(10))) as line from documents) select path, '-' as sign, line from (select * from o except all select * from n) union all select path, '+', line from (select * from n except all select * from o)")
def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = v.read(spark, sf, "documents").select("doc_id", F.col("lang").alias("path"), F.col("text").alias("content"))
    return history.diff(d, d.withColumn("content", F.replace("content", F.lit("an"), F.lit("en"))))


@query("framework_detection", "select n_regionkey as project, case min(case when n_name like 'A%' then 0 when n_name like '%a%' then 3 else 5 end) when 0 then 'nuxt' when 3 then 'vue' else 'react' end as framework from nation group by 1")
def framework_detection(spark: SparkSession, sf: str) -> DataFrame:
    n = v.read(spark, sf, "nation")
    return history.framework(n.select(F.col("n_regionkey").alias("project"), F.when(F.col("n_name").startswith("A"), "nuxt").when(F.col("n_name").contains("a"), "vue").otherwise("react").alias("name")))


@query("copy_requests", f"""with {v.COARSE}, r as (select key, 'en' as source, locale as target from vals union all select key || 'x', 'en', locale from vals)
select r.key, r.source, r.target, case when r.source = r.target then 'same_locale' when r.key not in (select key from vals) then 'unknown_key' when coalesce(trim(t.value), '') = '' then 'empty_source' end as issue from r left join vals t on t.key = r.key and t.locale = r.source""")
def copy_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    ask = rows.select("key", F.lit("en").alias("source"), F.col("locale").alias("target"))
    ask = ask.unionByName(rows.select(F.concat("key", F.lit("x")).alias("key"), F.lit("en").alias("source"), F.col("locale").alias("target")))
    return references.checked_parameters(ask, rows)


_NAMES = "|".join(recovery.PLACEHOLDER_NAMES)
_COUNT = "len(list_filter(string_split_regex(value, '\\s+'), lambda w: w <> ''))"


@query("suspicious_values", f"""with {v.VALUES} select key || '.label' as key, locale from vals where (value <> '' and ((regexp_matches(value, '[.!?]') and {_COUNT} >= 4) or (regexp_matches(value, '(?i)^\\s*(we|you|i|they|he|she|it)\\b') and {_COUNT} >= 4) or {_COUNT} >= 10))
or regexp_matches(regexp_replace(value, '\\{{[a-zA-Z_][a-zA-Z0-9_]*\\}}', '', 'g'), '\\b[Vv]alue[0-9]+\\b') or (regexp_matches(value, '\\b({_NAMES})\\b') and regexp_matches(value, '[A-Z][a-z]+\\s+[A-Z][a-z]+'))""")
def suspicious_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf).withColumn("key", F.concat("key", F.lit(".label")))
    return rows.where(recovery.suspicious(F.col("key"), F.col("value"))).select("key", "locale")


@query("long_sentences", "with x as (select doc_id, cast(unnest(range(len(string_split(text, chr(10))))) as integer) as line, trim(unnest(string_split(text, chr(10)))) as t from documents), n as (select doc_id, line, t, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) as n from x) select doc_id, line from n where t <> '' and ((regexp_matches(t, '[.!?]') and n >= 4) or (regexp_matches(t, '(?i)^\\s*(we|you|i|they|he|she|it)\\b') and n >= 4) or n >= 10)")
def long_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(recovery.long_sentence(F.col("t"))).select("doc_id", "line")


@query("grown_ignore_list", "select trim(text) as pattern from benchmark where trim(text) <> '' union select distinct event_type from events")
def grown_ignore_list(spark: SparkSession, sf: str) -> DataFrame:
    old = v.read(spark, sf, "benchmark").select(F.trim("text").alias("pattern"))
    return references.grown(old, v.read(spark, sf, "events").select(F.col("event_type").alias("pattern")))


_TURNS = """turns as (select conv_id, turn, t, 'chat.' || array_to_string(list_slice(regexp_extract_all(lower(t), '[a-z]{3,}'), 1, 3), '_') as key
  from (select conv_id, turn, trim(regexp_replace(regexp_replace(text, '[<>{}"''`]', ' ', 'g'), '\\s+', ' ', 'g')) as t from conversations) where regexp_matches(t, '[A-Za-z]{3}.* '))"""


@query("source_history_recovery", f"""with {_TURNS}, gone as (select * from turns where turn % 2 = 0), keys as (select distinct conv_id, key from gone),
w as (select conv_id, key, list_filter(string_split(key[6:], '_'), lambda x: length(x) > 2) as words from keys),
s as (select w.conv_id, w.key, g.turn, g.t, len(list_filter(words, lambda x: contains(lower(t), x))) as hits,
  2 + (case when regexp_matches(t, '^[A-Z]') then 2 else 0 end) + (case when regexp_matches(t, '[.!?]$') then 2 else 0 end) + (case when contains(t, ' ') then 1 else 0 end) + (case when length(t) between 5 and 100 then 2 else 0 end) as base from w join gone g on g.conv_id = w.conv_id),
b as (select *, row_number() over (partition by conv_id, key order by base + 10 * hits + 5 desc, turn, t) as r from s where hits > 0)
select cast(conv_id as varchar) as file, key, t as text, 'v' || (case when conv_id % 3 = 0 then 1 else 2 end) as hash from b where r = 1""")
def source_history_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as source files: every other turn becomes a call in the second or third version, and its text is found again."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"""[<>{}"'`]""", " "), r"\s+", " "))
    c = v.read(spark, sf, "conversations").select("conv_id", "turn", clean.alias("t")).where(F.col("t").rlike("[A-Za-z]{3}.* "))
    words = F.slice(F.regexp_extract_all(F.lower("t"), F.lit("[a-z]{3,}"), F.lit(0)), 1, 3)
    c = c.withColumns({"key": F.concat(F.lit("chat."), F.array_join(words, "_")), "plain": F.concat(F.lit("<p>"), "t", F.lit("</p>"))})
    call = F.concat(F.lit("<p>{t('"), "key", F.lit("')}</p>"))
    lines = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("line")))), lambda y: y["line"]), "\n")
    files = c.groupBy("conv_id").agg(lines(F.col("plain")).alias("old"), lines(F.when(F.col("turn") % 2 == 0, call).otherwise(F.col("plain"))).alias("new"))
    spoken = F.col("conv_id") % 3 == 0
    state = lambda n, message, content: F.struct(F.lit(f"v{n}").alias("hash"), F.lit(f"2024-01-0{n + 1}").cast("timestamp").alias("ts"), message.alias("message"), content.alias("content"))
    states = F.array(state(0, F.lit("first"), F.col("old")), state(1, F.when(spoken, "i18n of the chat").otherwise("tidy"), F.when(spoken, F.col("new")).otherwise(F.col("old"))), state(2, F.lit("later"), F.col("new")))
    versions = files.select(F.col("conv_id").cast("string").alias("file"), F.explode(states).alias("s")).select("file", "s.*")
    missing = c.where("turn % 2 = 0").select(F.col("conv_id").cast("string").alias("file"), "key").distinct()
    return source_history.recovered(missing, versions).select("file", "key", "text", "hash")
