"""Queries over catalogues: de-duplication, records, missing and stale keys, merges, grids, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import catalog as cat
from ..operators import joins, reports
from . import views as v
from .registry import query

en = lambda df: df.where("locale = 'en'").select("key", "value", "ord")
fr = lambda df: df.where("locale = 'fr'").select("key", "value", "ord")
FR = "fr as (select key, value, ord from vals where locale = 'fr')"


@query("status_by_locale", f"""with {v.COARSE}, {v.LOCALES}, src as (select key, value from vals where locale = 'en' and value <> ''),
g as (select l.locale, s.value as source, t.value from src s cross join locs l left join vals t on t.key = s.key and t.locale = l.locale where l.locale <> 'en')
select locale, count(*) as total, count(*) filter (value <> '' and value <> source) as translated, count(*) - count(*) filter (value <> '' and value <> source) as untranslated,
round(100.0 * count(*) filter (value <> '' and value <> source) / count(*), 2) as percent from g group by locale""")
def status_by_locale(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status(v.coarse(spark, sf), v.locales(spark, sf))


@query("catalog_first_wins", f"with {v.VALUES} select key, locale, file, value, ord from vals")
def catalog_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return v.values(spark, sf)


@query("catalog_priority_last", f"with {v.CATALOG} select key, locale, value, ord from (select *, row_number() over (partition by key, locale order by ord % 3, ord desc) as r from catalog) where r = 1")
def catalog_priority_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.catalog(spark, sf).withColumn("priority", F.col("ord") % 3)
    return cat.priority_last(rows, ["key", "locale"], "priority").select("key", "locale", "value", "ord")


@query("catalog_records", f"""with {v.VALUES} select key, string_agg(locale || '=' || value, '|' order by locale) as locales, case when bool_or(locale = 'en') then 'en' else min(locale) end as default_locale, count(*) as n from vals group by key""")
def catalog_records(spark: SparkSession, sf: str) -> DataFrame:
    r = cat.records(v.values(spark, sf))
    entries = F.transform(F.array_sort(F.map_entries("locales")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.select("key", F.array_join(entries, "|").alias("locales"), "default_locale", F.size("locales").cast("long").alias("n"))


@query("keys_per_file", f"with {v.CATALOG} select file, min(locale) as locale, count(distinct key) as n_keys, min(key) as first_key from catalog group by file")
def keys_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return cat.keys_per_file(v.catalog(spark, sf)).select("file", "locale", F.size("keys").cast("long").alias("n_keys"), F.col("keys")[0].alias("first_key"))


@query("key_parts", f"with {v.VALUES} select key, split_part(key, '.', 1) as ns, split_part(key, '.', 2) as kind, split_part(key, '.', 3) as slug from (select distinct key from vals)")
def key_parts(spark: SparkSession, sf: str) -> DataFrame:
    return cat.parts(v.values(spark, sf).select("key").distinct())


@query("text_key_map", f"""with {v.VALUES}, base as (select split_part(key, '.', 1) as ns, 'text' as kind, value as text, key, ord from vals) select ns, kind, text, arg_min(key, ord) as key from base group by ns, kind, text""")
def text_key_map(spark: SparkSession, sf: str) -> DataFrame:
    return cat.text_keys(v.values(spark, sf)).select("ns", "kind", "text", "key")


@query("missing_pairs", f"with {v.COARSE}, {v.EN}, {FR} select en.key, en.value as source from en left join fr on fr.key = en.key where en.value <> '' and (fr.value is null or fr.value = '' or fr.value = en.value)")
def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    return joins.missing_pairs(en(rows), fr(rows)).select("key", "source")


_WORK = f"""{v.COARSE}, {v.LOCALES}, work as (select l.locale, s.key, s.value as source from vals s cross join locs l left join vals t on t.key = s.key and t.locale = l.locale
where s.locale = 'en' and s.value <> '' and l.locale <> 'en' and (t.value is null or t.value = '' or t.value = s.value))"""


@query("per_locale_worklist", f"with {_WORK} select locale, key, source from work")
def per_locale_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return joins.missing_by_locale(v.coarse(spark, sf), v.locales(spark, sf)).select("locale", "key", "source")


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return v.locales(spark, sf).select("locale", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("source")).withColumn("translation", F.concat("locale", F.lit(":"), "source"))


_CACHE = "cache as (select locale, s as source, locale || ':' || s as translation from locs, (values ('1'), ('2')) x(s))"


@query("cache_prefill", f"with {_WORK}, {_CACHE} select w.locale, w.key, w.source, c.translation from work w join cache c on c.locale = w.locale and c.source = w.source")
def cache_prefill(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = joins.cache_join(joins.missing_by_locale(v.coarse(spark, sf), v.locales(spark, sf)), _cache(spark, sf))
    return hits.select("locale", "key", "source", "translation")


@query("plan_summary", f"with {_WORK}, {_CACHE} select w.locale, count(*) as missing, count(c.translation) as cache_applied, count(*) - count(c.translation) as pending from work w left join cache c on c.locale = w.locale and c.source = w.source group by w.locale")
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    work = joins.missing_by_locale(v.coarse(spark, sf), v.locales(spark, sf))
    return reports.plan_summary(work, joins.cache_join(work, _cache(spark, sf))[0])


@query("apply_answers", f"""with {_WORK}, {v.EN}, answers as (select locale, key, case when ord % 4 = 0 then '' else 'x' || value end as value from vals where locale <> 'en')
select a.locale, a.key, a.value, coalesce(w.source, en.value) as source, case when trim(a.value) = '' then 'empty' when coalesce(w.source, en.value) is null then 'unknown' else 'applied' end as state
from answers a left join work w on w.locale = a.locale and w.key = a.key left join en on en.key = a.key""")
def apply_answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    answers = rows.where("locale <> 'en'").select("locale", "key", F.when(F.col("ord") % 4 == 0, "").otherwise(F.concat(F.lit("x"), "value")).alias("value"))
    return joins.answers_join(answers, joins.missing_by_locale(rows, v.locales(spark, sf)), en(rows))


@query("unanswered", f"with {_WORK}, answers as (select locale, key from vals where locale = 'fr') select locale, key, source from work w where not exists (select 1 from answers a where a.locale = w.locale and a.key = w.key)")
def unanswered(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    answers = rows.where("locale = 'fr'")
    return joins.without(joins.missing_by_locale(rows, v.locales(spark, sf)), answers, ["locale", "key"]).select("locale", "key", "source")


@query("orphaned_keys", f"with {v.VALUES} select locale, key from vals where locale <> 'en' and key not in (select key from vals where locale = 'en')")
def orphaned_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.without(rows.where("locale <> 'en'"), rows.where("locale = 'en'")).select("locale", "key")


_USED = f"used as (select distinct source || '.text.' || cast(d.doc_id % {v._M} as varchar) as key from documents d join labels l using (doc_id) where l.quality = 1)"


def _used(spark: SparkSession, sf: str) -> DataFrame:
    good = v.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("ord"))
    return v.catalog(spark, sf).join(good, "ord", "left_semi").select("key")


@query("unused_keys", f"with {v.VALUES}, {_USED} select key, value from vals where locale = 'en' and key not in (select key from used)")
def unused_keys(spark: SparkSession, sf: str) -> DataFrame:
    return joins.without(en(v.values(spark, sf)), _used(spark, sf)).select("key", "value")


@query("used_keys_semi", f"with {v.VALUES}, {_USED} select key, value from vals where locale = 'en' and key in (select key from used)")
def used_keys_semi(spark: SparkSession, sf: str) -> DataFrame:
    return joins.only(en(v.values(spark, sf)), _used(spark, sf)).select("key", "value")


@query("structural_compare", f"with {v.COARSE}, {v.EN} select t.locale, t.key, en.value as english, case when t.value = en.value then 'untranslated' else 'translated' end as issue from vals t join en on en.key = t.key where t.locale <> 'en'")
def structural_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    both = rows.where("locale <> 'en'").join(en(rows).select("key", F.col("value").alias("english")), "key")
    return both.select("locale", "key", "english", F.when(F.col("value") == F.col("english"), "untranslated").otherwise("translated").alias("issue"))


@query("sync_fill", f"with {v.VALUES}, {v.EN}, {FR} select coalesce(en.key, fr.key) as key, coalesce(fr.value, en.value) as value, fr.value is null as added from en full join fr on fr.key = en.key")
def sync_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.fill(en(rows), fr(rows))


@query("sync_prune", f"with {v.VALUES}, {v.EN}, {FR} select en.key, coalesce(fr.value, en.value) as value from en left join fr on fr.key = en.key")
def sync_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.prune(en(rows), fr(rows))


@query("mask_pick", f"with {v.VALUES}, {v.EN}, {FR} select fr.key, coalesce(en.value, fr.value) as value from fr left join en on fr.key = en.key")
def mask_pick(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.mask(en(rows), fr(rows))


@query("upsert_merge", f"with {v.VALUES}, en as (select key, value, ord from vals where locale = 'en'), {FR} select coalesce(en.key, fr.key) as key, coalesce(fr.value, en.value) as value, en.ord is null as is_new, coalesce(en.ord, fr.ord) as ord from en full join fr on fr.key = en.key")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.merge(en(rows), fr(rows))


@query("insert_absent", f"with {v.VALUES}, {v.EN}, {FR} select key, value from en union all select key, value from fr where key not in (select key from en)")
def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.insert_absent(en(rows), fr(rows))


@query("key_sync", f"with {v.VALUES}, {v.LOCALES}, {v.EN} select en.key, l.locale, en.value from en cross join locs l where en.key in (select key from vals where locale = 'fr') and not exists (select 1 from vals t where t.key = en.key and t.locale = l.locale)")
def key_sync(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return joins.sync_keys(rows.where("locale = 'fr'"), en(rows), rows, v.locales(spark, sf))


@query("locale_grid", f"with {v.GRID} select key, locale, value from grid")
def locale_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    return joins.grid(rows, v.locales(spark, sf), rows).select("key", "locale", "value")


@query("locale_diagnostics", f"with {v.DIAGNOSTICS} select key, locale, code from diag")
def locale_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf))


@query("missing_default", f"with {v.DIAGNOSTICS} select key, locale from diag where code = 'missing-default'")
def missing_default(spark: SparkSession, sf: str) -> DataFrame:
    return joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf)).where("code = 'missing-default'").select("key", "locale")


@query("health_pivot", f"""with {v.DIAGNOSTICS} select locale, count(*) filter (code = 'missing-default') as missing_default, count(*) filter (code = 'untranslated-missing') as untranslated_missing,
count(*) filter (code = 'untranslated-same') as untranslated_same, count(*) filter (code = 'placeholders') as placeholders, count(*) as total from diag group by locale""")
def health_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return reports.health(joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf)), "locale")


@query("code_histogram", f"with {v.DIAGNOSTICS} select code, count(*) as n from diag group by code")
def code_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf)), "code")


@query("top_files", f"with {v.CATALOG} select file, count(*) as n from catalog group by file order by n desc, file limit 100")
def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top(reports.histogram(v.catalog(spark, sf), "file"), "file", 100)


@query("issues_by_file", f"with {v.DIAGNOSTICS} select locale, split_part(key, '.', 1) as file, count(*) as n, min(key) as first_key from diag group by all")
def issues_by_file(spark: SparkSession, sf: str) -> DataFrame:
    issues = joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf)).withColumn("file", F.split_part("key", F.lit("."), F.lit(1)))
    return reports.issues_by_file(issues).select("locale", "file", "n", F.col("issues")[0]["key"].alias("first_key"))


@query("leaves_by_root", f"with {v.VALUES} select split_part(key, '.', 1) as root, count(*) as leaves from vals group by 1")
def leaves_by_root(spark: SparkSession, sf: str) -> DataFrame:
    return reports.leaves_by_root(v.values(spark, sf))


@query("constant_across_locales", f"with {v.COARSE}, {v.EN} select t.key, count(distinct t.locale) as locales from vals t join en on en.key = t.key where t.locale <> 'en' and t.value = en.value group by t.key")
def constant_across_locales(spark: SparkSession, sf: str) -> DataFrame:
    return reports.constants(v.coarse(spark, sf))


@query("translation_reuse", f"""with {v.COARSE}, {v.EN}, b as (select key, value as text from en where value <> '') select b.text, t.locale, arg_min(t.value, t.ord) as translation from b join vals t on t.key = b.key
where t.locale <> 'en' and t.value <> '' group by b.text, t.locale""")
def translation_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return joins.reuse(v.coarse(spark, sf))


@query("missing_default_repair", f"""with {v.COARSE}, s as (select key, locale, value, ord, (case locale when 'en' then 30 when 'en-US' then 20 when 'en-GB' then 10 else 0 end) + (case when trim(value) <> '' then 5 else 0 end)
+ (case when regexp_matches(value, 'TODO|FIXME|placeholder') then 0 else 3 end) + (case when length(value) between 3 and 200 then 2 else 0 end) as score from vals where locale <> 'en' and trim(value) <> ''
and key not in (select key from vals where locale = 'en' and trim(value) <> '')) select key, locale, value, score from (select *, row_number() over (partition by key order by score desc, ord) as r from s) where r = 1""")
def missing_default_repair(spark: SparkSession, sf: str) -> DataFrame:
    return joins.repair_defaults(v.coarse(spark, sf))


@query("best_locale", f"""with {v.VALUES}, s as (select key, locale, value, ord, (case locale when 'en' then 30 else 0 end) + (case when trim(value) <> '' then 5 else 0 end)
+ (case when regexp_matches(value, 'TODO|FIXME|placeholder') then 0 else 3 end) + (case when length(value) between 3 and 200 then 2 else 0 end) as score from vals)
select key, locale, value, score from (select *, row_number() over (partition by key order by score desc, ord) as r from s) where r = 1""")
def best_locale(spark: SparkSession, sf: str) -> DataFrame:
    return joins.best_locale(v.values(spark, sf))


@query("optimistic_updates", f"""with {v.COARSE}, report as (select key, locale, case when ord % 2 = 0 then value else value || '!' end as cur, value || '*' as suggested from vals where locale <> 'en')
select t.key, t.locale, t.value, r.suggested from vals t join report r on r.key = t.key and r.locale = t.locale where t.value = r.cur and r.suggested <> t.value""")
def optimistic_updates(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    report = rows.where("locale <> 'en'").select("key", "locale", F.when(F.col("ord") % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit("!"))).alias("current"), F.concat("value", F.lit("*")).alias("suggested"))
    return joins.optimistic(rows, report)


@query("report_invalidation", f"with {v.DIAGNOSTICS} select key, locale, code from diag where key not in (select key from vals where locale = 'de')")
def report_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    return joins.without(joins.diagnostics(rows, v.locales(spark, sf)), rows.where("locale = 'de'"))


@query("prefix_search", "select p_name as name from part where starts_with(p_name, 'red') order by p_name, p_partkey limit 200")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "part").where(F.col("p_name").startswith("red")).orderBy("p_name", "p_partkey").limit(200).select(F.col("p_name").alias("name"))


@query("locale_set", "select distinct lang as locale from documents union select 'en' union select 'fr-CA'")
def locale_set(spark: SparkSession, sf: str) -> DataFrame:
    return v.locales(spark, sf).union(spark.createDataFrame([("en",), ("fr-CA",)], "locale string")).distinct()


@query("still_missing", f"with {v.VALUES} select key from vals where locale = 'en' except select key from vals where locale = 'de'")
def still_missing(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return rows.where("locale = 'en'").select("key").exceptAll(rows.where("locale = 'de'").select("key"))


@query("default_locale_first", f"with {v.LOCALES} select locale, row_number() over (order by locale <> 'en', locale) as place from locs")
def default_locale_first(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    return v.locales(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.col("locale") != "en", "locale")).cast("long"))


@query("target_files", f"with {v.VALUES} select key, case when split_part(key, '.', 1) = 'Commons' then 'common.json' else lower(split_part(key, '.', 1)) || '.json' end as file from (select distinct key from vals)")
def target_files(spark: SparkSession, sf: str) -> DataFrame:
    return v.values(spark, sf).select("key").distinct().withColumn("file", fn.target_file(F.col("key")))


@query("runtime_lookup", f"with {v.VALUES}, {v.EN}, {FR} select en.key, coalesce(fr.value, en.key) as text from en left join fr on fr.key = en.key")
def runtime_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    return en(rows).select("key").join(fr(rows).select("key", "value"), "key", "left").select("key", F.coalesce("value", "key").alias("text"))


@query("backing_flags", f"with {v.CATALOG} select key, bool_or(regexp_matches(file, '\\.json$')) as json, bool_or(regexp_matches(file, '/lang/.*\\.php$')) as lang, bool_or(regexp_matches(file, '\\.resx$')) as resx, bool_or(regexp_matches(file, '\\.po$')) as po from catalog group by key")
def backing_flags(spark: SparkSession, sf: str) -> DataFrame:
    return cat.backing(v.catalog(spark, sf))


@query("tombstone_filter", f"with {v.VALUES}, dead as (select key, timestamp '2024-01-01 12:00:00' - to_minutes(cast(ord % 180 as integer)) as deleted_at from vals where locale = 'fr') select key, value from vals where locale = 'en' and key not in (select key from dead where deleted_at > timestamp '2024-01-01 11:00:00')")
def tombstone_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.values(spark, sf)
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    dead = rows.where("locale = 'fr'").select("key", (now - F.make_interval(mins=(F.col("ord") % 180).cast("int"))).alias("deleted_at"))
    return joins.not_deleted(en(rows), dead, now).select("key", "value")


@query("ignore_list_filter", f"with {v.VALUES} select key, value from vals v where not exists (select 1 from benchmark b where trim(regexp_replace(b.text, '\\s+', ' ', 'g')) = trim(regexp_replace(v.value, '\\s+', ' ', 'g')))")
def ignore_list_filter(spark: SparkSession, sf: str) -> DataFrame:
    ignored = v.read(spark, sf, "benchmark").select(fn.collapse(F.col("text")).alias("t")).distinct()
    return v.values(spark, sf).withColumn("t", fn.collapse(F.col("value"))).join(ignored, "t", "left_anti").select("key", "value")


@query("namespace_files", f"with {v.CATALOG} select split_part(key, '.', 1) as ns, arg_min(file, ord) as file from catalog group by 1")
def namespace_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.catalog(spark, sf).withColumn("ns", F.split_part("key", F.lit("."), F.lit(1)))
    return rows.groupBy("ns").agg(F.min_by("file", "ord").alias("file"))


_HOLES = f"{v.VALUES}, h as (select key, locale, 'Hi {{n' || (ord % 3) || '}}' as value from vals)"


@query("placeholder_mismatch", f"with {_HOLES} select t.key, t.locale from h t join h s on s.key = t.key and s.locale = 'en' where t.locale <> 'en' and t.value <> s.value")
def placeholder_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Translations whose placeholders differ from their source's, as sets."""
    rows = v.values(spark, sf).withColumn("value", F.concat(F.lit("Hi {n"), (F.col("ord") % 3).cast("string"), F.lit("}")))
    return joins.diagnostics(rows, v.locales(spark, sf)).where("code = 'placeholders'").select("key", "locale")


@query("keys_in_locales", f"with {v.VALUES} select locale, count(*) as keys, count(*) filter (trim(value) = '') as blank, min(length(value)) as shortest, max(length(value)) as longest from vals group by locale")
def keys_in_locales(spark: SparkSession, sf: str) -> DataFrame:
    return v.values(spark, sf).groupBy("locale").agg(F.count(F.lit(1)).alias("keys"), F.count_if(cat.blank(F.col("value"))).alias("blank"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"))


@query("selection_review", f"with {v.DIAGNOSTICS} select key, string_agg(distinct locale, ',' order by locale) as locales from diag where code like 'untranslated%' and key in (select key from vals where locale = 'es') group by key")
def selection_review(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.coarse(spark, sf)
    d = joins.diagnostics(rows, v.locales(spark, sf)).where("code like 'untranslated%'")
    return joins.only(d, rows.where("locale = 'es'")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("locale")), ",").alias("locales"))
