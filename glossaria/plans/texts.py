"""Queries over texts: extraction from pages and documents, predicates, and scalar functions on keys and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import validate as val
from ..operators import catalog as cat
from ..operators import extract, fuzzy, joins, reports
from ..sources.scratch import spread
from . import cascade
from . import views as v
from .registry import query

pages = lambda spark, sf: v.read(spark, sf, "pages")
_ROWS = "rows as (select doc_id, cast(unnest(range(len(string_split(text, chr(10))))) as integer) as line, trim(unnest(string_split(text, chr(10)))) as t from documents)"
BODY = "regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g')"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document, without blanks around it: doc_id, line, t."""
    return v.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", F.trim("t"))


@query("html_texts", f"select page_id, cast(pos as integer) as pos, trim(t) as text from (select page_id, unnest(l) as t, unnest(range(len(l))) as pos from (select page_id, string_split(regexp_replace({BODY}, '<[^>]+>', chr(10), 'g'), chr(10)) as l from pages)) where regexp_matches(trim(t), '[a-zA-Z]')")
def html_texts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.html_texts(pages(spark, sf)).select("page_id", "pos", "text")


_TAG = "<([a-zA-Z][a-zA-Z0-9]*)(?:\\s[^<>]*)?>([^<>]+)</"
_TAGS = f"tags as (select page_id, lower(unnest(regexp_extract_all(html, '{_TAG}', 1))) as tag, trim(unnest(regexp_extract_all(html, '{_TAG}', 2))) as text from pages)"
_KINDS = " ".join(f"when '{t}' then '{k}'" for t, k in extract.TAG_KINDS.items())


@query("tag_texts", f"with {_TAGS} select page_id, tag, text, case tag {_KINDS} else 'text' end as kind from tags where text <> ''")
def tag_texts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.tag_texts(pages(spark, sf))


@query("kind_histogram", f"with {_TAGS} select case tag {_KINDS} else 'text' end as kind, count(*) as n from tags where text <> '' group by 1")
def kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(extract.tag_texts(pages(spark, sf)), "kind")


@query("html_attr_texts", "select page_id, unnest(regexp_extract_all(html, '\\shref=\"([^\"]*)\"', 1)) as value from pages")
def html_attr_texts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.attribute_values(pages(spark, sf), "href")


_REFS = "refs as (select page_id, unnest(regexp_extract_all(html, '\\shref=\"([^\"]*)\"', 1)) as ref from pages), known as (select distinct regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) as ref from pages)"


@query("path_refs_missing", f"with {_REFS} select page_id, ref from refs where ref not in (select ref from known)")
def path_refs_missing(spark: SparkSession, sf: str) -> DataFrame:
    refs = extract.attribute_values(pages(spark, sf), "href").withColumnRenamed("value", "ref")
    known = pages(spark, sf).select(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1).alias("ref")).distinct()
    return joins.without(refs, known, "ref").select("page_id", "ref")


@query("missing_reference_count", f"with {_REFS} select count(*) as n, count(distinct page_id) as files from refs where ref not in (select ref from known)")
def missing_reference_count(spark: SparkSession, sf: str) -> DataFrame:
    return path_refs_missing(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("files"))


_LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents)"


@query("usage_lines", f"with {_LINES} select cast(doc_id as varchar) as file, cast(pos + 1 as integer) as line, key from (select doc_id, pos, unnest(regexp_extract_all(line, '\\bth(\\w+)', 1)) as key from lines)")
def usage_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences by line; the words in `th` stand for calls in the driver's prose."""
    lines = v.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("file", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"\bth(\w+)"), F.lit(1))).alias("key"))


@query("usage_ranges", f"with {_LINES}, u as (select doc_id, pos + 1 as line, unnest(regexp_extract_all(line, '\\bth(\\w+)', 1)) as key from lines) select cast(doc_id as varchar) as file, cast(min(line) as integer) as first_line, cast(max(line) as integer) as last_line, count(*) as n from u group by doc_id")
def usage_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return reports.line_ranges(usage_lines(spark, sf), ["file"])


@query("key_source_index", f"with {_LINES}, u as (select doc_id, unnest(regexp_extract_all(line, '\\bth(\\w+)', 1)) as key from lines) select key, count(distinct doc_id) as files from u group by key")
def key_source_index(spark: SparkSession, sf: str) -> DataFrame:
    return usage_lines(spark, sf).groupBy("key").agg(F.count_distinct("file").alias("files"))


@query("comment_range_anti")
def comment_range_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Texts between quotes outside comments, scripts and styles, by offset."""
    files = pages(spark, sf).select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))
    return joins.outside(extract.offsets(files, '"([^"<>]{3,})"'), extract.comment_ranges(files))


def _predicate(name: str, column, sql: str, table: str = "documents", key: str = "doc_id", expression=None, text: str | None = None) -> None:
    """A query of the rows whose text meets a predicate; of documents, every line is a row."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        if expression is None:
            return lines(spark, sf).where(column(F.col("t"))).select("doc_id", "line")
        return v.read(spark, sf, table).select(key, expression().alias("t")).where(column(F.col("t"))).select(key)

    run.__name__ = name
    query(name, f"with {_ROWS} select doc_id, line from rows where {sql}" if expression is None else f"with x as (select {key}, {text} as t from {table}) select {key} from x where {sql}")(run)


_never = ", ".join(f"'{w}'" for w in val.NEVER)
_labels = ", ".join(f"'{w}'" for w in val.LABELS)
_n = lambda p: f"len(regexp_extract_all(t, '{p}'))"
_BALANCED = f"{_n(chr(92) + '(')} = {_n(chr(92) + ')')} and {_n(chr(92) + '[')} = {_n(chr(92) + ']')} and {_n(chr(92) + '{')} = {_n(chr(92) + '}')} and ({_n(chr(39) * 2)} - {_n('[A-Za-z]' + chr(39) * 2 + '[A-Za-z]')}) % 2 = 0 and {_n(chr(34))} % 2 = 0"
_BASIC = f"length(t) >= 2 and regexp_matches(t, '\\p{{L}}') and not (not regexp_matches(t, '\\s') and lower(t) in ({_never}))"
_predicate("basic_requirements", val.basic, _BASIC)
_predicate("unbalanced_delimiters", lambda t: ~val.balanced(t), f"not ({_BALANCED})", table="pages", key="page_id", expression=lambda: F.col("html"), text="html")
_predicate("placeholder_only", lambda t: val.placeholder_only(t), "t = '' or not regexp_matches(t, '\\p{L}')", table="conversations", key="conv_id", expression=lambda: F.regexp_extract("text", "[0-9]+", 0), text="regexp_extract(text, '[0-9]+')")
_words = "list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')"
_one = f"regexp_replace({_words}[1], '[.,:;!?]+$', '')"
_predicate("human_text", val.human, f"""case when t = '' then false when regexp_matches(t, '[^\\x00-\\x7F]') and regexp_matches(t, '\\p{{L}}') then true
when len({_words}) = 1 then regexp_matches({_one}, '^[A-Z][a-zA-Z0-9'']*$') or (regexp_matches({_one}, '^[A-Z0-9_]+$') and regexp_matches({_one}, '[A-Z]')) or lower({_one}) in ({_labels})
else len(list_filter(list_transform({_words}, lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')), lambda w: regexp_matches(w, '(?i)[aeiou]') and length(w) >= 2)) >= len({_words}) * 0.5 end""")
_predicate("url_like", val.is_url, "regexp_matches(lower(t), '^(http|https|ftp)://')", table="pages", key="page_id", expression=lambda: F.col("url"), text="url")
_predicate("version_like", val.is_version, "regexp_matches(t, '(?i)^v?[0-9]+\\.[0-9]+(\\.[0-9]+)?(-[a-z0-9.-]+)?(\\+[a-z0-9.-]+)?$') or regexp_matches(t, '^[0-9]{4}\\.[0-9]{1,2}(\\.[0-9]+)?$')", table="orders", key="o_orderkey", expression=lambda: F.col("o_totalprice").cast("decimal(18,2)").cast("string"), text="cast(cast(o_totalprice as decimal(18,2)) as varchar)")
_predicate("query_string_like", val.is_query_string, "regexp_matches(t, '(?i)^[?&]?[a-z_][a-z0-9_]*=[^&\\s]*') or regexp_matches(t, '%[0-9A-F]{2}')", table="pages", key="page_id", expression=lambda: F.regexp_extract("url", r"\?.*$", 0), text="regexp_extract(url, '\\?.*$')")
_predicate("numeric_like", val.is_numeric, "regexp_matches(trim(t), '^[+-]?[0-9][0-9\\s.,()/-]*%?$')", table="orders", key="o_orderkey", expression=lambda: F.col("o_totalprice").cast("decimal(18,2)").cast("string"), text="cast(cast(o_totalprice as decimal(18,2)) as varchar)")
_predicate("common_short_text", fn.common_short, "trim(t) <> '' and len(string_split_regex(trim(t), '\\s+')) <= 2 and length(trim(t)) <= 24 and not regexp_matches(trim(t), '[.!?/]')", table="part", key="p_partkey", expression=lambda: F.col("p_name"), text="p_name")
_predicate("unbalanced_parens", lambda t: F.regexp_count(t, F.lit(r"\(")) != F.regexp_count(t, F.lit(r"\)")), f"{_n(chr(92) + '(')} <> {_n(chr(92) + ')')}", table="pages", key="page_id", expression=lambda: F.col("html"), text="html")


_LINE = f"lines as (select {cascade.PLAIN.format(t='trim(l)')} as t from (select unnest(string_split(text, chr(10))) as l from documents))"


@query("rejection_histogram", f"with {_LINE} select coalesce({cascade.REASON}, 'translatable') as reason, count(*) as n from lines group by 1")
def rejection_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons of the whole cascade over all lines."""
    rows = extract.translatable(lines(spark, sf).select(F.col("t").alias("text")))
    return reports.histogram(rows.select(F.coalesce("reason", F.lit("translatable")).alias("reason")), "reason")


@query("word_shapes", f"""with w as (select distinct unnest(string_split_regex(text, '[ \\n]+')) as t from documents union select distinct unnest(string_split_regex(html, '[ \\n<>"]+')) from pages union select url from pages),
s as (select t, array_to_string(list_filter([{", ".join(f"case when {c} then '{k}' end" for k, c in cascade.SHAPES.items())}], lambda x: x is not null), ',') as shapes from w) select t as word, shapes from s where shapes <> ''""")
def word_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of documents and pages that have a technical shape, with all of theirs."""
    tests = {
        "path": val.is_path, "uuid": val.is_uuid, "hex": val.is_hex_colour, "query": val.is_query_string, "version": val.is_version, "identifier": val.is_identifier, "env": val.is_env_var,
        "pair": val.is_config_pair, "argument": val.is_cli_argument, "dsn": val.is_dsn, "date": val.is_date_format, "numeric": val.is_numeric, "url": val.is_url,
    }
    p, d = spread(pages(spark, sf).select("page_id", "url", "html"), "page_id"), spread(v.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    words = d.select(F.explode(F.split("text", "[ \n]+")).alias("word")).union(p.select(F.explode(F.split("html", '[ \n<>"]+')))).union(p.select("url")).distinct()
    shapes = F.concat_ws(",", *[F.when(f(F.col("word")), k) for k, f in tests.items()])
    # the id holds the filter behind the distinct(), where it would judge every word of every text, and then once more those that stay
    return words.select("word", F.when(F.monotonically_increasing_id() >= 0, shapes).alias("shapes")).where("shapes <> ''")


@query("should_translate_texts", f"""with h as (select page_id, cast(pos as integer) as pos, trim(l) as text from (select page_id, unnest(l) as l, unnest(range(len(l))) as pos from (select page_id, string_split(regexp_replace({BODY}, '<[^>]+>', chr(10), 'g'), chr(10)) as l from pages)) where regexp_matches(trim(l), '[a-zA-Z]')),
x as (select page_id, pos, text, {cascade.PLAIN.format(t='text')} as t, trim(regexp_replace(text, '\\s+', ' ', 'g')) as c from h) select page_id, pos, text from x where {cascade.REASON} is null and c <> 'Home' and lower(c) <> 'menu' and not contains(c, '©')""")
def should_translate_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.html_texts(pages(spark, sf))
    return rows.where(val.should_translate(F.col("text"), exact=["Home"], any_case=["menu"], contains=["©"])).select("page_id", "pos", "text")


_ACC, _BAS = zip(*[(a, b) for a, b in zip(*fn.ACCENTS, strict=False) if b != "\0"], strict=True)
_PLAIN = f"regexp_replace(translate(t, '{''.join(_ACC)}', '{''.join(_BAS)}'), '[^\\x00-\\x7F]', '', 'g')"


@query("slugify_ascii", f"""with {_ROWS}, s as (select doc_id, line, array_to_string(list_slice(regexp_extract_all(lower({_PLAIN}), '[a-z0-9]+'), 1, 4), '_') as s from rows)
select doc_id, line, case when length(s) > 48 then regexp_replace(left(s, 48), '_+$', '') else s end as slug from s where s <> ''""")
def slugify_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(fn.has_slug(F.col("t"))).select("doc_id", "line", fn.slug(F.col("t")).alias("slug"))


@query("pascal_case", "select p_partkey, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(p_name, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') as name from part")
def pascal_case(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "part").select("p_partkey", fn.pascal(F.col("p_name")).alias("name"))


_PASCAL = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(s, '[_-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '')"


@query("namespace_from_path", f"""with p as (select page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) as path from pages), l as (select page_id, path, list_filter(string_split(regexp_replace(path, '\\.[^./]*$', ''), '/'), lambda s: s <> '') as l from p),
k as (select page_id, path, case when regexp_matches(l[-1], '^[A-Z][a-zA-Z0-9]*$') then l[:-2] else l end as l from l), n as (select page_id, path, array_to_string(list_filter(list_transform(l, lambda s: {_PASCAL}), lambda s: s <> ''), '.') as name from k)
select page_id, case when name = '' then 'Common' else name end as namespace, case when contains(path, '/resources/views/') then 'views' else lower(split_part(ltrim(path, '/'), '/', 1)) end as root from n""")
def namespace_from_path(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1)
    return pages(spark, sf).select("page_id", fn.namespace(path).alias("namespace"), fn.root_of(path).alias("root"))


@query("url_roots", "select page_id, lower(split_part(ltrim(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/'), '/', 1)) as root from pages")
def url_roots(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", fn.root_of(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1)).alias("root"))


@query("key_variations", f"with {v.VALUES}, k as (select distinct key from vals) select key, unnest(list_distinct([key, split_part(key, '.', 2) || '.' || split_part(key, '.', 3), split_part(key, '.', 3)])) as variant from k")
def key_variations(spark: SparkSession, sf: str) -> DataFrame:
    return v.values(spark, sf).select("key").distinct().select("key", F.explode(fn.key_variations(F.col("key"))).alias("variant"))


@query("label_from_segment", "select distinct event_type, upper(left(replace(event_type, '_', ' '), 1)) || substr(lower(replace(event_type, '_', ' ')), 2) as label from events")
def label_from_segment(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "events").select("event_type", fn.label(F.col("event_type")).alias("label")).distinct()


@query("slug_collisions", """with s as (select p_type as ns, split_part(p_name, ' ', 1) as slug, p_name as text, min(p_partkey) as ord from part group by all)
select ns, slug, text, case when n = 1 then slug else slug || '_' || n end as final from (select *, row_number() over (partition by ns, slug order by ord, text) as n from s)""")
def slug_collisions(spark: SparkSession, sf: str) -> DataFrame:
    items = v.read(spark, sf, "part").select(F.col("p_type").alias("ns"), F.lit("text").alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("slug"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    return cat.number_slugs(items).select("ns", "slug", "text", "final")


@query("typo_repair", """with k as (select distinct p_type as prefix, p_name as leaf from part), b as (select distinct p_type as prefix, p_name || 'x' as leaf from part),
m as (select b.prefix || '.' || b.leaf as key, k.prefix || '.' || k.leaf as repair, levenshtein(b.leaf, k.leaf) as distance, length(b.leaf) as n from b join k using (prefix))
select key, repair, distance from (select *, row_number() over (partition by key order by distance, repair) as r from m where distance <= greatest(2, n // 4)) where r = 1""")
def typo_repair(spark: SparkSession, sf: str) -> DataFrame:
    known = v.read(spark, sf, "part").select(F.concat_ws(".", "p_type", "p_name").alias("key"), "p_partkey")
    broken = known.select(F.concat("key", F.lit("x")).alias("key")).distinct()
    return joins.typo_repair(broken, known.select("key").distinct())


@query("edit_distance_topk", """select a.n_name as name, b.n_name as near, levenshtein(a.n_name, b.n_name) as distance from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey
qualify row_number() over (partition by a.n_name order by levenshtein(a.n_name, b.n_name), b.n_name) <= 3""")
def edit_distance_topk(spark: SparkSession, sf: str) -> DataFrame:
    n = v.read(spark, sf, "nation")
    pairs = n.select(F.col("n_name").alias("name"), "n_regionkey").join(n.select(F.col("n_name").alias("near"), "n_regionkey"), "n_regionkey").where("name <> near")
    return cat.top_n(pairs.withColumn("distance", F.levenshtein("name", "near").cast("long")), ["name"], [F.col("distance"), F.col("near")], 3).select("name", "near", "distance")


def _says(key: str, names: list[str]) -> str:
    return f"regexp_matches(lower({key}), '{'|'.join(names)}')"


_SUCCEED = [*fn.ACTION, *fn.SUCCESS, *fn.STATE]
_OPPOSED = " or ".join(
    [f"({_says(x, fn.FAILURE)} and {_says(y, _SUCCEED)})" for x, y in (("a.key", "b.key"), ("b.key", "a.key"))]
    + [f"(contains(lower({x}.key), '{p.split('-')[0]}') and contains(lower({y}.key), '{p.split('-')[1]}'))" for p in fn.OPPOSITES for x, y in ("ab", "ba")]
)
_LIKENESS = f"""k as (select distinct key, string_split(key, '.') as s from {{keys}}), p as (select a.key, b.key as other, a.s as x, b.s as y, {_OPPOSED} as opposed from k a join k b on a.s[1] = b.s[1] and a.key <> b.key),
l as (select key, other, case when abs(len(x) - len(y)) > 1 then 0.1 when opposed then 0.0 else greatest(0.0, least(1.0, len(list_intersect(x, y)) / greatest(len(x), len(y)) * 0.7 +
  (1 - list_max(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: levenshtein(coalesce(x[i], ''), coalesce(y[i], '')) / greatest(length(coalesce(x[i], '')), length(coalesce(y[i], '')), 1)))) * 0.3)) end as likeness from p),
best as (select key, other, round(likeness, 6) as score from l where round(likeness, 6) >= 0.6 qualify row_number() over (partition by key order by round(likeness, 6) desc, other) = 1)"""


@query("key_similarity", f"with {v.VALUES}, {_LIKENESS.format(keys='vals')} select key, other, score from best")
def key_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each key's most alike key with the same first segment, at 0.6 or more."""
    return fuzzy.best_alike(v.values(spark, sf))


_NAMED = "named as (select distinct lower(split_part(p_type, ' ', 1)) || '.' || replace(p_name, ' ', '.') as key from part)"


@query("part_name_similarity", f"with {_NAMED}, {_LIKENESS.format(keys='named')} select key, other, score from best")
def part_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The same over names of several words, whose segments repeat and move."""
    named = v.read(spark, sf, "part").select(F.concat_ws(".", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.replace("p_name", F.lit(" "), F.lit("."))).alias("key"))
    return fuzzy.best_alike(named)


@query("placeholder_sets", "select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, ' (t[a-z]+)', ' {\\1}', 'g'), '\\{([A-Za-z0-9_.]+)\\}', 1))), ',') as names from conversations")
def placeholder_sets(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(fn.placeholders(F.regexp_replace("text", " (t[a-z]+)", " {$1}")), ",").alias("names"))


@query("cache_keys", "select conv_id, turn, 'en::fr::' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as entry from conversations")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "conversations").select("conv_id", "turn", fn.cache_key(F.lit("en"), F.lit("fr"), F.col("text")).alias("entry"))


@query("distinct_phrases", """with n as (select role, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k, conv_id * 1000 + turn as ord, text from conversations) select role, k as phrase, arg_min(text, ord) as text, count(*) as n from n group by role, k""")
def distinct_phrases(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.read(spark, sf, "conversations").select("role", F.lower(fn.collapse(F.col("text"))).alias("phrase"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return rows.groupBy("role", "phrase").agg(F.min_by("text", "ord").alias("text"), F.count(F.lit(1)).alias("n"))


@query("relevance_scores", f"with {_ROWS} select doc_id, line, (case when contains(lower(t), 'the') then 10 else 0 end) + (case when contains(lower(t), 'and') then 10 else 0 end) + (case when regexp_matches(t, '^[A-Z]') then 2 else 0 end) + (case when regexp_matches(t, '[.!?]$') then 2 else 0 end) + (case when contains(t, ' ') then 1 else 0 end) + (case when length(t) between 5 and 100 then 2 else 0 end) as score from rows")
def relevance_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line", fn.relevance(F.col("t"), F.array(F.lit("the"), F.lit("and"))).alias("score"))


@query("typography", "select doc_id, replace(translate(text, '‘’“”–—', '''''\"\"--'), '…', '...') as text from documents")
def typography(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "documents").select("doc_id", fn.typography(F.col("text")).alias("text"))


@query("string_hashes", """with h as (select p_partkey, list_reduce(list_concat([0::bigint], list_transform(string_split(p_name, ''), lambda c: ord(c)::bigint)), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648) as h from part)
select p_partkey, left(lower(to_base(abs(h), 36)), 8) as hash from h""")
def string_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "part").select("p_partkey", fn.hash36(F.col("p_name")).alias("hash"))


@query("batch_by_chars", """with recursive x as (select role, conv_id * 1000 + turn as ord, length(text) as size, row_number() over (partition by role order by conv_id * 1000 + turn, text) as i from conversations),
b as (select role, ord, i, size, 1 as n, 0::bigint as batch from x where i = 1
  union all select x.role, x.ord, x.i, case when b.n >= 50 or b.size + x.size > 2000 then x.size else b.size + x.size end, case when b.n >= 50 or b.size + x.size > 2000 then 1 else b.n + 1 end, case when b.n >= 50 or b.size + x.size > 2000 then b.batch + 1 else b.batch end
  from b join x on x.role = b.role and x.i = b.i + 1)
select role, ord, batch from b""")
def batch_by_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of at most 50 texts or 2,000 characters by role, in order."""
    rows = v.read(spark, sf, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    return joins.batches(rows, "role").select("role", "ord", "batch")


@query("wrap_known_texts")
def wrap_known_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Known texts of tags rewritten to calls."""
    files = pages(spark, sf).select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))
    known = extract.tag_texts(pages(spark, sf)).where("tag = 'li' or tag = 'a'").select("text").distinct().withColumn("key", fn.key_of(F.lit("Views"), F.lit("text"), F.col("text")))
    return extract.wrap_texts(files, known)


_RUNS = "regexp_extract_all(w, '[bcdfghjklmnpqrstvwxz]{4,}')"
_STEPS = "len(list_filter(range(1, length(w)), lambda i: (contains('aeiouy', w[i]) and contains('bcdfghjklmnpqrstvwxz', w[i + 1])) or (contains('bcdfghjklmnpqrstvwxz', w[i]) and contains('aeiouy', w[i + 1]))))"
_PAIRS = "len(list_filter(range(1, length(w)), lambda i: regexp_matches(w[i:i + 1], '^[a-z][a-z]$')))"
_SPOKEN = f"""case when length(w) <= 2 then w in ({", ".join(f"'{x}'" for x in val.SHORT)}) else regexp_matches(w, '[aeiouy]')
  and not (length(w) >= 4 and ((len({_RUNS}) > 0 and len(list_filter({_RUNS}, lambda x: regexp_matches(x, '{"|".join(val.CLUSTERS)}'))) = 0) or regexp_matches(w, '[aeiouy]{{4,}}')))
  and not ({_PAIRS} > 0 and {_STEPS} < {_PAIRS} * 0.3) and not (length(w) > 4 and not regexp_matches(w, '{"|".join(val.BIGRAMS)}')) end"""


@query("english_words", f"""with l as (select lang, doc_id, unnest(range(len(string_split(text, chr(10))))) as line, trim(unnest(string_split(text, chr(10)))) as t from documents),
s as (select lang, doc_id, line, list_filter(string_split_regex(t, '[\\s,;.!?()\\[\\]{{}}]+'), lambda x: x <> '') as ws from l), u as (select lang, doc_id, line, lower(regexp_replace(unnest(ws), '^[''"]+|[''"]+$', '', 'g')) as w from s),
g as (select lang, doc_id, line, count(*) as n, count(*) filter ({_SPOKEN}) as good from u group by all)
select s.lang, count(*) filter (g.n > 0 and g.good >= g.n * 0.5) as english, count(*) as n from s left join g on g.doc_id = s.doc_id and g.line = s.line group by s.lang""")
def english_words(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by language, and those that sound like English."""
    d = spread(v.read(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").select("lang", F.explode(F.split("text", "\n")).alias("t"))
    return d.groupBy("lang").agg(F.count_if(val.english_text(F.trim("t"))).alias("english"), F.count(F.lit(1)).alias("n"))


_SHORTS = ", ".join(f"'{w}'" for w in val.SHORT)


@query("short_english_words", f"select distinct w from (select lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) as w from conversations) where length(w) = 2 and w in ({_SHORTS})")
def short_english_words(spark: SparkSession, sf: str) -> DataFrame:
    words = v.read(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) = 2").distinct()
    return words.where(val.english_word(F.col("w")))


@query("invalid_base_values", f"""with h as (select distinct trim(l) as text from (select unnest(string_split(regexp_replace({BODY}, '<[^>]+>', chr(10), 'g'), chr(10))) as l from pages) where regexp_matches(trim(l), '[a-zA-Z]')),
i as (select text, {cascade.INVALID} as invalid, {cascade.UTILITY} as utility from (select text, text as t from h)),
x as (select text, invalid, utility, {cascade.PLAIN.format(t="text")} as t from i), r as (select text, invalid, case when utility then 'css_utility' else {cascade.REASON} end as reason from x) select text, reason from r where invalid or reason is not null""")
def invalid_base_values(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of pages that a catalogue shouldn't hold, with the reason where the cascade names one."""
    rows = extract.html_texts(pages(spark, sf)).select("text").distinct()
    return rows.select("text", val.value_invalid(F.col("text")).alias("invalid"), val.base_reason(F.col("text")).alias("reason")).where("invalid or reason is not null").select("text", "reason")


@query("unreported_examples")
def unreported_examples(spark: SparkSession, sf: str) -> DataFrame:
    return extract.attribute_values(pages(spark, sf), "href").where(val.not_reported(F.col("value"))).distinct()
