"""Queries over projects: files scanned from a folder, settings, ignore lists, and operators that settings steer."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import validate as val
from ..operators import extract, joins, recovery, references, reports, rewrites
from ..sources import locales as src
from ..sources import sinks
from ..sources.scratch import scratch, spread
from ..streaming.state import until_stable
from . import views as v
from .registry import query
from .scalars import PARTS, code, parts

lit = F.lit
#: Bytes beyond which the scanned pages are too large.
LARGE = 6000


def _tree(spark: SparkSession, sf: str) -> str:
    """A folder with a file per page: most below src, every seventh in a folder that scans don't enter."""
    pages, path = v.read(spark, sf, "pages").select("page_id", F.col("html").alias("value")), scratch(spark, "tree")
    for folder, rows in (("src/pages", pages.where("page_id % 7 <> 0")), ("src/node_modules/pages", pages.where("page_id % 7 = 0"))):
        # a task's files go to their place when it ends; by the other algorithm the driver would move them all, one by one
        spread(rows, "page_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("page_id").text(f"{path}/{folder}")
    return path


@query("scanned_files", f"select page_id, html || chr(10) as text from pages where page_id % 7 <> 0 and strlen(html) < {LARGE}")
def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages from a folder of files, but for large ones and those in a pruned folder."""
    files = src.scan(spark, _tree(spark, sf), "*.txt", LARGE)
    return files.select(F.regexp_extract("path", r"page_id=([0-9]+)", 1).cast("long").alias("page_id"), "text")


@query("skipped_files", f"select count(*) filter (strlen(html) >= {LARGE}) as skipped, count(*) as files from pages where page_id % 7 <> 0")
def skipped_files(spark: SparkSession, sf: str) -> DataFrame:
    return src.skipped(spark, _tree(spark, sf), "*.txt", LARGE)


@query("scanned_calls", f"with {PARTS} select distinct p_size % 5 as folder, 'shop.' || word as key from parts where p_size % 5 <> 0")
def scanned_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls in scanned source files; files in a build folder don't count. Parts go to as many files as the scan's limit of size needs."""
    path = scratch(spark, "sources")
    files = code(spark, sf).join(v.read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select((F.col("p_size") % 5).alias("folder"), F.col("text").alias("value"))
    longest = files.agg(F.max(F.octet_length("value"))).first()[0] or 0
    write = lambda rows, to: rows.write.option("maxRecordsPerFile", max(src.MAX_BYTES // (longest + 1), 1)).partitionBy("folder").text(f"{path}/{to}")
    write(files.where("folder <> 0"), "src")
    write(files.where("folder = 0"), "src/dist")
    found = extract.calls(src.scan(spark, path, "*.txt").withColumnRenamed("path", "file"))
    return found.select(F.regexp_extract("file", r"folder=([0-9]+)", 1).cast("int").alias("folder"), "key").distinct()


@query("project_settings", """select p_partkey, case p_size % 3 when 0 then lower(p_brand) when 1 then lower(split_part(p_name, ' ', 1)) else 'en' end as base, case when p_size % 2 = 0 then 'grouped' else 'single' end as layout, p_type as folder,
case p_size % 3 when 0 then 2 else 1 end as locales from part""")
def project_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Settings of a package file per part: base locale with its fallbacks, layout, folder of locales."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [(k, p.base, p.layout, p.locales_dir, len(p.locales)) for k, t in zip(x["p_partkey"], x["text"], strict=True) for p in [src.Project.read(t)]]
            yield pd.DataFrame(rows, columns=["p_partkey", "base", "layout", "folder", "locales"])

    p = v.read(spark, sf, "part")
    base = F.when(F.col("p_size") % 3 == 0, F.concat(lit('"sourceLocale": "'), F.lower("p_brand"), lit('", "defaultLocale": "xx", "locales": ["xx", "yy"],'))).when(F.col("p_size") % 3 == 1, F.concat(lit('"defaultLocale": "'), F.lower(F.split_part("p_name", lit(" "), lit(1))), lit('", // own\n'))).otherwise("")
    layout = F.when(F.col("p_size") % 2 == 0, '"localeLayout": "grouped"').otherwise('"layout": "single", "localeLayout": "grouped"')
    text = F.concat(lit('{"name": "'), "p_name", lit('", "i18n": {'), base, layout, lit(', "localesDir": "'), "p_type", lit('",}}'))
    return p.select("p_partkey", text.alias("text")).mapInPandas(run, "p_partkey long, base string, layout string, folder string, locales int")


def _project(spark: SparkSession, sf: str, setting: str) -> src.Project:
    """A project whose setting names the nations of one region, as a package file would."""
    names = v.read(spark, sf, "nation").where("n_regionkey = 1").agg(F.array_sort(F.collect_list(F.concat(lit("say." if setting == "messagePatterns" else ""), F.lower(F.replace("n_name", lit(" "), lit("")))))).alias("n"))
    text = names.select(F.concat(lit('{"i18n": {"'), lit(setting), lit('": '), F.to_json("n"), lit("}}")).alias("t")).first().t  # one row of a few names
    return src.Project.read(text)


_NATIONS = "nations as (select n_nationkey, n_regionkey, lower(replace(n_name, ' ', '')) as name from nation)"


@query("configured_calls", f"with {_NATIONS} select cast(n_nationkey as varchar) as file, 1 as line, 'app.' || name as key from nations where n_regionkey = 1 union all select cast(n_nationkey as varchar), 2, 'own.' || name from nations")
def configured_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by names that a project's settings list."""
    project, name = _project(spark, sf, "messagePatterns"), F.lower(F.replace("n_name", lit(" "), lit("")))
    text = F.concat(lit("say."), name, lit("('app."), name, lit("')\nx = t('own."), name, lit("') + mysay."), name, lit("('no."), name, lit("')"))
    files = v.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("file"), text.alias("text"))
    return extract.calls(files, extract.call_pattern(project.message_calls))


@query("configured_properties", f"with {_NATIONS} select cast(n_nationkey as varchar) as file, 'Text of ' || name as text from nations where n_regionkey = 1")
def configured_properties(spark: SparkSession, sf: str) -> DataFrame:
    project, name = _project(spark, sf, "tsExtractKeys"), F.lower(F.replace("n_name", lit(" "), lit("")))
    text = F.concat(lit("x = { "), name, lit(": 'Text of "), name, lit("', other: 'no' }"))
    files = v.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("file"), text.alias("text"))
    return extract.properties(files, project.extract_keys)


@query("unignored_lines", """with l as (select doc_id, cast(unnest(range(len(string_split(text, chr(10))))) as integer) as line, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) as t from documents),
e as (select trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) as t, item_id from benchmark) select doc_id, line from l where not exists (select 1 from e where e.t = l.t and e.item_id % 2 = 0) and not exists (select 1 from e where lower(e.t) = lower(l.t) and e.item_id % 2 = 1) and not contains(t, 'http')""")
def unignored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents that ignore files don't name: one file per benchmark item, and one with a part of texts."""
    lists = F.transform(F.split("text", "\n"), fn.collapse)
    shout = lambda x: F.translate(x, ascii_lowercase, ascii_uppercase)  # noqa: E731  # upper() would make SS of ß, which lower() doesn't undo
    own = v.read(spark, sf, "benchmark").select(F.to_json(F.struct(F.when(F.col("item_id") % 2 == 0, lists).alias("exact"), F.when(F.col("item_id") % 2 == 1, F.transform(lists, shout)).alias("exactInsensitive"))).alias("text"))
    files = own.unionByName(v.read(spark, sf, "region").limit(1).select(lit('{"contains": ["http"]}').alias("text")))
    lines = v.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return val.unignored(lines, src.ignore_lists(files)).select("doc_id", "line")


@query("work_done_once", """with n as (select conv_id, turn, 'en::' || role || '::' || lower(trim(regexp_replace(left(text, 12), '\\s+', ' ', 'g'))) as k, left(text, 12) as text, conv_id * 1000 + turn as ord from conversations)
select conv_id, turn, reverse(first_value(text) over (partition by k order by ord)) as result from n""")
def work_done_once(spark: SparkSession, sf: str) -> DataFrame:
    """Work done once per distinct beginning of a turn, by role, fanned out to all turns."""
    items = v.read(spark, sf, "conversations").select("conv_id", "turn", lit("en").alias("source"), F.col("role").alias("target"), F.left("text", lit(12)).alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return joins.deduplicated_work(items, lambda once: once.withColumn("result", F.reverse("text"))).select("conv_id", "turn", "result")


@query("missing_call_count", f"with {PARTS} select count(*) as n, count(distinct p_partkey) as files from parts where word not in (select word from parts where p_partkey % 3 = 0)")
def missing_call_count(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = parts(spark, sf).where("p_partkey % 3 = 0").select(lit("en").alias("locale"), lit("/locales/en.json").alias("file"), F.concat(lit("shop."), "word").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").cast("long").alias("ord"))
    return reports.reference_count(references.missing_references(code(spark, sf).select("file", "text"), catalogue))


@query("reported_unused", "select count(distinct r_name) + 0::bigint as unused from region")
def reported_unused(spark: SparkSession, sf: str) -> DataFrame:
    """The number of unused keys, read from a written report."""
    return reports.reported_unused(sinks.report(v.read(spark, sf, "region").select(F.col("r_name").alias("key")), v.read(spark, sf, "nation").select(F.col("n_name").alias("key"))))


@query("escaped_patterns", r"select page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') as pattern, true as found from pages")
def escaped_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses as patterns, each of which matches its address."""
    p = v.read(spark, sf, "pages").withColumn("pattern", fn.escape_regex(F.col("url")))
    return p.select("page_id", "pattern", F.regexp("url", F.concat(lit("^"), "pattern", lit("$"))).alias("found"))


@query("template_analysis", r"""with t as (select conv_id, turn, regexp_replace(text, ' (t[a-z]+)', ' ${ item.\1 }', 'g') as t from conversations)
select conv_id, turn, array_to_string(string_split_regex(t, '\$\{[^}]+\}'), '|') as statics, array_to_string(list_transform(regexp_extract_all(t, '\$\{([^}]+)\}', 1), lambda x: trim(x)), '|') as expressions,
trim(regexp_replace(array_to_string(string_split_regex(t, '\$\{[^}]+\}'), ' '), '\s+', ' ', 'g')) as base from t""")
def template_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Constant parts and expressions of template literals."""
    t = fn.template_parts(F.regexp_replace("text", " (t[a-z]+)", r" \${ item.$1 }"))
    found = v.read(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"))
    return found.select("conv_id", "turn", F.array_join("t.statics", "|").alias("statics"), F.array_join("t.expressions", "|").alias("expressions"), F.col("t.base").alias("base"))


_CALL = """'t(''shop.' || word || ''', { a: "' || p_name || ' )", b: [1, f({ c: `)` })] })'"""


@query("call_ends", f"with {PARTS} select cast(p_partkey as varchar) as file, 4::bigint as start, 4::bigint + length({_CALL}) as \"end\", {_CALL} as call from parts")
def call_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Where calls end whose arguments hold brackets, quotes and other calls."""
    call = F.concat(lit("t('shop."), "word", lit("', { a: \""), "p_name", lit(' )", b: [1, f({ c: `)` })] })'))
    return extract.call_bounds(parts(spark, sf).select(F.col("p_partkey").alias("file"), F.concat(lit("x = "), call, lit(" + part(y) + z")).alias("text")))


@query("selection_keys", f"""with {PARTS}, s as (select 'Please buy ' || p_name || ' now.' as value from parts), k as (select 'Shop.text.' || array_to_string(list_slice(regexp_extract_all(lower(value), '[a-z0-9]+'), 1, 4), '_') as key, value from s),
old as (select 'Shop.text.please_buy_' || replace(lower(split_part(p_name, ' ', 1)), '_', '') || '_' || lower(split_part(p_name, ' ', 2)) as key, 'there' as value from part where p_partkey % 10 = 0), o as (select distinct key, value from old)
select key, min(value) as value from k where key not in (select key from o) group by key union all select key, value from o""")
def selection_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys for the texts of selected markup, put into a catalogue that has some."""
    text = F.concat(lit('<b title="Please buy '), "p_name", lit(' now.">'))
    files = parts(spark, sf).select(F.col("p_partkey").cast("string").alias("file"), text.alias("text"))
    w = lambda n: F.lower(F.split_part("p_name", lit(" "), lit(n)))
    old = parts(spark, sf).where("p_partkey % 10 = 0").select(F.concat(lit("Shop.text.please_buy_"), w(1), lit("_"), w(2)).alias("key"), lit("there").alias("value")).distinct()
    return recovery.keys_of_selections(files, old, "Shop")


@query("settled_references", f"with {PARTS} select distinct 'shop.' || word as key from parts")
def settled_references(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue after passes that drop keys without a call and add calls without a key, until their numbers stay the same."""
    calls = extract.calls(code(spark, sf)).select("key").distinct()
    start = v.read(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(lit("shop."), F.split_part("p_name", lit(" "), lit(2))).alias("key")).distinct()

    def step(keys: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
        unused, missing = joins.without(keys, calls), calls.join(keys, "key", "left_anti")
        return keys.join(unused, "key", "left_anti").unionByName(missing), (unused.count(), missing.count())

    return until_stable(step, start, most=3)


_REACT = [
    ('"use client"\nconst errorMessage = ', "'@ one'", "t('#.1')"), ("; const x = { title: ", '"@ two"', "t('#.2')"), (", size: 'no' };\ntoast.success(", "'@ three'", "t('#.3')"), (");\nfunction f() { return ", "'@ four'", "t('#.4')"),
    (";\n}\nexport default () => <div title=", '"@ five"', "{t('#.5')}"), (" placeholder={ok ? ", "'@ six'", "t('#.6')"), (" : t('a.b')}><p> ", "@ seven", "{t('#.7')}"), (" </p>{", '"@ eight"', "t('#.8')"), ("}<b>{t('x.y')}</b></div>;\n", "", ""),
]
_VUE = [
    ("<template><h1 ", 'title="@ one"', ":title=\"$t('#.1')\""), (' :alt="', "'@ two'", "$t('#.2')"), ('">', "@ three", "{{ $t('#.3') }}"), ("</h1><i v-text=\"", "'@ four'", "$t('#.4')"), ('"></i><b>{{ $t(\'x.y\') }}</b>{{ ok ? ', '"@ five"', "$t('#.5')"), (" : n }}</template>", "", ""),
]
_TENS = "one two three four five six seven eight".split()


def _component(form: list[tuple[str, str, str]], new: bool) -> str:
    return "".join(a + (c if new else b) for a, b, c in form)


def _written(form: list[tuple[str, str, str]], head: str) -> str:
    """SQL of a component after its rewriting: @ stands for the name, # for the number."""
    quoted = _component(form, True).replace('"use client"\n', '"use client"\n' + head).replace("'", "''")
    return "replace(replace('" + quoted + "', '@ ', p_name || ' ' || p_partkey || ' '), '#', 'k' || p_partkey)"


def _rewritten(spark: SparkSession, sf: str, form: list[tuple[str, str, str]], framework: str) -> DataFrame:
    p = parts(spark, sf)
    fill = lambda t: F.replace(lit(t), lit("@"), F.concat("p_name", lit(" "), F.col("p_partkey").cast("string")))
    files = p.select(F.col("p_partkey").cast("string").alias("file"), fill(_component(form, False)).alias("text"))
    numbers = F.explode(F.array(*[F.struct(lit(w).alias("word"), lit(str(i + 1)).alias("n")) for i, w in enumerate(_TENS[: len(form) - 1])])).alias("x")
    keys = p.select("p_name", "p_partkey", numbers).select(F.concat("p_name", lit(" "), F.col("p_partkey").cast("string"), lit(" "), "x.word").alias("text"), F.concat(lit("k"), F.col("p_partkey").cast("string"), lit("."), "x.n").alias("key"))
    return rewrites.rewritten(files, keys, framework)


@query("rewritten_react", f"select cast(p_partkey as varchar) as file, {_written(_REACT, rewrites.IMPORT)} as text from part")
def rewritten_react(spark: SparkSession, sf: str) -> DataFrame:
    """Components whose texts stand in all kinds of places, as calls, with the import."""
    return _rewritten(spark, sf, _REACT, "react")


@query("rewritten_vue", f"select cast(p_partkey as varchar) as file, {_written(_VUE, '')} as text from part")
def rewritten_vue(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, _VUE, "vue")


@query("written_reports", f"""with {PARTS}, l as (select unnest(['de', 'fr']) as locale), i as (select case when p_partkey % 3 = 0 then 'style' else 'untranslated' end as type, locale, 'shop.' || word as key, p_partkey from parts, l where p_partkey % 2 = 0 or locale = 'fr'),
u as (select 'shop.' || word as key, p_partkey as file from parts), f as (select distinct i.locale, u.file from i join u on u.key = i.key where i.type = 'untranslated')
select 'combined' as report, locale, count(*) as n from i group by locale union all select type, locale, count(*) from i group by type, locale union all select 'compact', locale, count(*) from f group by locale""")
def written_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Four reports of issues, written and read back: issues, or ranges in source, by report and locale."""
    locales = F.explode(F.array(lit("de"), lit("fr"))).alias("locale")
    p = parts(spark, sf).select("p_partkey", "p_name", "word", locales).where("p_partkey % 2 = 0 or locale = 'fr'")
    kind = F.when(F.col("p_partkey") % 3 == 0, "style").otherwise("untranslated")
    issues = p.select(kind.alias("type"), "locale", F.concat(lit("locales/"), "locale", lit(".json")).alias("locale_file"), F.concat(lit("shop."), "word").alias("key"), F.col("p_name").alias("english"), lit("").alias("current"), F.when(kind == "style", F.col("word")).alias("suggested"))
    path = scratch(spark, "reports")
    sinks.write_reports(issues, extract.calls(code(spark, sf)), path)
    n = lambda name, count: spark.read.json(f"{path}/{name}").groupBy("locale").agg(F.sum(count).cast("long").alias("n")).select(lit(name).alias("report"), "locale", "n")
    return n("combined", lit(1)).unionByName(n("untranslated", F.size("issues"))).unionByName(n("style", F.size("issues"))).unionByName(n("compact", F.size("issues")))


@query("health_report", f"""with {v.DIAGNOSTICS}, h as (select locale, count(*) filter (code = 'missing-default') as a, count(*) filter (code = 'untranslated-missing') as b, count(*) filter (code = 'untranslated-same') as c, count(*) filter (code = 'placeholders') as d, count(*) as n from diag group by locale)
select '| locale | missing_default | untranslated_missing | untranslated_same | placeholders | total |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || locale || ' | ' || a || ' | ' || b || ' | ' || c || ' | ' || d || ' | ' || n || ' |', chr(10) order by locale) as text from h""")
def health_report(spark: SparkSession, sf: str) -> DataFrame:
    """The health report's Markdown."""
    return reports.markdown(reports.health(joins.diagnostics(v.coarse(spark, sf), v.locales(spark, sf)), "locale"))
