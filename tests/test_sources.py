"""Readers, writers, extraction and rewriting on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from glossaria.operators import extract, joins, reports
from glossaria.sources import locales as src
from glossaria.sources import sinks


def test_jsonc():
    assert src.parse_jsonc('﻿{"a": "x // no", /* c */ "b": ["y",], }') == {"a": "x // no", "b": ["y"]}
    assert src.parse_jsonc("") == {} and src.parse_jsonc("{bad") is None
    assert src.json_error('{\n"a": }')[1] == 2


def test_walks():
    assert dict(src.walk_json({"a": {"b": "x", "n": 1}, "m": [{"id": "k", "translation": "y"}, {"key": "j", "message": "z"}]})) == {"a.b": "x", "m.k": "y", "m.j": "z"}
    po = 'msgid ""\nmsgstr "head"\n\nmsgid "Hello"\n"World"\nmsgstr "Bon"\n"jour"\n\nmsgid "one"\nmsgid_plural "many"\nmsgstr[0] "un"\nmsgstr[1] "des"\n'
    assert dict(src.walk_po(po)) == {"HelloWorld": "Bonjour", "one": "des"}
    assert dict(src.walk_resx('<data name="A" xml:space="preserve"><value>x &amp;\n y</value></data>')) == {"A": "x & y"}
    php = "<?php // c\nreturn [ 'a' => 'it\\'s', \"b\" => ['c' => 'd', 'n' => 3,], 'l' => array('m' => 'o') ];"
    assert dict(src.walk_php(php, "app")) == {"app.a": "it's", "app.b.c": "d", "app.l.m": "o"}


def test_scan(spark, tmp_path):
    (tmp_path / "locales").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "locales/fr.json").write_bytes(b'\xef\xbb\xbf{"a":{"b":"x"},}')
    (tmp_path / "locales/de_AT.json").write_bytes('{"a":{"b":"ü"}}'.encode("utf-16"))
    (tmp_path / "locales/big.json").write_text('{"a":"' + "x" * 3_000_000 + '"}')
    (tmp_path / "node_modules/en.json").write_text('{"a":"n"}')
    rows = src.catalog(src.scan(spark, str(tmp_path), "*.json")).select("locale", "key", "value").collect()
    assert sorted(map(tuple, rows)) == [("de-AT", "a.b", "ü"), ("fr", "a.b", "x")]
    assert src.skipped(spark, str(tmp_path), "*.json").first().skipped == 1


def test_project():
    p = src.Project.read('{"i18n": {"locales": ["en", "fr"], "defaultLocale": "fr", "localeLayout": "grouped"}}')
    assert (p.base, p.layout, p.locales) == ("fr", "grouped", ("en", "fr"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("en", "b.a", "1", 1), ("en", "a", "2", 0), ("en", "b", "leaf", 2)], "locale string, key string, value string, ord long")
    assert json.loads(sinks.documents(rows, ["locale"]).first().text) == {"a": "2", "b": {"a": "1"}}
    sinks.write_locales(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() > 1
    many = spark.range(200).select(F.lit("en").alias("locale"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), F.col("id").alias("ord"))
    with pytest.raises(ValueError, match="refusing"):
        sinks.write_locales(many.limit(100), str(tmp_path / "out"), many)
    assert "untranslated" in sinks.health_markdown(reports.histogram(rows, "locale").toPandas().rename(columns={"n": "untranslated"}))
    assert json.loads(sinks.report(rows.where("key = 'a'"), rows.limit(0)).first().text)["unused"] == ["a"]


def test_calls(spark):
    code = "import x from 'a.b'\nconst a = t('app.title') + $t(\"app.x\")\n// t('app.c')\nconst s = 'app.lit'"
    files = spark.createDataFrame([("f", code)], "file string, text string")
    assert [(r.line, r.key) for r in extract.calls(files).orderBy("line", "key").collect()] == [(2, "app.title"), (2, "app.x"), (3, "app.c")]
    keys = spark.createDataFrame([("app.lit",), ("app.title",)], "key string")
    assert sorted((r.line, r.key) for r in extract.usage(files, keys).collect()) == [(2, "app.title"), (4, "app.lit")]
    found = {r.text for r in extract.literals(spark.createDataFrame([("f", "x = 'Hello there'\nconsole.log('no no')\ny = \"Good day\"")], "file string, text string")).collect()}
    assert found == {"Hello there", "Good day"}


def test_rewrites(spark):
    files = spark.createDataFrame([("f", "<p>Hello there</p><b>Other</b>{{ __('x') }}")], "file string, text string")
    keys = spark.createDataFrame([("Hello there", "a.b")], "text string, key string")
    assert extract.wrap_texts(files, keys).first().text == '<p>{{ __("a.b") }}</p><b>Other</b>{{ __(\'x\') }}'
    react = spark.createDataFrame([("f", "<B title=\"Hello there\"> Hello there </B>; toast('Hello there')")], "file string, text string")
    done = extract.wrap_texts(react, keys, "react")
    assert done.first().text == "<B title={t('a.b')}> {t('a.b')} </B>; toast(t('a.b'))"
    assert extract.wrap_texts(done, keys, "react").first().text == done.first().text
    vue = spark.createDataFrame([("f", '<b title="Hello there">Hello there</b>')], "file string, text string")
    assert extract.wrap_texts(vue, keys, "vue").first().text == "<b :title=\"$t('a.b')\">{{ $t('a.b') }}</b>"
    one = spark.range(1).select(extract.collapse_defaults(F.lit("t('a', \"x\") + (t('b') || 'y')")).alias("c"), extract.line_of(F.lit("a\nb\nc"), F.lit(4)).alias("l"), extract.call_text("vue", F.lit("k")).alias("v")).first()
    assert (one.c, one.l, one.v) == ("t('a') + (t('b'))", 3, "{{ $t('k') }}")
    code = spark.createDataFrame([("f", "x = t('a.b') + t('c.d')")], "file string, text string")
    values = spark.createDataFrame([("a.b", "It's")], "key string, value string")
    assert extract.inline(code, values).first().text == "x = 'It\\'s' + t('c.d')"


def test_comments(spark):
    files = spark.createDataFrame([("f", 'a "one1" <!-- "two2" --> "three"')], "file string, text string")
    left = joins.outside(extract.offsets(files, '"([^"]{3,})"'), extract.comment_ranges(files))
    assert sorted(r.value for r in left.collect()) == ["one1", "three"]


def test_diff(spark):
    lines = ["--- a", "@@ -1 +1 @@", "-<p>Old text</p>", "+<p>{t('a.b')}</p>", "@@ -9 +9 @@", "-'other one'"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos int, line string")
    assert [(r.key, r.text) for r in joins.removed_texts(df).collect()] == [("a.b", "Old text")]


def test_translator(spark):
    def shy(texts, locale):
        if len(texts) > 1:
            raise ValueError("too many")
        if texts[0] == "bad":
            raise ValueError("no")
        return [t.upper() for t in texts]

    items = spark.createDataFrame([("fr", "a"), ("fr", "bad"), ("de", "c")], "locale string, source string")
    assert {(r.source, r.translation) for r in joins.translate(items, shy).collect()} == {("a", "A"), ("bad", None), ("c", "C")}


def test_key_lookup(spark):
    items = spark.createDataFrame([(1, "Home", "button", "Save"), (2, "Home", "heading", "Title"), (3, "X", "y", "none")], "id int, ns string, kind string, text string")
    keys = spark.createDataFrame([("Commons", "button", "Save", "Commons.button.save"), ("Home", "text", "Title", "Home.text.title")], "ns string, kind string, text string, key string")
    assert {r.id: r.key for r in joins.key_lookup(items, keys).collect()} == {1: "Commons.button.save", 2: "Home.text.title", 3: None}


def test_nested_lines(spark, tmp_path):
    """Lines of nested files against a tree in plain Python; UTF-16 order, prefixes, quotes, control characters."""
    import random

    rng = random.Random(3)
    parts = ["a", "b", "a-x", "ab", "é", "", "\U0001f600", "B", "10", "9", 'q"', "\\", "it's"]
    rows = [(rng.choice(["en", "fr"]), ".".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))), rng.choice(["v", 'say "hi"', "tab\tand\nline", "it's \\", ""])) for _ in range(300)] + [("de", "k", None), ("de", "only.one", "x")]
    df = spark.createDataFrame(rows, "locale string, key string, value string")
    want = {}
    for locale, key, value in rows:
        if value is not None:
            at = (locale, tuple(key.split(".")))
            want[at] = max(value, want.get(at, value))
    trees = {}
    for (locale, path), value in want.items():
        if any(o[0] == locale and len(o[1]) > len(path) and o[1][: len(path)] == path for o in want):
            continue
        node = trees.setdefault(locale, {})
        for p in path[:-1]:
            node = node.setdefault(p, {})
        node[path[-1]] = value
    deep = lambda x: {k: deep(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be"))} if isinstance(x, dict) else x
    got = {r.locale: r.text for r in sinks.documents(df, ["locale"]).collect()}
    assert got == {k: json.dumps(deep(t), ensure_ascii=False, indent=2) + "\n" for k, t in trees.items()}
    php = {r.locale: dict(src.walk_php(r.text)) for r in sinks.documents(df.where("key not like '%\\\\\\\\%' and value not like '%\\\\\\\\%'"), ["locale"], "php").collect()}
    assert php["de"] == {"only.one": "x"}
    sinks.write_locales(df, str(tmp_path / "out"))
    files = {p.parent.name.split("=")[1]: p.read_text() for p in (tmp_path / "out").glob("locale=*/part-*")}
    assert {k: json.loads(t) for k, t in files.items()} == {k: json.loads(t) for k, t in got.items()}
    before = sorted(p.name for p in (tmp_path / "out").rglob("*"))
    with pytest.raises(RuntimeError):
        sinks.swapped(spark, str(tmp_path / "out"), lambda staged: (spark.range(1).selectExpr("'x' as t").write.text(staged), (_ for _ in ()).throw(RuntimeError("no")))[0])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == before and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    ordered = spark.createDataFrame([("en", "b.x", "1", 0), ("en", "a", "2", 1), ("en", "b.c", "3", 2)], "locale string, key string, value string, ord long")
    assert json.loads(sinks.documents(ordered, ["locale"], sort=False).first().text) == {"b": {"x": "1", "c": "3"}, "a": "2"} and list(json.loads(sinks.documents(ordered, ["locale"], sort=False).first().text)) == ["b", "a"]


def test_rewrite_families(spark):
    from glossaria.operators import rewrites

    react = "const errorMessage = \"It failed\";\nconst x = { title: 'It failed', size: 'It failed', message: \"Key.like.text\" };\ntoast.error('It failed'); toast.other('It failed');\nfunction f() { return 'It failed';\n}\n<p title='It failed' alt={a ? 'It failed' : t('a.b')}>It failed</p><p>It failed {n}</p>{'It failed'}<q>It failed</q>\n"
    files = spark.createDataFrame([("a", react), ("b", "no text"), ("c", None)], "file string, text string")
    keys = spark.createDataFrame([("It failed", "k.x")], "text string, key string")
    once = rewrites.rewritten(files, keys, "react")
    got = {r.file: r.text for r in once.collect()}
    call = "t('k.x')"
    assert got["a"] == rewrites.IMPORT + f"const errorMessage = {call};\nconst x = {{ title: {call}, size: 'It failed', message: \"Key.like.text\" }};\ntoast.error({call}); toast.other('It failed');\nfunction f() {{ return {call};\n}}\n<p title={{{call}}} alt={{a ? {call} : t('a.b')}}>{{{call}}}</p><p>It failed {{n}}</p>{{{call}}}<q>It failed</q>\n"
    assert got["b"] == "no text" and got["c"] is None
    assert {r.file: r.text for r in rewrites.rewritten(once, keys, "react").collect()} == got
    vue = spark.createDataFrame([("v", "<b TITLE='It failed'>Hi {{ u.name }}</b>{{ 'It failed' }}<i :alt=\"'It failed'\" v-html=\"'It failed'\">It failed</i>")], "file string, text string")
    more = keys.union(spark.createDataFrame([("Hi {{ u.name }}", "k.hi")], "text string, key string"))
    done = rewrites.rewritten(vue, more, "vue")
    assert done.first().text == "<b :TITLE=\"$t('k.x')\">{{ $t('k.hi', {name}) }}</b>{{ $t('k.x') }}<i :alt=\"$t('k.x')\" v-html=\"$t('k.x')\">{{ $t('k.x') }}</i>"
    assert rewrites.rewritten(done, more, "vue").first().text == done.first().text


def test_small_tables_only_are_broadcast(spark):
    from glossaria.sources.scratch import small

    plan = lambda n: spark.range(100).join(small(spark.range(n).withColumnRenamed("id", "k"), 5), F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(6)
