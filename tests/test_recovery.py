"""Templates, harvests, references and histories on the reference's own kinds of input."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glossaria.operators import recovery, references, templates
from glossaria.sources import history


def texts(path, source):
    return [(t, x, k) for t, x, k, *_ in templates.parse(path, source)]


def test_vue():
    source = "<template><div title=\"My title\" :alt=\"ok ? 'Yes it is' : 'No way'\"><p>Hello {{ name }} there</p><b>{{ $t('a.b') }}</b><!-- no --><span>{{ x || 'Fallback text' }}</span></div></template>\n<script>\nconst a = 'Some text'\nconsole.log('nope')\n</script>"
    assert texts("a.vue", source) == [("attribute", "My title", "title"), ("attribute", "Yes it is", "alt"), ("attribute", "No way", "alt"), ("text", "Hello {{ name }} there", "text"), ("expression", "Fallback text", "text"), ("string", "Some text", "text")]


def test_svelte_drops_expressions():
    assert texts("a.svelte", "<h1>Hello {user.name}!</h1>{#if x}<p>In {x ? 'One side' : 'Other'}</p>{/if}") == [("text", "Hello !", "heading"), ("expression", "One side", "text"), ("expression", "Other", "text"), ("text", "In", "text")]


def test_blade_and_generic():
    assert texts("a.blade.php", "@section('x')<p>Text {{ $a }}</p>{{-- c --}}@if($x)<b>{{ __('k') }}</b>@endif") == [("text", "Text {{ $a }}", "text")]
    assert [x for _, x, _ in texts("a.py", "x = f'Hello {user.name} and {1+2}'\nprint('no')\ny = _('Translated')\n")] == ["Hello {userName} and {value}"]
    assert [x for _, x, _ in texts("a.tsx", "const label = 'Save me';\nreturn <div><Button title=\"Go on\" onClick={() => x()}>Press me</Button><p>{t('a.b')}</p></div>")] == ["Go on", "Press me", "Save me"]
    assert templates.template("Hi ${user.name}, ${a + b} of ${c()}") == "Hi {name}, {value1} of {value2}"


def test_registered_parser_goes_first(spark):
    templates.register(lambda p: p.endswith(".note"), lambda p, s: iter([("text", s.upper(), "text", None, None, 1)]), 1)
    files = spark.createDataFrame([("x.note", "abc"), ("y.unknown", "abc"), (None, None)], "path string, text string")
    assert [(r.path, r.text) for r in templates.extract_texts(spark, files).collect()] == [("x.note", "ABC")]


def test_missing_references(spark):
    files = [
        ("/src/App.tsx", "const label = t('app.missing') + t('app.title');"), ("/src/x.php", "<?php echo __('laravel.missing') . __('Partner.name'); ?>"), ("/src/Component.tsx", 't("div",{class:1})'),
        ("/src/y.php", "<?php echo __('app.title'); ?>"),
    ]
    rows = [("app.title", "/locales/en.json"), ("Partner.name", "/resources/lang/en/Partner.php")]
    got = references.missing_references(spark.createDataFrame(files, "file string, text string"), spark.createDataFrame(rows, "key string, file string"))
    assert sorted((r.file, r.key) for r in got.collect()) == [("/src/App.tsx", "app.missing"), ("/src/x.php", "laravel.missing"), ("/src/y.php", "app.title")]


@pytest.mark.parametrize(("text", "ok"), [("Save changes", True), ("flex items-center p-2", False), ("some_identifier", False), ("Welcome!", True), ("/a/b", False), ("#fff", False)])
def test_user_text(spark, text, ok):
    assert spark.range(1).select(recovery.user_text(F.lit(text)).alias("x")).first().x == ok


def test_harvest(spark):
    files = spark.createDataFrame([("f", "<p>Old text here</p>\ntoast('Saved the file')\nclass=\"flex p-2\"\nlabel: 'Total amount'")], "file string, text string")
    got = {r.text: r.score for r in recovery.harvest(files, F.array(F.lit("total"))).collect()}
    assert set(got) == {"Old text here", "Saved the file", "Total amount"} and got["Total amount"] > got["Old text here"]
    assert recovery.best_text(recovery.harvest(files, F.array(F.lit("total"))), "file").first().text == "Total amount"


def test_history(spark):
    t = lambda d: datetime(2024, 1, d)
    commits = spark.createDataFrame([("p", "c3", t(3), "tidy"), ("p", "c2", t(2), "add i18n"), ("p", "c1", t(1), "first")], "path string, hash string, ts timestamp, message string")
    blobs = spark.createDataFrame([("p", "c1", "a.b", "first value"), ("p", "c3", "a.b", "third value")], "path string, hash string, key string, value string")
    keys = spark.createDataFrame([("x.a.b",), ("no.no",)], "key string")
    assert [(r.key, r.value, r.hash) for r in recovery.from_history(keys, commits, blobs).collect()] == [("x.a.b", "first value", "c1")]
    calls = spark.createDataFrame([("p", "k", "c3"), ("p", "k", "c2")], "path string, key string, hash string")
    assert [(r.key, r.hash, r.before) for r in recovery.commit_pairs(commits, calls).collect()] == [("k", "c2", "c1")]
    old = commits.where("hash <> 'c3'")
    assert {r.hash for r in history.recent(old, F.lit(t(30)), 5, 1).collect()} == {"c2"}


def test_files(spark):
    log = spark.createDataFrame([("p", "abc1234|2024-01-02 03:04:05 +0000|Ann|fix | pipe"), ("p", "noise")], "path string, line string")
    assert [tuple(r)[3:] for r in history.parse_log(log).collect()] == [("Ann", "fix | pipe")]
    files = spark.createDataFrame([('{"entries": {"a": "1", "b": "2"}, "order": ["b", "a"]}',), ('{"c": "3"}',), ("bad",)], "text string")
    assert sorted((r.entry, r.translation, r.ord) for r in history.cache_entries(files).collect()) == [("a", "1", 1), ("b", "2", 0), ("c", "3", 0)]
    lines = spark.createDataFrame([("?? new.json",), (" M old.json",), (" D gone.json",)], "line string")
    assert {(r.path, r.state) for r in history.status(lines).collect()} == {("new.json", "untracked"), ("old.json", "modified"), ("gone.json", "deleted")}
    contents = spark.createDataFrame([("p", "h", '{"a": {"b": "x", "n": 1}}')], "path string, hash string, content string")
    assert [tuple(r) for r in history.blobs(contents).collect()] == [("p", "h", "a.b", "x")]
    roots = spark.createDataFrame([("x", "src/a.js"), ("x", "resources/js/b.vue"), ("y", "src/a.ts"), ("y", "src/b.ts"), ("y", "resources/js/c.js")], "project string, path string")
    assert {r.project: r.root for r in history.source_root(roots).collect()} == {"x": "resources/js", "y": "src"}
    assert history.safe_ref("HEAD~1") and not history.safe_ref("--exec") and not history.safe_ref("a;b")


def test_acceptance(spark):
    def both(key, text):
        return spark.range(1).select(recovery.acceptable(F.lit(text), F.split(F.lit(key), ",")).alias("a"), recovery.suspicious(F.lit("x.title"), F.lit(text)).alias("s")).first()

    assert both("save,file", "Save the file").a and not both("save,file", "Open it now").a and not both("save", "a.b.c").a
    assert both("x", "We would like you to know.").s and both("x", "Value1 is bare").s and not both("x", "Short title").s


def test_reports(spark):
    values = spark.createDataFrame([("a.button.save", "fr", "Enregistrer les données")], "key string, locale string, value string")
    concise = spark.createDataFrame([("Enregistrer les données", "Enregistrer")], "value string, suggested string")
    assert references.style_issues(values, concise).first().suggested == "Enregistrer"
    d = spark.createDataFrame([("f", 1, "k", "style"), ("f", 1, "k", "style"), ("f", 2, "k", "missing")], "file string, line int, key string, code string")
    assert references.distinct_diagnostics(d).count() == 2
    assert {r.severity for r in references.with_severity(d, {"style": "hint"}).collect()} == {3, 1}


def test_source_history(spark):
    from glossaria.operators import source_history as sh

    t = lambda d: datetime(2024, 1, d)
    v0 = "<em>Long enough text stays</em>\n<h1>Welcome home friend</h1>\n<p>Total amount due: {x}</p>\n<b>other</b>\n" + "\n".join(f"line {i}" for i in range(20)) + "\n<i>Contact the support team</i>\n"
    v1 = v0.replace("Welcome home friend", "{t('home.welcomeTitle')}")
    v2 = v1.replace("Contact the support team", "{t('home.support')}").replace("<b>other</b>", "<b>{t('home.gone')}</b>")
    v3 = v2.replace("<b>{t('home.gone')}</b>", "<b>x</b>")
    v4 = v3.replace("<b>x</b>", "<b>{t('home.gone', { count: n })}</b>").replace("line 3\n", "Save {count} files now\n")
    rows = [("a", "c0", t(1), "first", v0), ("a", "c1", t(2), "titles", v1), ("a", "c2", t(3), "more", v2), ("a", "c3", t(4), "less", v3), ("a", "c4", t(5), "back", v4), ("b", "d0", t(1), "x", "<p>Hello there you</p>"), ("b", "d1", t(2), "use i18n", "<p>{t('b.hello')}</p>"), ("c", "e0", t(1), "x", "{t('c.always')}"), ("d", "f0", t(1), None, None), ("d", "f1", t(2), None, "t('d.new')")]
    versions = spark.createDataFrame(rows, "file string, hash string, ts timestamp, message string, content string")
    starts = {(r.file, r.key): (r.hash, r.before) for r in sh.introductions(versions).collect()}
    assert starts == {("a", "home.welcomeTitle"): ("c1", "c0"), ("a", "home.support"): ("c2", "c1"), ("a", "home.gone"): ("c4", "c3"), ("b", "b.hello"): ("d1", "d0"), ("d", "d.new"): ("f1", "f0")}
    missing = spark.createDataFrame([("a", "home.welcomeTitle"), ("a", "home.support"), ("a", "home.gone"), ("a", "home.none"), ("b", "b.hello"), ("c", "c.always"), ("d", "d.new")], "file string, key string")
    got = {(r.file, r.key): (r.text, r.hash, r.before, r.place) for r in sh.recovered(missing, versions).collect()}
    assert got[("a", "home.welcomeTitle")] == ("Welcome home friend", "c1", "c0", "change")
    assert got[("a", "home.support")] == ("Contact the support team", "c2", "c1", "change")
    assert got[("b", "b.hello")] == ("Hello there you", "d1", "d0", "change")
    assert got[("a", "home.gone")] == ("Long enough text stays", "c4", "c3", "file") and set(got) == {("a", "home.welcomeTitle"), ("a", "home.support"), ("a", "home.gone"), ("b", "b.hello")}
    lines = sh.changes(spark.createDataFrame([("a", "c0", "c2")], "file string, before string, hash string"), versions).collect()
    assert {r.hunk for r in lines} == {0, 1} and [r.sign for r in sorted(lines, key=lambda r: r.pos)].count("-") == 3
    assert sh.recovered(missing.limit(0), versions).count() == 0


def test_argument_names(spark):
    from glossaria.operators import source_history as sh

    files = spark.createDataFrame([("f", "t('a.b', { count: n, 0x: 1, Name }) + t('a.c') + t('a.b', {Total})")], "file string, content string")
    assert {(r.file, r.key): sorted(r.names) for r in sh.argument_names(files).collect()} == {("f", "a.b"): ["count", "n", "name", "total"]}
