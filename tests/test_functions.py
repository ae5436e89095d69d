"""Scalar functions and predicates on the reference's own examples."""

import pytest
from pyspark.sql import functions as F

from glossaria.functions import text as fn
from glossaria.functions import validate as val


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **given):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
        return df.select(column.alias("x")).first().x

    return run


def test_slug(value):
    slug = lambda s: value(fn.slug(F.col("s")), s=s)
    assert slug("Hello World") == "hello_world"
    assert slug("Élan vital à côté") == "elan_vital_a_cote"
    assert slug("确定").startswith("text_") and slug("确定") != slug("取消")
    assert len(slug("abcdefghijklmnop " * 8)) <= 48
    assert slug("one two three four five") == "one_two_three_four"


def test_hash(value):
    def slow(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        digits, h = "", abs(h)
        while h:
            digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
        return (digits or "0")[:8]

    for s in ("a", "hello", "确定", "a longer text that wraps around"):
        assert value(fn.hash36(F.col("s")), s=s) == slow(s)


@pytest.mark.parametrize(("text", "ok"), [("确定", True), ("弹入", True), ("请输入PPT主题", True), ("bounceIn", False), ("Save changes", True), ("div", False), ("#fff", False), ("{name}", False), ("(open", False), ("12", False), ("Hello {name}, welcome", True), ("color: red; margin: 0;", False)])
def test_reason(value, text, ok):
    assert (value(val.reason(F.col("s")), s=text) is None) == ok


def test_bom(value):
    assert value(fn.strip_bom(F.col("s")), s="﻿a﻿b") == "a﻿b"


def test_keys(value):
    assert value(fn.key_of(F.lit("Pages.Home"), F.lit("text"), F.col("s")), s="A sentence that is quite long indeed.") == "Pages.Home.text.a_sentence_that_is"
    assert value(fn.key_of(F.lit("Pages.Home"), F.lit("button"), F.col("s")), s="Save") == "Commons.button.save"
    assert value(fn.namespace(F.col("s")), s="components/auth-form/LoginForm.vue") == "Components.AuthForm"
    assert value(fn.namespace(F.col("s")), s="App.tsx") == "Common"
    assert value(fn.key_variations(F.col("s")), s="a.b.c") == ["a.b.c", "b.c", "c"]
    assert value(fn.key_issues(F.col("s")), s="a..b c") == ["characters", "dots"]
    assert value(fn.label(F.col("s")), s="userProfile_name") == "User profile name"
    assert value(fn.similarity(F.col("a"), F.col("b")), a="x.y.save", b="x.y.save") == 1.0
    assert value(fn.similarity(F.col("a"), F.col("b")), a="x.y.z.save", b="save") == pytest.approx(0.1)


def test_small(value):
    assert value(fn.placeholders(F.col("s")), s="Hi {user.name} and {{ count }} and {user.name}") == ["count", "user.name"]
    assert value(fn.fix_parens(F.col("s")), s="total)") == "total"
    assert value(fn.template_pattern(F.col("s")), s="Hi ${user.name}") == "Hi {name}"
    assert value(fn.inline_default(F.col("s")), s='t("a.b") || "Save"') == "Save"
    assert value(fn.quote_literal(F.col("s")), s="it's") == "'it\\'s'"
    assert value(fn.typography(F.col("s")), s="“a” –…") == '"a" -...'
    assert value(fn.language_of(F.col("s")), s="/x/App.TSX") == "typescriptreact"
    assert value(fn.version_parts(F.col("s")), s="v1.10.2-beta") == [1, 10, 2]
    assert value(fn.decode_entities(F.col("s")), s="a &amp; b&nbsp;&lt;") == "a & b <"


@pytest.mark.parametrize(("word", "ok"), [("the", True), ("strength", False), ("xzqv", False), ("aeiouy", False), ("of", True), ("zz", False), ("hello", True), ("bcdf", False)])
def test_english(value, word, ok):
    assert value(val.english_word(F.col("s")), s=word) == ok


@pytest.mark.parametrize(("text", "bad"), [("{name}: {count}", True), ("font-medium {color}", True), ("Hello {name}", False), ("https://x.y/z", True), ("?lang=en", True), ("/schedule/", True), ("md:w-[20px]", True), ("return x;", True), ("Save the file", False), ("{{ a ? 'b' : 'c' }}", True)])
def test_value_invalid(value, text, bad):
    assert value(val.value_invalid(F.col("s")), s=text) == bad


def test_base_reason(value):
    assert value(val.base_reason(F.col("s")), s="flex-col items-center p-2") == "css_utility"
    assert value(val.base_reason(F.col("s")), s="Save the file") is None
    assert value(val.not_reported(F.col("s")), s="imap.mail.com:993 (SSL)") and not value(val.not_reported(F.col("s")), s="Save the file")


def test_component_key(value):
    key = lambda p, k: value(fn.component_key(F.col("p"), F.col("k")), p=p, k=k)
    assert key("src/components/LoginForm.vue", "loginform.app.Save-Now_label") == "components.LoginForm.save_now"
    assert key("src/pages/x.ts", "a.b_title") == "a.b" and key("src/pages/x.ts", "a") is None


def test_likeness(value):
    like = lambda a, b: value(fn.key_likeness(F.col("a"), F.col("b")), a=a, b=b)
    assert like("common.import_file", "common.failed_to_import_file") == 0.0 and like("a.save", "a.load") == 0.0
    assert like("common.greeting", "common.greetings") > 0.3 and like("x.y", "x.y") == 1.0


def test_numeric_entities(spark):
    cases = {"&#65;&#x42;&#X43;": "ABC", "caf&#233; &#8364; &#x1F600;": "café € 😀", "&#0; &#55296; &#x110000; &#99999999;": "&#0; &#55296; &#x110000; &#99999999;", "&#38;lt;": "<", "&# 1;&#;&#x;": "&# 1;&#;&#x;", "&#65 no": "&#65 no", "&amp;lt;": "&lt;", "plain": "plain"}
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", fn.decode_entities(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_trimmed_parts_keep_their_digits(value):
    assert value(fn.placeholders(F.col("s")), s="{{ 0abc }} {{ 1.x1 }} {q}") == ["0abc", "1.x1", "q"]
    assert value(fn.template_parts(F.col("s")).getField("expressions"), s="a ${ 0b } ${ c1 }") == ["0b", "c1"]
    assert value(fn.escape_regex(F.col("s")), s="a.b*(c)\\") == "a\\.b\\*\\(c\\)\\\\"
