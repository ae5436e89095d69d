"""Texts, calls and attributes out of source files and pages (explode-shaped), and edits put back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import cascade, plain

# Calls by framework
CALLS = {"any": r"(?:\bt|\$t)", "laravel": r"(?:\b__|\btrans|@lang)", "python": r"(?:\b_|\bgettext)"}
KEY = r"""\(\s*['"`]([A-Za-z0-9_.\-:]+)['"`]"""
TRANSLATED = ("__(", "trans(", "@lang(", "$t(", "t(")
LOGGING = r"\b(console\.(log|warn|error|info|debug)|logger?\.\w+|print|fmt\.Print\w*|log\.\w+)\s*\("
MODULES = r"^\s*(import|from|export\s+\*|require\b|use\b|#include)"
# Attributes that hold text for people, and the kinds of tags and attributes
ATTRIBUTES = ("title", "alt", "placeholder", "aria-label", "label")
TAG_KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "title": "heading", "button": "button", "a": "link", "label": "label", "p": "text", "span": "text", "li": "text", "td": "text", "th": "heading", "option": "option"}
#: Characters of a quoted literal, by language.
LENGTHS = {"js": (3, 200), "vue": (2, 200), "py": (3, 200), "go": (3, 200), "php": (3, 200)}


def parser_of(path: Column) -> Column:
    """The first parser that takes a file."""
    p = F.lower(path)
    return F.when(p.endswith(".blade.php"), "blade").when(p.endswith(".vue"), "vue").when(p.endswith(".svelte"), "svelte").when(p.rlike(r"\.(jsx|tsx|js|ts|mjs)$"), "jsx").when(p.rlike(r"\.(py|go|cs|java|kt|rb|php|rs|swift)$"), "generic")


def html_texts(pages: DataFrame, text: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys..., pos, text): text between tags, line by line, with a letter; scripts, styles and comments left out."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", "\n"), r"(?s)<!--.*?-->", "\n")
    lines = F.split(F.regexp_replace(body, "<[^>]+>", "\n"), "\n")
    return pages.select(*keys, F.posexplode(lines).alias("pos", "text")).withColumn("text", F.trim("text")).where(F.col("text").rlike("[a-zA-Z]"))


def tag_texts(pages: DataFrame, text: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keys..., tag, text, kind) of <tag>text</tag> without nested tags."""
    pattern = r"<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?>([^<>]+)</"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("text"))
    rows = pages.select(*keys, F.explode(found).alias("x")).select(*keys, F.lower("x.tag").alias("tag"), F.trim("x.text").alias("text")).where("text <> ''")
    return rows.withColumn("kind", kind_of(F.col("tag")))


def kind_of(tag: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TAG_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(known, tag), F.lit("text"))


def attribute_values(pages: DataFrame, name: str, text: str = "html", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return pages.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(rf'\s{name}="([^"]*)"'), F.lit(1))).alias("value"))


def calls(files: DataFrame, pattern: str = CALLS["any"], text: str = "text", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys..., line, key) of every call of one of the names with a literal key, by line."""
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    return lines.select(*keys, (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(pattern + KEY), F.lit(1))).alias("key"))


def call_pattern(names: tuple[str, ...]) -> str:
    """The pattern of calls() for configured names, which may be dotted; the usual names too."""
    return "(?:" + "|".join([CALLS["any"], *(rf"(?<![\w.]){re.escape(n)}" for n in names)]) + ")"


def call_bounds(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, start, end, call) of translating calls by offset; quotes, brackets and objects among the arguments are minded."""
    from .templates import expression_end

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = re.compile(r"(?<![\w.$])\$?t\(")
        for x in frames:
            rows = [(f, m.start(), e, t[m.start() : e]) for f, t in zip(x["file"], x["text"], strict=True) for m in begin.finditer(t or "") for e in [expression_end(t, m.end(), ")")]]
            yield pd.DataFrame(rows, columns=["file", "start", "end", "call"])

    return files.select(F.col("file").cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, start long, end long, call string")


def usage(files: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """Calls and quoted literals that name a candidate key: extracted once, then a semi join, not a pattern per key."""
    quoted = files.select("file", F.posexplode(F.split(text, "\n")).alias("pos", "content")).select("file", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(r"""['"`]([A-Za-z0-9_\-:]+(?:\.[A-Za-z0-9_\-:]+)+)['"`]"""), F.lit(1))).alias("key"))
    return calls(files, text=text).unionByName(quoted).distinct().join(candidates.select("key"), "key", "left_semi")


def literals(files: DataFrame, language: str = "js", text: str = "text") -> DataFrame:
    """(file, line, text): quoted strings by line; lines of calls, logging and modules are passed over."""
    low, high = LENGTHS[language]
    lines = files.select("file", F.posexplode(F.split(text, "\n")).alias("pos", "content"))
    lines = lines.where(~F.col("content").rlike(CALLS["any"] + KEY) & ~F.col("content").rlike(LOGGING) & ~F.col("content").rlike(MODULES))
    found = F.regexp_extract_all("content", F.lit(rf"""(["'`])((?:(?!\1).){{{low},{high}}})\1"""), F.lit(2))
    return lines.select("file", (F.col("pos") + 1).alias("line"), F.explode(found).alias("text"))


def mustaches(files: DataFrame, text: str = "text") -> DataFrame:
    return files.select("file", F.explode(F.regexp_extract_all(text, F.lit(r"\{\{([^}]+)\}\}"), F.lit(1))).alias("expression"))


def properties(files: DataFrame, names: tuple[str, ...] = ("title", "description", "cta", "message", "label"), text: str = "text") -> DataFrame:
    """String values of object properties with one of the names."""
    found = F.regexp_extract_all(text, F.lit(rf"""\b(?:{"|".join(names)})\s*:\s*['"]([^'"\n]+)['"]"""), F.lit(1))
    return files.select("file", F.explode(found).alias("text"))


def struct_tags(files: DataFrame, text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(text, F.lit(r"""\b(?:label|error|description|message|placeholder|title):"([^"]+)\""""), F.lit(1))
    return files.select("file", F.explode(found).alias("text"))


def translatable(items: DataFrame, text: str = "text") -> DataFrame:
    """Items with the reason of the cascade; null reason means to translate."""
    return items.withColumn("_plain", plain(F.col(text))).withColumn("reason", cascade(F.col("_plain"))).drop("_plain")


def comment_ranges(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, start, end) of comments, scripts and styles in pages, by offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(r"<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", re.S | re.I)
        for x in frames:
            yield pd.DataFrame([(f, *m.span()) for f, t in zip(x["file"], x["text"], strict=True) for m in pattern.finditer(t or "")], columns=["file", "start", "end"])

    return files.select(F.col("file").cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, start long, end long")


def offsets(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(file, pos, value) of every match's first group, by offset."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = re.compile(pattern)
        for x in frames:
            yield pd.DataFrame([(f, m.start(), m[1]) for f, t in zip(x["file"], x["text"], strict=True) for m in p.finditer(t or "")], columns=["file", "pos", "value"])

    return files.select(F.col("file").cast("string").alias("file"), F.col(text).alias("text")).mapInPandas(run, "file string, pos long, value string")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (file, text) with edits (file, start, end, new) put in from the right; edits must not overlap."""
    each = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("edits"))

    @F.pandas_udf("string")
    def put(text: pd.Series, all_edits: pd.Series) -> pd.Series:
        def one(t, es):
            for e in reversed(list(es) if es is not None else []):
                t = t[: e["start"]] + e["new"] + t[e["end"] :]
            return t

        return pd.Series([one(t, es) for t, es in zip(text, all_edits, strict=True)])

    return files.join(each.hint("merge"), "file", "left").select("file", put("text", "edits").alias("text"))


# How a call is written, by framework
CALL_TEXT = {"react": "{t('\0')}", "vue": "{{ $t('\0') }}", "svelte": "{$t('\0')}", "laravel": '{{ __("\0") }}', "code": "t('\0')"}
#: Places of texts by framework: (pattern with the text as its only group, what stands around the key there).
PLACES = {
    "laravel": [(r"<[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>([^<>]+)</", CALL_TEXT["laravel"])],
    "vue": [(r"<[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>([^<>{}]+)</", CALL_TEXT["vue"]), (r"""(?<=\s)((?:title|alt|placeholder|aria-label|label)="[^"{}]+")""", ":\1=\"$t('\0')\"")],
    "react": [(r"<[a-zA-Z][\w.]*(?:\s[^<>]*)?>([^<>{}]+)</", CALL_TEXT["react"]), (r"""(?<=\s)((?:title|alt|placeholder|aria-label|label)="[^"{}]+")""", "\1={t('\0')}"), (r"""\b(?:toast(?:\.\w+)?|alert|notify|showMessage)\(\s*('[^'\n]+'|"[^"\n]+")\s*[,)]""", CALL_TEXT["code"])],
}


def call_text(framework: str, key: Column) -> Column:
    before, after = CALL_TEXT.get(framework, CALL_TEXT["code"]).split("\0")
    return F.concat(F.lit(before), key, F.lit(after))


def wrap_texts(files: DataFrame, keys: DataFrame, framework: str = "laravel") -> DataFrame:
    """Files (file, text) with the texts that a key map (text, key) knows turned into calls: places found by pattern, joined
    with the map, put back as edits. What is a call already is left, so a second run changes nothing."""
    places = PLACES[framework]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(re.compile(p), form) for p, form in places]
        for x in frames:
            rows = []
            for f, t in zip(x["file"], x["text"], strict=True):
                for p, form in patterns:
                    for m in p.finditer(t or ""):
                        s, (start, end), name = m[1], m.span(1), ""
                        if "\1" in form:  # attribute="text"
                            name, _, s = s.partition("=")
                        found = s.strip().strip("\"'").strip() if s.strip()[:1] in "\"'" else s.strip()
                        if found and not any(c in s for c in TRANSLATED):
                            if not name and form != CALL_TEXT["code"]:
                                start, end = start + len(s) - len(s.lstrip()), end - (len(s) - len(s.rstrip()))
                            before, after = form.replace("\1", name).split("\0")
                            rows.append((f, start, end, found, before, after))
            yield pd.DataFrame(rows, columns=["file", "start", "end", "found", "before", "after"])

    found = files.mapInPandas(run, "file string, start long, end long, found string, before string, after string")
    edits = found.join(keys.select(F.col("text").alias("found"), "key").hint("merge"), "found").select("file", "start", "end", F.concat("before", "key", "after").alias("new"))
    return apply_edits(files, edits)


def collapse_defaults(code: Column) -> Column:
    """t(k, "default"), t(k) || "default" and t(k) ?? "default" to t(k)."""
    quoted = r"""(?:'[^'\n]*'|"[^"\n]*")"""
    code = F.regexp_replace(code, rf"(\bt\(\s*{quoted})\s*,\s*{quoted}\s*\)", "$1)")
    return F.regexp_replace(code, rf"(\bt\(\s*{quoted}\s*\))\s*(?:\|\||\?\?)\s*{quoted}", "$1")


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) that an offset lies in."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def inline(files: DataFrame, values: DataFrame) -> DataFrame:
    """t('key') of known keys back to quoted texts: for keys that are withdrawn."""
    from ..functions.text import quote_literal

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = re.compile(r"""(?<![\w$.])\$?t\(\s*(['"])([A-Za-z0-9_.\-:]+)\1\s*\)""")
        for x in frames:
            yield pd.DataFrame([(f, *m.span(), m[2]) for f, t in zip(x["file"], x["text"], strict=True) for m in p.finditer(t or "")], columns=["file", "start", "end", "key"])

    found = files.mapInPandas(run, "file string, start long, end long, key string")
    return apply_edits(files, found.join(values.select("key", "value").hint("merge"), "key").select("file", "start", "end", quote_literal(F.col("value")).alias("new")))
