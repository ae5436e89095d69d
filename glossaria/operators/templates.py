"""Texts of templates and components (Vue, Svelte, Blade, JSX and generic sources).

One scanner walks markup: comments, tags with quoted attributes, text between tags, expressions in braces. What differs by
format is a Format value: which braces hold expressions, whether a text keeps them, which calls mark it as translated.
Scripts go through a scan for quoted literals by line. The portable tier of parsing: no syntax tree is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import spread
from .extract import ATTRIBUTES, LENGTHS, LOGGING, MODULES, TAG_KINDS

SCHEMA = "type string, text string, kind string, parent_tag string, attribute_name string, line int"
Item = tuple[str, str, str, str | None, str | None, int]


@dataclass(frozen=True)
class Format:
    opening: str  # of an expression
    closing: str
    keeps: bool  # whether an expression stays in its text as a placeholder
    drop: str = r"(?!x)x"  # what is taken out before scanning
    bound: str = r"^(?::|v-bind:)"  # attributes whose value is an expression


# How the formats write expressions
VUE = Format("{{", "}}", True)
SVELTE = Format("{", "}", False, bound=r"^(?!x)x")
BLADE = Format("{{", "}}", True, r"(?s)\{\{--.*?--\}\}|@php.*?@endphp|<\?php.*?\?>|@\w+(?:\((?:[^()]|\([^()]*\))*\))?", r"^(?::|x-)")
JSX = Format("{", "}", False, r"(?s)\{/\*.*?\*/\}", r"^(?!x)x")
_MARKED = re.compile(r"""\$?\bt\(|__\(|(?<![\w.])_\(|\bgettext\(|\btrans\(|@lang\(|\bi18n\.""")
_STRING = re.compile(r"""(["'`])((?:\\.|(?!\1).)*?)\1""", re.S)
_ATTRIBUTE = re.compile(r"""([@:\w.-]+)\s*=\s*("([^"]*)"|'([^']*)'|\{((?:[^{}]|\{[^{}]*\})*)\})""")
_SKIP_TAGS = ("script", "style", "code", "pre")


def expression_end(s: str, at: int, closing: str) -> int:
    """Where an expression that starts at `at` ends (behind its closing braces), minding quotes and nested braces."""
    depth, quote, i = 0, "", at
    while i < len(s):
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif depth == 0 and s.startswith(closing, i):
            return i + len(closing)
        elif c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
        i += 1
    return len(s)


def literals(expression: str) -> Iterator[str]:
    """Texts shown by an expression: both arms of conditions, both sides of || and ??, not keys of calls that translate."""
    if _MARKED.search(expression):
        return
    for m in _STRING.finditer(expression):
        before = expression[: m.start()].rstrip()
        if m[1] != "`" and (before.endswith(("===", "!==", "==", "!=", "[", ".")) or re.match(r"\s*(?:===?|!==?|\]|:(?!:))", expression[m.end() :]) and "?" not in before):
            continue
        yield template(m[2]) if m[1] == "`" else m[2]


def template(text: str) -> str:
    """${a.b} of a template literal to {b}; other expressions to {value1}, {value2} ..."""
    n = 0

    def name(m: re.Match) -> str:
        nonlocal n
        if plain := re.fullmatch(r"\s*(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*", m[1]):
            return "{" + plain[1] + "}"
        n += 1
        return "{value%d}" % n

    return re.sub(r"\$\{([^{}]*)\}", name, text)


def kind(tag: str | None, attribute: str | None = None) -> str:
    return {"placeholder": "placeholder", "title": "title", "alt": "alt", "aria-label": "label", "label": "label"}.get(attribute or "", "text") if attribute else TAG_KINDS.get((tag or "").lower(), "text")


def markup(source: str, form: Format) -> Iterator[Item]:
    """Items of the markup part."""
    s = re.sub(form.drop, lambda m: "\n" * m[0].count("\n"), source)
    stack: list[str] = []
    i, begin, parts = 0, 0, []
    line = lambda at: s.count("\n", 0, at) + 1

    def close(at: int) -> Iterator[Item]:
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        parts.clear()
        tag = stack[-1] if stack else None
        if text and not _MARKED.search(text) and re.search(r"[^\W\d_]", re.sub(r"\{[^{}]*\}", "", text)) and (tag or "") not in _SKIP_TAGS:
            yield "text", text, kind(tag), tag, None, line(at)

    while i < len(s):
        if s.startswith("<!--", i):
            end = s.find("-->", i)
            i = len(s) if end < 0 else end + 3
        elif s[i] == "<" and (m := re.compile(r"</?([A-Za-z][\w.:-]*)").match(s, i)):
            yield from close(begin)
            end, quote = m.end(), ""
            while end < len(s) and (quote or s[end] != ">"):
                quote = "" if quote and s[end] == quote else quote or (s[end] if s[end] in "\"'" else "")
                if not quote and s[end] == "{" and form.opening == "{":
                    end = expression_end(s, end + 1, "}") - 1
                end += 1
            tag, head = m[1], s[m.end() : end]
            if s[i + 1] == "/":
                if tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(tag) :]
            else:
                for a in _ATTRIBUTE.finditer(head):
                    name = re.sub(form.bound, "", a[1])
                    if name.lower() not in ATTRIBUTES:
                        continue
                    plain = a[3] if a[3] is not None else a[4]
                    dynamic = a[5] is not None or name != a[1]
                    for text in literals(a[5] or plain or "") if dynamic else [plain]:
                        if text and not _MARKED.search(text) and re.search(r"[^\W\d_]", text) and form.opening not in text:
                            yield "attribute", text, kind(tag, name.lower()), tag, name.lower(), line(i)
                if not head.endswith("/") and tag.lower() not in ("br", "img", "input", "hr", "meta", "link"):
                    stack.append(tag)
            i = begin = end + 1
            if stack and stack[-1].lower() in _SKIP_TAGS and s[m.start() + 1] != "/":
                end = s.lower().find(f"</{stack[-1].lower()}", i)
                i = begin = len(s) if end < 0 else end
        elif s.startswith(form.opening, i):
            end = expression_end(s, i + len(form.opening), form.closing)
            inner = s[i + len(form.opening) : end - len(form.closing)]
            if form.keeps and not _STRING.search(inner):
                parts.append(s[i:end])
            if not inner.lstrip().startswith(("#", "/", ":", "@")):
                for text in literals(inner):
                    if len(text) > 1 and re.search(r"[^\W\d_]", text):
                        yield "expression", text, kind(stack[-1] if stack else None), stack[-1] if stack else None, None, line(i)
            i = end
        else:
            parts.append(s[i])
            i += 1
    yield from close(begin)


def script(source: str, language: str = "js", first: int = 1) -> Iterator[Item]:
    """Quoted literals of a script by line; calls that translate, logging and modules are passed over."""
    low, high = LENGTHS[language]
    for n, text in enumerate(source.split("\n"), first):
        if _MARKED.search(text) or re.search(LOGGING, text) or re.search(MODULES, text) or text.lstrip().startswith(("//", "#", "*", "/*")):
            continue
        for m in _STRING.finditer(text):
            if low <= len(m[2]) <= high and re.search(r"[^\W\d_]", m[2]):
                yield "string", template(m[2]) if m[1] == "`" else f_string(m[2]) if language == "py" else m[2], "text", None, None, n


def f_string(text: str) -> str:
    """{a.b} of an f-string to {aB}, other expressions to {value}."""

    def name(m: re.Match) -> str:
        parts = m[1].split(".")
        return "{" + parts[0] + "".join(p[:1].upper() + p[1:] for p in parts[1:]) + "}" if all(p.isidentifier() for p in parts) else "{value}"

    return re.sub(r"\{([^{}]+)\}", name, text)


def component(source: str, form: Format) -> Iterator[Item]:
    """Markup outside scripts, then the scripts' literals."""
    pattern = re.compile(r"<script\b[^>]*>(.*?)</script>|<style\b.*?</style>", re.S | re.I)
    yield from markup(pattern.sub(lambda m: "\n" * m[0].count("\n"), source), form)
    for m in pattern.finditer(source):
        if m[1]:
            yield from script(m[1], "vue" if form is VUE else "js", source.count("\n", 0, m.start(1)) + 1)


def jsx(source: str) -> Iterator[Item]:
    """Markup of a component file (from tags that close), and literals of lines without markup."""
    inside = [m for m in re.finditer(r"<([A-Za-z][\w.]*)\b[^<>]*>(?:(?!<\1\b).)*?</\1>|<[A-Za-z][\w.]*\b[^<>]*/>", source, re.S)]
    for m in inside:
        for t, text, k, tag, attribute, n in markup(m[0], JSX):
            yield t, text, k, tag, attribute, n + source.count("\n", 0, m.start())
    rest = source
    for m in reversed(inside):
        rest = rest[: m.start()] + "\n" * m[0].count("\n") + rest[m.end() :]
    yield from script(rest)


#: (priority, takes a path, parser); the lowest priority that takes a path parses it.
PARSERS: list[tuple[int, Callable[[str], bool], Callable[[str, str], Iterator[Item]]]] = []


def register(takes: Callable[[str], bool], parser: Callable[[str, str], Iterator[Item]], priority: int = 100) -> None:
    PARSERS.append((priority, takes, parser))
    PARSERS.sort(key=lambda p: p[0])


register(lambda p: p.endswith(".blade.php"), lambda _, s: component(s, BLADE), 10)
register(lambda p: p.endswith(".vue"), lambda _, s: component(s, VUE), 20)
register(lambda p: p.endswith(".svelte"), lambda _, s: component(s, SVELTE), 30)
register(lambda p: p.endswith((".html", ".htm")), lambda _, s: component(s, VUE), 35)
register(lambda p: bool(re.search(r"\.(jsx|tsx|js|ts|mjs)$", p)), lambda _, s: jsx(s), 40)
register(lambda p: bool(re.search(r"\.(py|go|cs|java|kt|rb|php|rs|swift)$", p)), lambda p, s: script(s, m if (m := p.rsplit(".", 1)[-1]) in LENGTHS else "js"), 50)


def parse(path: str, source: str, parsers: list | None = None) -> Iterator[Item]:
    for _, takes, parser in PARSERS if parsers is None else parsers:
        if takes(path.lower()):
            yield from parser(path, source)
            return


#: Characters of sources read before their rows are handed on.
PIECE = 1 << 20


def pieces(files: Iterable[tuple[str, str]], rows_of: Callable[[str, str], Iterable[tuple]], most: int = PIECE) -> Iterator[list[tuple]]:
    """The rows of files (path, text), handed on whenever so many characters have been read, so that a worker doesn't hold a batch's rows."""
    rows, read = [], 0
    for path, text in files:
        if path and text:
            rows += rows_of(path, text)
            read += len(text)
        if read > most:
            yield rows
            rows, read = [], 0
    yield rows


def extract_texts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files (path, text) with a row for each text found, in Arrow batches. The files are spread over tasks first, as scanners work on each character."""
    parsers = list(PARSERS)  # goes to the workers with the function, so parsers registered here count there
    schema = f"path string, {SCHEMA}"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for rows in pieces(zip(x["path"], x["text"], strict=True), lambda p, t: ((p, *item) for item in parse(p, t, parsers))):
                yield pd.DataFrame(rows, columns=columns)

    return spread(files.select("path", "text"), "path").mapInPandas(run, schema)
