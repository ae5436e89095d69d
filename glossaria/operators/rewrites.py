"""Places in components where a text can become a call, by framework, each with what stands around the key there.

A place is a lead (a property, a declaration, a call, an attribute, a return, a brace) and the quoted text behind it, or the
text between two tags. One pass over a file finds all leads; nothing is replaced here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import apply_edits

# Names of properties, parts of names of variables, calls, attributes and tags that hold texts for people
PROPERTIES = "title description message label placeholder cta text error heading alt reason".split()
VARIABLES = "title label message placeholder text heading description error reason".split()
TOASTS = "success error warning info show message".split()
ATTRIBUTES = {"react": "placeholder title alt aria-label label".split(), "vue": "placeholder title alt aria-label label error-message helper-text".split()}
TAGS = "h1 h2 h3 h4 h5 h6 p span div label button a li td th strong em b i small Link Button Text Title Heading".split()
IMPORT = "import { t } from '@/i18n';\n"

Place = tuple[int, int, str, str, str]  # start, end, the text, what goes before and behind its key
_KEYISH = re.compile(r"[A-Z][a-zA-Z0-9]*(?:\.[a-zA-Z_]\w*)+")
_QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n])+)\1""")
_IMPORTED = re.compile(r"\bimport\s*\{[^}]*\bt\b[^}]*\}|\b(?:const|let|var)\s*\{[^}]*\bt\b[^}]*\}\s*=\s*use")


def _leads(framework: str) -> re.Pattern:
    """One pattern of all leads; the group that is set tells which it is."""
    names = "|".join(ATTRIBUTES[framework])
    react = {
        "declared": rf"\b(?:const|let|var)\s+(?i:\w*(?:{'|'.join(VARIABLES)})\w*)\s*=\s*", "toast": rf"\btoast\.(?:{'|'.join(TOASTS)})\s*\(\s*", "returned": r"\breturn\s+",
        "attribute": rf"(?<![\w:.-])(?:{names})\s*=\s*", "property": rf"\b(?:{'|'.join(PROPERTIES)})\s*:\s*", "braced": r"\{",
    }
    vue = {"bound": rf'(?<=\s):(?i:{names})\s*=\s*"', "shown": r'\bv-(?:text|html)\s*=\s*"', "attribute": rf"(?<=\s)(?i:{names})\s*=\s*"}
    return re.compile("(?:" + "|".join(f"(?P<{k}>{p})" for k, p in (react if framework == "react" else vue).items()) + r""")(?P<q>["'`])(?P<body>(?:(?!(?P=q))[^\n\\])+)(?P=q)""")


_FOUND = {f: _leads(f) for f in ATTRIBUTES}
_EXPRESSION = {f: re.compile(rf"(?<![\w:.-])(?:{'|'.join(n)})\s*=\s*\{{([^{{}}\n]+)\}}") for f, n in ATTRIBUTES.items()}


def _fit(text: str) -> bool:
    return 2 <= len(text) <= 200 and not _KEYISH.fullmatch(text)


def _between_tags(source: str, tags: list[str] | None) -> Iterator[tuple[int, int, str]]:
    """Texts between a tag and the next one, without blanks around; with tags, only what one of these holds alone."""
    for m in re.finditer(r"<([A-Za-z][\w.-]*)(?:\s[^<>]*)?>([^<>]+)(?=<(/?)([A-Za-z][\w.-]*)?)", source):
        inner = m[2].strip()
        if not inner or (tags is not None and not (m[1].lower() in tags and m[3] and (m[4] or "").lower() in tags)):
            continue
        start = m.start(2) + len(m[2]) - len(m[2].lstrip())
        yield start, start + len(inner), inner


def react(source: str) -> Iterator[Place]:
    low = [t.lower() for t in TAGS]
    for a, b, text in _between_tags(source, low):
        if not re.search(r"[{}`]", text):
            yield a, b, text, "{t('", "')}"
    for m in _FOUND["react"].finditer(source):
        a, b, text, quote, lead = m.start("q"), m.end(), m["body"], m["q"], m.lastgroup and next(k for k in ("declared", "toast", "returned", "attribute", "property", "braced") if m[k] is not None)
        after = source[b : b + 1]
        if not _fit(text) or re.search("[\"'`]", text) or (quote == "`" and lead not in ("property", "declared", "toast")):
            continue
        if lead == "braced":
            if after == "}" and not re.search("[{}]", text):
                yield a, b, text, "t('", "')"
        elif lead == "returned":
            if len(text) > 2 and re.match(r"\s*[;\n]", source[b : b + 50]):
                yield a, b, text, "t('", "')"
        else:
            around = ("{t('", "')}") if lead == "attribute" else ("t('", "')")
            yield a, b, text, *around
    for m in _EXPRESSION["react"].finditer(source):
        for x in _QUOTED.finditer(m[1]):
            if _fit(x[2]) and "${" not in x[2] and not re.search(r"\bt\(\s*$", m[1][: x.start()]):
                yield m.start(1) + x.start(), m.start(1) + x.end(), x[2], "t('", "')"


def vue(source: str) -> Iterator[Place]:
    for a, b, text in _between_tags(source, None):
        if not re.search(r"\{\{\s*\$?t\s*\(", text):
            names = [re.search(r"([A-Za-z_$][\w$]*)\W*$", x) for x in re.findall(r"\{\{([^}]+)\}\}", text)]
            given = ", {" + ", ".join(dict.fromkeys(n[1] for n in names if n)) + "}" if names else ""
            yield a, b, text, "{{ $t('", f"'{given}) }}}}"
    for m in _FOUND["vue"].finditer(source):
        text, lead = m["body"], next(k for k in ("bound", "shown", "attribute") if m[k] is not None)
        if not _fit(text) or m["q"] == "`" or re.search("[\"'`]", text):
            continue
        if lead == "attribute":
            name = re.match(r"[\w-]+", m["attribute"])[0]
            yield m.start(), m.end(), text, f":{name}=\"$t('", "')\""
        elif source[m.end() : m.end() + 1] == '"':
            yield m.start("q"), m.end(), text, "$t('", "')"
    for m in re.finditer(r"\{\{([^}]*)\}\}", source):
        for x in _QUOTED.finditer(m[1]):
            if len(x[2]) > 2 and _fit(x[2]) and x[1] != "`" and not re.search(r"\$?\bt\s*\(\s*$", m[1][: x.start()]):
                yield m.start(1) + x.start(), m.start(1) + x.end(), x[2], "$t('", "')"


def places(framework: str, source: str) -> list[Place]:
    """Places that don't overlap, the first to start, then the longest, first; a text that holds a whole other place waits for another pass."""
    out, end = [], 0
    for p in sorted(set((react if framework == "react" else vue)(source)), key=lambda p: (p[0], -p[1])):
        if p[0] >= end:
            out.append(p)
            end = p[1]
    return out


def with_import(source: str) -> str:
    """Source whose calls have their import: behind directives such as "use client", before the first other line."""
    if _IMPORTED.search(source):
        return source
    m = re.match(r"""(?:\s*(?:["']use \w+["'];?|//[^\n]*)[ \t]*\n)*""", source)
    return source[: m.end()] + IMPORT + source[m.end() :]


def rewritten(files: DataFrame, keys: DataFrame, framework: str) -> DataFrame:
    """Files (file, text) whose texts that a key map (text, key) knows are calls; changed React files get the import of t.

    Places are found by file, joined with the map, and put in as edits. Calls are no places, so a second run changes nothing.
    The map grows with the texts and is merged in, never broadcast.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([(f, *p) for f, t in zip(x["file"], x["text"], strict=True) for p in places(framework, t or "")], columns=["file", "start", "end", "found", "before", "after"])

    @F.pandas_udf("string")
    def imported(text: pd.Series) -> pd.Series:
        return text.map(with_import)

    found = files.select(F.col("file").cast("string").alias("file"), "text").mapInPandas(run, "file string, start long, end long, found string, before string, after string")
    edits = found.join(keys.select(F.col("text").alias("found"), "key").hint("merge"), "found").select("file", "start", "end", F.concat("before", "key", "after").alias("new"))
    out = apply_edits(files.select(F.col("file").cast("string").alias("file"), "text"), edits)
    if framework != "react":
        return out
    changed = edits.select("file").distinct().withColumn("_changed", F.lit(True)).hint("merge")
    return out.join(changed, "file", "left").select("file", F.when(F.col("_changed"), imported(F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
