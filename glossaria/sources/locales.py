"""Locale and source files as DataFrames: scan by globs and size, decode, flatten JSON(C), PO, RESX and PHP arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import spread, stash

MAX_BYTES = 2 * 1024 * 1024
#: Folders that no scan enters.
PRUNED = ("node_modules", "vendor", "dist", "build", ".git", ".next", ".nuxt", "coverage", "storage", "public")
CATALOG = "locale string, file string, key string, value string, ord long"
COLUMNS = ["locale", "file", "key", "value", "ord"]


@dataclass(frozen=True)
class Project:
    """What a project's configuration says; unknown fields are ignored."""

    locales: tuple[str, ...] = ("en",)
    base: str = "en"
    source_root: str = "src"
    locales_dir: str = "locales"
    layout: str = "single"
    message_calls: tuple[str, ...] = ()
    extract_keys: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)

    @classmethod
    def read(cls, package_json: str, section: str = "i18n") -> Project:
        """From a section of the text of a package file; `layout` goes before `localeLayout`, `sourceLocale` before `defaultLocale`."""
        own = (parse_jsonc(package_json) or {}).get(section) or {}
        base = own.get("sourceLocale") or own.get("defaultLocale") or "en"
        return cls(tuple(own.get("locales") or (base,)), base, own.get("srcRoot") or "src", own.get("localesDir") or "locales", own.get("layout") or own.get("localeLayout") or "single", tuple(own.get("messagePatterns") or ()), tuple(own.get("tsExtractKeys") or ()), own)


def listed(spark: SparkSession, path: str, glob: str = "*", pruned: tuple[str, ...] = PRUNED) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a path whose name fits, level by level; pruned folders are not entered, no file is opened.

    Like Spark's own index of files this holds a name per file on the driver; a level of folders is one call to the file system.
    """
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files, fits = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.GlobFilter(glob)
    level, out = [root], []
    while level:
        folders = spark.sparkContext._gateway.new_array(hadoop.Path, len(level))
        for i, p in enumerate(level):
            folders[i] = p
        level = []
        for status in files.listStatus(folders):
            at = status.getPath()
            if status.isDirectory():
                if at.getName() not in pruned:
                    level.append(at)
            elif fits.accept(at):
                out.append((at.toString(), status.getLen()))
    return out


def scan(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(path, text) of files below a path. Names, folders and sizes are checked in the listing: files that are left out are never opened."""
    chosen = [p for p, n in listed(spark, path, glob, pruned) if n <= max_bytes]
    if not chosen:
        return spark.createDataFrame([], "path string, text string")
    files = _read(spark, chosen)
    return files.select("path", decoded(F.col("content")).alias("text"))


def _read(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files by their paths, as bytes. Spark looks at paths in a job of a task each, up to 10,000; here a task looks at many."""
    tasks, few = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, few)
    try:
        return spark.read.format("binaryFile").load(files)
    finally:
        spark.conf.set(tasks, before)


def skipped(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES, pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """One row: skipped, the files too large for scan(), and files, all that fit the glob."""
    sizes = [n for _, n in listed(spark, path, glob, pruned)]
    return spark.createDataFrame([(sum(n > max_bytes for n in sizes), len(sizes))], "skipped long, files long")


def ignore_lists(files: DataFrame) -> DataFrame:
    """(kind, pattern) of ignore files (text): the entries of exact, exactInsensitive and contains, of all files, each as often as it stands."""
    lists = F.from_json("text", "exact array<string>, exactInsensitive array<string>, contains array<string>")
    named = lambda k: F.transform(F.coalesce(F.col(f"l.{k}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("pattern")))
    entries = F.flatten(F.array(*[named(k) for k in ("exact", "exactInsensitive", "contains")]))
    return files.select(lists.alias("l")).select(F.explode(entries).alias("e")).select("e.*").where("pattern is not null")


def decoded(content: Column) -> Column:
    """UTF-8 without its mark; bytes with a NUL are UTF-16LE."""
    wide = F.contains(content, F.unhex(F.lit("00")))
    text = F.when(wide, F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "^\ufeff", "")


_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def clean_jsonc(text: str) -> str:
    """JSON text without comments and trailing commas, both outside strings only."""
    keep = lambda m: m[1] or ""
    return _TRAILING.sub(keep, _JSONC.sub(keep, text.removeprefix("\ufeff"))).strip()


def parse_jsonc(text: str) -> dict:
    """The object; an empty text is an empty object, bad JSON None."""
    body = clean_jsonc(text)
    if not body:
        return {}
    try:
        return json.loads(body)
    except ValueError:
        return None


def json_error(text: str) -> tuple[str, int] | None:
    """(message, line) of bad JSON."""
    try:
        json.loads(clean_jsonc(text) or "{}")
    except ValueError as e:
        return str(e), e.lineno
    return None


def json_errors(files: DataFrame) -> DataFrame:
    """(path, message, line) of the files (path, text) that are not JSON, comments and trailing commas left aside."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [(p, *e) for p, t in zip(x["path"], x["text"], strict=True) if (e := json_error(t or ""))]
            yield pd.DataFrame(rows, columns=["path", "message", "line"])

    return files.select("path", "text").mapInPandas(run, "path string, message string, line int")


def walk_json(node, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(dotted key, string): objects nest, arrays are message lists of {id | key, translation | message | text | other}."""
    if isinstance(node, str):
        if prefix:
            yield prefix, node
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from walk_json(v, f"{prefix}.{k}" if prefix else k)
    elif isinstance(node, list):
        for item in node:
            if isinstance(item, dict) and isinstance(name := item.get("id") or item.get("key"), str):
                text = next((x for f in ("translation", "message", "text", "other") if isinstance(x := item.get(f), str)), None)
                if isinstance(item.get("translation"), dict):
                    text = item["translation"].get("other", text)
                if isinstance(text, str):
                    yield f"{prefix}.{name}" if prefix else name, text


def walk_po(text: str) -> Iterator[tuple[str, str]]:
    """(msgid, msgstr): strings go on over lines; of several msgstr forms the last counts; an untranslated entry is empty."""
    field, entry = "", {"id": None, "str": ""}
    for line in [*text.splitlines(), "msgid \"\""]:
        line = line.strip()
        if m := re.match(r'(msgid_plural|msgid|msgstr)(?:\[\d+\])?\s*"(.*)"$', line):
            if m[1] == "msgid":
                if entry["id"]:
                    yield entry["id"], entry["str"]
                entry = {"id": m[2], "str": ""}
                field = "id"
            elif m[1] == "msgstr":
                field, entry["str"] = "str", m[2]
            else:
                field = ""
        elif field and (m := re.match(r'"(.*)"$', line)):
            entry[field] += m[1]


_RESX = re.compile(r'<data\s+[^>]*name="([^"]+)"[^>]*>\s*<value>(.*?)</value>', re.S)
_ENTITY = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def walk_resx(text: str) -> Iterator[tuple[str, str]]:
    for name, value in _RESX.findall(text):
        for a, b in _ENTITY.items():
            value = value.replace(a, b)
        yield name, re.sub(r"\s*\n\s*", " ", value).strip()


_PHP = re.compile(r"""\s+|//[^\n]*|\#[^\n]*|/\*.*?\*/|(?P<arrow>=>)|(?P<open>\[|array\s*\()|(?P<close>[\])])|(?P<comma>,)|'(?P<one>(?:\\.|[^'\\])*)'|"(?P<two>(?:\\.|[^"\\])*)"|(?P<other>[^\s,\[\]()'"=]+|.)""", re.S)


def walk_php(text: str, root: str = "") -> Iterator[tuple[str, str]]:
    """Strings of the first returned array, nested arrays by dotted keys, under the file's root."""
    begin = re.search(r"return\s*(\[|array\s*\()", text)
    if not begin:
        return
    stack, key, value = [root], None, None
    arrow = False
    for m in _PHP.finditer(text, begin.end()):
        kind = m.lastgroup
        if kind in ("one", "two"):
            literal = re.sub(r"\\(.)", r"\1", m[kind])
            if arrow:
                value = literal
            else:
                key = literal
        elif kind == "arrow":
            arrow = True
        elif kind == "open":
            stack.append(".".join(x for x in (stack[-1], key) if x))
            key, arrow, value = None, False, None
        elif kind in ("comma", "close"):
            if arrow and key is not None and value is not None:
                yield ".".join(x for x in (stack[-1], key) if x), value
            key, arrow, value = None, False, None
            if kind == "close":
                stack.pop()
                if not stack:
                    return
        elif kind == "other" and arrow:
            value = None


def locale_of(path: Column) -> Column:
    """The locale that a path names: after auto, locales, lang or locale; name.<culture>.resx; else the file's stem."""
    tags = F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r".*/auto/([A-Za-z]{2}(?:[-_][A-Za-z]+)?)(?:/|\.json$)", r".*/(?:locales|locale|translations|lang)/([A-Za-z]{2}(?:[-_][A-Za-z]+)?)(?:/|\.\w+$)", r"\.([A-Za-z]{2}(?:-[A-Za-z]+)?)\.resx$")], F.when(path.endswith(".resx"), "en"), F.regexp_extract(path, r"([^/.]+)\.\w+$", 1))
    return F.translate(tags, "_", "-")


def catalog(files: DataFrame, prefix_stem: bool = False) -> DataFrame:
    """Scanned locale files (path, text) as catalogue rows; ord follows path and place in the file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows, read = [], 0
            for path, locale, text in zip(x["path"], x["locale"], x["text"], strict=True):
                stem = re.sub(r".*/|\.\w+$", "", path)
                if path.endswith(".po"):
                    found = walk_po(text)
                elif path.endswith(".resx"):
                    found = walk_resx(text)
                elif path.endswith(".php"):
                    found = walk_php(text, re.sub(r"^.*/lang/[^/]+/|\.php$", "", path).replace("/", "."))
                else:
                    found = walk_json(parse_jsonc(text), stem if prefix_stem else "")
                rows += [(locale, path, k, v, i) for i, (k, v) in enumerate(found)]
                read += len(text)
                if read > MAX_BYTES:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, read = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.withColumn("locale", locale_of(F.col("path"))).mapInPandas(run, CATALOG)


def flatten(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """JSON objects (strings) to (keys..., path, value), nested objects by dotted paths to any depth, string leaves only.

    Level by level: the objects of one level are exploded, its strings go out, its objects are the next level, written in
    passing, until there are none; a level costs a scan of what is nested so deep. Rows are spread over tasks by their keys,
    and so are the files of the first level that is written.
    """
    tvf = rows.sparkSession.tvf
    node = spread(rows.select(*keys, column), *keys).select(*keys, F.lit(None).cast("string").alias("path"), F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    out = None
    while True:
        step = node.lateralJoin(tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_k"), F.col("value").alias("_v")))
        step = step.select(*keys, F.concat_ws(".", "path", "_k").alias("path"), F.col("_v").alias("v"), F.schema_of_variant("_v").alias("_kind"))
        leaves = step.where("_kind = 'STRING'").select(*keys, "path", F.col("v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        # a level is written as JSON text, which any file format can hold
        deeper = stash(step.where(F.col("_kind").startswith("OBJECT")).select(*keys, "path", F.to_json("v").alias("v")), "flatten-level")
        if deeper.isEmpty():
            return out
        node = deeper.withColumn("v", F.parse_json("v"))


def map_entries(text: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Flat JSON maps (answers, pending, caches) to (keys..., key, value)."""
    return text.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))
