"""Exported version history and project files as tables: commits, blobs, work-tree status, reports, caches, frameworks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .locales import flatten

COMMITS = 100
# Frameworks by precedence, with the packages that show them
FRAMEWORKS = (("nuxt", ("nuxt", "nuxt3")), ("next", ("next",)), ("laravel", ("composer.json",)), ("vue", ("vue",)), ("svelte", ("svelte", "@sveltejs/kit")), ("react", ("react",)))


def recent(commits: DataFrame, now, days: int = 90, most: int = COMMITS) -> DataFrame:
    """Per path the commits (path, hash, ts, author, message) of the last days, newest first; a path without any takes its latest."""
    from ..operators.catalog import top_n

    young = commits.where(F.col("ts") >= now - F.expr(f"interval {days} days"))
    rest = commits.join(young.select("path").distinct(), "path", "left_anti")
    return top_n(young.unionByName(rest), ["path"], [F.desc("ts"), F.col("hash")], most)


def parse_log(lines: DataFrame) -> DataFrame:
    """hash|date|author|message lines (path, line) of a log."""
    p = F.split("line", r"\|", 4)
    return lines.where(F.col("line").rlike(r"^[0-9a-f]{7,40}\|")).select("path", p[0].alias("hash"), F.to_timestamp(F.substring(p[1], 1, 19)).alias("ts"), p[2].alias("author"), p[3].alias("message"))


def blobs(contents: DataFrame) -> DataFrame:
    """(path, hash, key, value) of JSON contents (path, hash, content)."""
    return flatten(contents.withColumnRenamed("path", "file"), "content", ["file", "hash"]).select(F.col("file").alias("path"), "hash", F.col("path").alias("key"), "value")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of one version that the other lacks: (path, sign, line), a bag difference of (path, line)."""
    lines = lambda df: df.select("path", F.explode(F.split("content", "\n")).alias("line"))
    a, b = lines(old), lines(new)
    return a.exceptAll(b).select("path", F.lit("-").alias("sign"), "line").unionByName(b.exceptAll(a).select("path", F.lit("+").alias("sign"), "line"))


def status(lines: DataFrame) -> DataFrame:
    """(path, state) of short status lines."""
    code = F.trim(F.substring("line", 1, 2))
    return lines.where("length(line) > 3").select(F.substring("line", 4, 1 << 20).alias("path"), F.when(code == "??", "untracked").when(code.contains("D"), "deleted").otherwise("modified").alias("state"))


def safe_ref(ref: str) -> bool:
    """Whether a revision can be handed to a command."""
    import re

    return bool(re.fullmatch(r"(?!-)[A-Za-z0-9._/~^-]+", ref))


def cache_entries(files: DataFrame) -> DataFrame:
    """(entry, translation, ord) of cache files (text): {entries, order} or an older flat map; what isn't JSON gives nothing."""
    full = F.from_json("text", "entries map<string,string>, `order` array<string>")
    old = F.from_json("text", "map<string,string>")
    rows = files.select(full.alias("f"), old.alias("o"))
    new = rows.where("f.entries is not null").select(F.posexplode(F.coalesce("f.order", F.map_keys("f.entries"))).alias("ord", "entry"), "f.entries").select("entry", F.element_at("entries", F.col("entry")).alias("translation"), F.col("ord").cast("long").alias("ord"))
    flat = rows.where("f.entries is null and o is not null").select(F.posexplode(F.map_entries("o")).alias("ord", "e")).select(F.col("e.key").alias("entry"), F.col("e.value").alias("translation"), F.col("ord").cast("long").alias("ord"))
    return new.unionByName(flat).where("translation is not null")


def framework(dependencies: DataFrame) -> DataFrame:
    """Per project the framework of highest precedence among its dependencies (project, name)."""
    rank = F.lit(None)
    for n, (_, packages) in reversed(list(enumerate(FRAMEWORKS))):
        rank = F.when(F.col("name").isin(list(packages)), n).otherwise(rank)
    names = F.array(*[F.lit(f) for f, _ in FRAMEWORKS])
    return dependencies.withColumn("rank", rank.cast("int")).where("rank is not null").groupBy("project").agg(F.min("rank").alias("rank")).select("project", F.element_at(names, F.col("rank") + 1).alias("framework"))


def source_root(files: DataFrame, candidates: tuple[str, ...] = ("resources/js", "src"), most: int = 400) -> DataFrame:
    """Per project (project, path) the candidate folder with more source files, counted up to a bound; the first on a tie."""
    root = F.lit(None)
    for n, c in reversed(list(enumerate(candidates))):
        root = F.when(F.col("path").startswith(c + "/"), n).otherwise(root)
    source = files.where(F.col("path").rlike(r"\.(js|ts|jsx|tsx|vue|svelte|mjs)$")).withColumn("root", root.cast("int")).where("root is not null")
    n = source.groupBy("project", "root").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    names = F.array(*[F.lit(c) for c in candidates])
    return n.groupBy("project").agg(F.min(F.struct((-F.col("n")).alias("m"), "root")).alias("b")).select("project", F.element_at(names, F.col("b.root") + 1).alias("root"))
