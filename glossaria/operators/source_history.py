"""Texts that calls replaced, from the history of source files: where a key's call appeared, what the change took away.

Versions are exported as a table (file, hash, ts, message, content). A call is present over stretches of a file's versions;
the start of the newest stretch, with the version before it, is where the text was lost. Changes that speak of translation
are tried first. The two versions are compared once for all keys that need the pair; removed lines of hunks whose added
lines hold the call score best, then any removed line that fits the key, then the old file as a whole.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hints
from ..sources.history import recent
from ..sources.scratch import stash
from .recovery import harvest

#: Versions looked at by file, days they may be old (else the latest ones), and lines of context that join hunks.
VERSIONS, DAYS, CONTEXT = 30, 90, 3
#: The least scores of a text from a change and from an old file.
LEAST_CHANGE, LEAST_FILE = 3, 5
SPEAKS = "(?i)i18n|translat|lang|locale|intl"
CALL = r"""\b\$?t\(\s*['"]([A-Za-z0-9_.-]+)['"]"""
DIFF = "file string, before string, hash string, hunk int, pos int, sign string, line string"


def calls_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CALL), F.lit(1)))


def introductions(versions: DataFrame) -> DataFrame:
    """(file, key, hash, before, first): the newest version with a call to the key whose predecessor has none.

    Presence by version is cut into stretches: a call that was there in the version before continues its stretch.
    """
    order = Window.partitionBy("file").orderBy("ts", F.desc("hash"))
    steps = versions.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("hash").over(order))
    present = steps.select("file", "n", "hash", "before", F.explode(calls_of(F.col("content"))).alias("key"))
    since = F.lag("n").over(Window.partitionBy("file", "key").orderBy("n"))
    starts = present.withColumn("last", since).where("before is not null and (last is null or last < n - 1)")
    return starts.groupBy("file", "key").agg(F.max_by(F.struct("hash", "before"), "n").alias("p")).select("file", "key", "p.hash", "p.before", F.lit(1).alias("first"))


def spoken(versions: DataFrame) -> DataFrame:
    """(file, hash, before): per file the newest version whose message speaks of translation, with its predecessor."""
    steps = versions.withColumn("before", F.lag("hash").over(Window.partitionBy("file").orderBy("ts", F.desc("hash"))))
    newest = steps.where(F.col("message").rlike(SPEAKS)).groupBy("file").agg(F.max_by(F.struct("hash", "before"), F.struct("ts", F.col("before").isNotNull())).alias("p"))
    return newest.select("file", "p.hash", "p.before").where("before is not null")


def changes(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """The changed lines of distinct pairs (file, before, hash), with the number of their hunk and their place in the change."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for file, before, after, old, new in x[["file", "before", "hash", "old", "new"]].itertuples(index=False):
                a, b = old.split("\n"), new.split("\n")
                pos = 0
                for hunk, group in enumerate(difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(CONTEXT)):
                    for kind, i, j, k, m in group:
                        if kind != "equal":
                            lines = [("-", y) for y in a[i:j]] + [("+", y) for y in b[k:m]]
                            rows += [(file, before, after, hunk, pos + p, sign, line) for p, (sign, line) in enumerate(lines)]
                            pos += len(lines)
            yield pd.DataFrame(rows, columns=["file", "before", "hash", "hunk", "pos", "sign", "line"])

    text = versions.select("file", "hash", F.coalesce("content", F.lit("")).alias("text"))
    both = pairs.select("file", "before", "hash").distinct().join(text.withColumnRenamed("text", "new"), ["file", "hash"]).join(text.select("file", F.col("hash").alias("before"), F.col("text").alias("old")), ["file", "before"])
    return both.select("file", "before", "hash", "old", "new").mapInPandas(run, DIFF)


def argument_names(contents: DataFrame) -> DataFrame:
    """(file, key, names): names in the objects that a file's calls pass along with a key, lower-cased."""
    call = r"""\bt\(\s*['"][A-Za-z0-9_.-]+['"]\s*,\s*\{[^}]+\}"""
    each = contents.select("file", F.explode(F.regexp_extract_all("content", F.lit(call), F.lit(0))).alias("c"))
    name = F.explode(F.transform(F.split(F.regexp_extract("c", r"\{([^}]+)", 1), "[:,]"), lambda x: F.trim(x)))
    each = each.select("file", F.regexp_extract("c", r"""['"]([^'"]+)['"]""", 1).alias("key"), name.alias("name")).where(F.col("name").rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"))
    return each.groupBy("file", "key").agg(F.collect_set(F.lower("name")).alias("names"))


def _scored(found: DataFrame, bonus: int, fitting: bool = True) -> DataFrame:
    """score of found (text, base, words, names and others): 10 a hint word, 3 a placeholder's name; fitting drops texts with neither."""
    hit = lambda c: F.size(F.filter(c, lambda w: F.contains(F.lower(F.col("text")), w)))
    out = found.withColumns({"_w": hit(F.col("words")), "_n": hit(F.col("names"))})
    if fitting:
        out = out.where("_w + _n > 0")
    return out.withColumn("score", F.col("base") + 10 * F.col("_w") + 3 * F.col("_n") + bonus).drop("_w", "_n")


def recovered(missing: DataFrame, versions: DataFrame, now: Column | None = None, days: int = DAYS, most: int = VERSIONS) -> DataFrame:
    """(file, key, text, hash, before, place) for missing (file, key): the text that the key's call replaced, where one is found.

    place: "change" or "file". Without now, the newest version's time counts. Equal scores: the earlier line, then the text.
    """
    named = versions.withColumnRenamed("file", "path")
    newest = now if now is not None else F.lit(versions.agg(F.max("ts")).first()[0])
    young = stash(recent(named, newest, days, most).withColumnRenamed("path", "file").select("file", "hash", "ts", "message", "content"), "history-versions")
    last = young.groupBy("file").agg(F.max_by("content", F.struct("ts", "hash")).alias("content"))
    wanted = missing.select("file", "key").distinct().join(argument_names(last), ["file", "key"], "left")
    wanted = stash(wanted.withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "words": hints(F.col("key"))}), "history-keys")
    begun = introductions(young).join(wanted.select("file", "key"), ["file", "key"], "left_semi")
    begun = stash(begun, "history-starts")
    tries = stash(wanted.join(spoken(young), "file").select("file", "key", "hash", "before", F.lit(0).alias("first")).unionByName(begun), "history-pairs")

    lines = stash(changes(tries, young), "history-changes")
    removed = lines.where("sign = '-'").select("file", "before", "hash", "hunk", "pos", "line")
    ids = F.to_json(F.struct("file", "before", "hash", "hunk", "pos"))
    texts = harvest(removed.select(ids.alias("file"), F.col("line").alias("text"))).select(F.from_json("file", "file string, before string, hash string, hunk int, pos int").alias("at"), "text", F.col("score").alias("base"))
    texts = stash(texts.select("at.*", "text", "base"), "history-texts")
    asked = tries.join(wanted, ["file", "key"])
    added = lines.where("sign = '+'").select("file", "before", "hash", "hunk", F.explode(calls_of(F.col("line"))).alias("key")).distinct()
    near = _scored(asked.join(added, ["file", "before", "hash", "key"]).join(texts, ["file", "before", "hash", "hunk"]), 3)
    any_line = _scored(asked.join(texts, ["file", "before", "hash"]), 0, fitting=False)
    one = any_line.groupBy("file", "key", "first", "before", "hash", "hunk", "pos", "words", "names").agg(F.min(F.struct((-F.col("score")).alias("s"), "text", "base")).alias("b"))
    one = _scored(one.select("file", "key", "first", "before", "hash", "hunk", "pos", "words", "names", "b.text", "b.base"), 5).where(~(F.col("text").contains(".") & ~F.col("text").rlike(r"\s")))
    columns = ["file", "key", "first", "before", "hash", "hunk", "pos", "text", "score"]
    best = near.select(*columns).unionByName(one.select(*columns)).where(F.col("score") >= LEAST_CHANGE)
    change = best.groupBy("file", "key").agg(F.min(F.struct("first", (-F.col("score")).alias("s"), "hunk", "pos", "text", "before", "hash")).alias("b"))
    change = stash(change.select("file", "key", "b.text", "b.hash", "b.before", F.lit("change").alias("place")), "history-found")

    rest = begun.join(change, ["file", "key"], "left_anti").join(wanted, ["file", "key"])
    old = young.join(rest.select("file", F.col("before").alias("hash")).distinct(), ["file", "hash"], "left_semi")
    whole = harvest(old.select(F.to_json(F.struct("file", "hash")).alias("file"), F.col("content").alias("text"))).select(F.from_json("file", "file string, hash string").alias("at"), "text", F.col("score").alias("base"))
    whole = whole.select("at.file", F.col("at.hash").alias("before"), "text", "base")
    fits = _scored(rest.withColumn("names", F.array().cast("array<string>")).join(whole, ["file", "before"]), 0, fitting=False).where(F.col("score") >= LEAST_FILE)
    file = fits.groupBy("file", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), "text", "before", "hash")).alias("b"))
    return change.unionByName(file.select("file", "key", "b.text", "b.hash", "b.before", F.lit("file").alias("place")))
