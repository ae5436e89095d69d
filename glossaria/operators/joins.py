"""Joins of catalogues with each other, with usage in source, with caches, answers, reports and history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import placeholders
from ..sources.scratch import small
from . import chains, fuzzy
from .catalog import blank, first_wins


def missing_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """(key, source) whose target value is absent, empty or equal to a non-empty source. Inputs: key, value, one row per key."""
    t = target.select("key", F.col("value").alias("_t"))
    return source.join(t, "key", "left").where("value <> '' and (_t is null or _t = '' or _t = value)").select("key", F.col("value").alias("source"))


def missing_by_locale(values: DataFrame, locales: DataFrame, base: str = "en") -> DataFrame:
    """The same for every other locale at once: (locale, key, source). locales holds one row per locale."""
    source = values.where(F.col("locale") == base).where("value <> ''").select("key", F.col("value").alias("source"))
    grid = source.join(small(locales.where(F.col("locale") != base).select("locale")), how="cross")
    return grid.join(values.select("key", "locale", "value"), ["key", "locale"], "left").where("value is null or value = '' or value = source").select("locale", "key", "source")


def cache_join(pending: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending (locale, key, source) against a cache (locale, source, translation): (hits, misses)."""
    both = pending.join(cache.select("locale", "source", "translation"), ["locale", "source"], "left")
    return both.where("translation is not null"), both.where("translation is null").drop("translation")


def answers_join(answers: DataFrame, pending: DataFrame, source: DataFrame) -> DataFrame:
    """Each answer (locale, key, value) with its source text and what becomes of it: applied, empty or unknown."""
    p = pending.select("locale", "key", F.col("source").alias("_p"))
    s = source.select("key", F.col("value").alias("_s"))
    text = F.coalesce("_p", "_s")
    state = F.when(blank(F.col("value")), "empty").when(text.isNull(), "unknown").otherwise("applied")
    return answers.join(p, ["locale", "key"], "left").join(s, "key", "left").select("locale", "key", "value", text.alias("source"), state.alias("state"))


def without(rows: DataFrame, keys: DataFrame, on: str | list[str] = "key") -> DataFrame:
    """Rows whose key is not among keys: unused, orphaned, unanswered, still missing, unreported."""
    return rows.join(keys.select(on), on, "left_anti")


def only(rows: DataFrame, keys: DataFrame, on: str | list[str] = "key") -> DataFrame:
    return rows.join(keys.select(on), on, "left_semi")


def fill(base: DataFrame, target: DataFrame) -> DataFrame:
    """All keys of both; the target's value wins where there is one. added tells which came from the base."""
    return base.select("key", F.col("value").alias("b")).join(target.select("key", F.col("value").alias("t")), "key", "full").select("key", F.coalesce("t", "b").alias("value"), F.col("t").isNull().alias("added"))


def prune(base: DataFrame, target: DataFrame) -> DataFrame:
    """The base's keys; the target's value where there is one."""
    return base.select("key", F.col("value").alias("b")).join(target.select("key", F.col("value").alias("t")), "key", "left").select("key", F.coalesce("t", "b").alias("value"))


def mask(source: DataFrame, keys: DataFrame) -> DataFrame:
    """The mask's keys with the source's value, else the mask's own."""
    return keys.select("key", F.col("value").alias("m")).join(source.select("key", F.col("value").alias("s")), "key", "left").select("key", F.coalesce("s", "m").alias("value"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the new value wins, old keys keep their place, new ones come behind in their order."""
    joined = old.select("key", F.col("value").alias("o"), F.col("ord").alias("oo")).join(new.select("key", F.col("value").alias("n"), F.col("ord").alias("no")), "key", "full")
    return joined.select("key", F.coalesce("n", "o").alias("value"), F.col("oo").isNull().alias("is_new"), F.coalesce("oo", "no").alias("ord"))


def insert_absent(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert that keeps an existing value."""
    return old.select("key", "value").unionByName(new.join(old.select("key"), "key", "left_anti").select("key", "value"))


def prefix_conflicts(rows: DataFrame) -> DataFrame:
    """Keys that are also a prefix of another: a tree can't hold both."""
    segments = F.split("key", r"\.")
    above = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda n: F.array_join(F.slice(segments, 1, n), "."))).alias("key"), F.col("key").alias("below")).where("key <> below").select("key").distinct()
    return rows.join(above, "key", "left_semi")


def sync_keys(keys: DataFrame, base: DataFrame, values: DataFrame, locales: DataFrame) -> DataFrame:
    """(key, locale, value) to add: the base's value for each of keys in each locale that lacks it."""
    grid = base.join(keys.select("key").distinct(), "key", "left_semi").select("key", "value").join(small(locales.select("locale")), how="cross")
    return grid.join(values.select("key", "locale"), ["key", "locale"], "left_anti").select("key", "locale", "value")


def not_deleted(keys: DataFrame, deleted: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Keys without a tombstone (key, deleted_at) younger than so many hours."""
    young = deleted.where(F.col("deleted_at") > now - F.make_interval(hours=F.lit(hours))).select("key")
    return keys.join(young, "key", "left_anti")


def key_lookup(items: DataFrame, text_keys: DataFrame) -> DataFrame:
    """items (id, ns, kind, text) -> key by the first of (Commons, kind), (ns, kind), (Commons, text), (ns, text) that is mapped.

    A join for each of them, so no item's tries have to be sorted to meet again; of several keys of one place the least counts.
    """
    keys = text_keys.groupBy("ns", "kind", "text").agg(F.min("key").alias("key"))
    out = items
    for r, (ns, kind) in enumerate([(F.lit("Commons"), F.col("kind")), (F.col("ns"), F.col("kind")), (F.lit("Commons"), F.lit("text")), (F.col("ns"), F.lit("text"))]):
        own = keys.select(F.col("ns").alias("_n"), F.col("kind").alias("_k"), F.col("text").alias("_t"), F.col("key").alias(f"_key{r}"))
        out = out.join(own, (ns == F.col("_n")) & (kind == F.col("_k")) & (F.col("text") == F.col("_t")), "left").drop("_n", "_k", "_t")
    return out.select(*items.columns, F.coalesce(*[F.col(f"_key{r}") for r in range(4)]).alias("key"))


def grid(keys: DataFrame, locales: DataFrame, values: DataFrame) -> DataFrame:
    """Every key in every locale with its value or null; locales are few and broadcast."""
    return keys.select("key").distinct().join(small(locales.select("locale").distinct()), how="cross").join(values.select("key", "locale", "value"), ["key", "locale"], "left")


def diagnostics(values: DataFrame, locales: DataFrame, base: str = "en") -> DataFrame:
    """(key, locale, code) over the grid: missing-default, untranslated (missing or same), placeholders.

    A missing value has no other code; a key without any base value is reported once, on the base locale.
    """
    source = values.where(F.col("locale") == base).select("key", F.col("value").alias("source"))
    g = grid(values, locales, values).join(source, "key", "left")
    v, s = F.col("value"), F.col("source")
    codes = F.when(F.col("locale") == base, F.when(blank(s), F.array(F.lit("missing-default"))).otherwise(F.array().cast("array<string>")))
    codes = codes.when(blank(s), F.array().cast("array<string>")).when(blank(v), F.array(F.lit("untranslated-missing")))
    rest = F.filter(F.array(F.when(v == s, "untranslated-same"), F.when((F.size(placeholders(s)) > 0) & (placeholders(s) != placeholders(v)), "placeholders")), lambda x: x.isNotNull())
    return g.select("key", "locale", F.explode(codes.otherwise(rest)).alias("code"))


def outside(matches: DataFrame, ranges: DataFrame, on: str = "file") -> DataFrame:
    """Matches (file, pos and others) in no range [start, end) of their file: found in bins of the position, so a file may have any number of either."""
    inside = chains.containing(matches.select(F.col(on).alias("file"), "pos"), ranges.select(F.col(on).alias("file"), "start", "end"))
    return matches.join(inside.select(F.col("file").alias("_f"), F.col("pos").alias("_p")), (F.col(on) == F.col("_f")) & (F.col("pos") == F.col("_p")), "left_anti")


def greedy_intervals(edits: DataFrame) -> DataFrame:
    """Edits (file, start, end, new) in order of start, each taken unless it overlaps one already taken."""
    return chains.greedy(edits)


def innermost(edits: DataFrame) -> DataFrame:
    """Edits that contain no other edit of their file."""
    return chains.innermost(edits)


def typo_repair(broken: DataFrame, known: DataFrame) -> DataFrame:
    """Of broken keys, the known key with the same prefix and the nearest last segment, within max(2, length / 4) edits."""
    cut = lambda df: df.select(F.regexp_replace("key", r"\.?[^.]*$", "").alias("path"), F.element_at(F.split("key", r"\."), -1).alias("text"), F.contains("key", F.lit(".")).alias("dotted")).select(F.struct("dotted", "path").alias("group"), "text")
    whole = lambda c: F.when(F.col("group.dotted"), F.concat("group.path", F.lit("."), c)).otherwise(F.col(c))
    found = fuzzy.nearest(cut(broken), cut(known))
    return found.select(whole("text").alias("key"), whole("near").alias("repair"), F.col("distance").cast("long").alias("distance"))


def reuse(values: DataFrame, base: str = "en") -> DataFrame:
    """For each base text, the first non-empty translation of any key with that text, by locale."""
    b = values.where((F.col("locale") == base) & (F.col("value") != "")).select("key", F.col("value").alias("text"))
    other = values.where((F.col("locale") != base) & (F.col("value") != "")).select("key", "locale", "value", "ord")
    return b.join(other, "key").groupBy("text", "locale").agg(F.min_by("value", F.struct("ord", "key")).alias("translation"))


def as_of(probes: DataFrame, history: DataFrame, by: str, at: str, when: str, value: str) -> DataFrame:
    """The latest value of each probe's group at or before its time: a union sorted by time, the last value carried forward."""
    left = probes.select(F.col(by).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(history.schema[value].dataType).alias("_v"))
    right = history.select(F.col(by).alias("_k"), F.col(when).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last").alias(value))


def cascade(keys: DataFrame, phases: list[DataFrame]) -> DataFrame:
    """For each key the value of the first phase (key, value) that has one, with the phase's number."""
    found = None
    for n, p in enumerate(phases):
        one = p.where(~blank(F.col("value"))).select("key", F.lit(n).alias("phase"), "value")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("key").agg(F.min(F.struct("phase", "value")).alias("b")).select("key", F.col("b.phase").alias("phase"), F.col("b.value").alias("value"))
    return keys.select("key").distinct().join(best, "key", "left")


def optimistic(current: DataFrame, report: DataFrame) -> DataFrame:
    """Suggestions (key, locale, current, suggested) that still fit the value in place."""
    r = report.select("key", "locale", F.col("current").alias("_c"), "suggested")
    return current.join(r, ["key", "locale"]).where("value = _c and suggested <> value").select("key", "locale", "value", "suggested")


def hunks(lines: DataFrame) -> DataFrame:
    """Diff lines (file, pos, line) with the number of the hunk that they lie in."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("hunk", F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(w))


def removed_texts(lines: DataFrame) -> DataFrame:
    """(file, key, text): quoted texts on removed lines of hunks whose added lines call t(key)."""
    h = hunks(lines).where("hunk > 0")
    added = h.where(F.col("line").startswith("+")).select("file", "hunk", F.explode(F.regexp_extract_all("line", F.lit(r"""\bt\(\s*['"]([A-Za-z0-9_.-]+)['"]"""), F.lit(1))).alias("key")).distinct()
    gone = h.where(F.col("line").startswith("-")).select("file", "hunk", F.explode(F.regexp_extract_all("line", F.lit(r"""['">]([^'"<>]{3,200})['"<]"""), F.lit(1))).alias("text")).distinct()
    return added.join(gone, ["file", "hunk"]).select("file", "key", "text").distinct()


def best_locale(values: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per key the locale to copy from: listed order, non-empty, no marks of unfinished work, sensible length."""
    order = order or ["en", "en-US", "en-GB"]
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, l in enumerate(order) for x in (l, (len(order) - i) * 10)]), F.col("locale")), F.lit(0))
    score = score + F.when(~blank(F.col("value")), 5).otherwise(0) + F.when(~F.col("value").rlike("TODO|FIXME|placeholder"), 3).otherwise(0) + F.when(F.length("value").between(3, 200), 2).otherwise(0)
    return values.withColumn("score", score).groupBy("key").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "locale", "value")).alias("b")).select("key", F.col("b.locale").alias("locale"), F.col("b.value").alias("value"), F.col("b.score").cast("long").alias("score"))


def repair_defaults(values: DataFrame, base: str = "en") -> DataFrame:
    """(key, locale, value) for keys without a base value: the best other locale's."""
    has = values.where((F.col("locale") == base) & ~blank(F.col("value"))).select("key")
    return best_locale(values.where(F.col("locale") != base).join(has, "key", "left_anti").where(~blank(F.col("value"))))


def deduplicated_work(items: DataFrame, work) -> DataFrame:
    """Do work(distinct texts -> text, result) once per distinct (source, target, normalised text), fan the result out."""
    from ..functions.text import cache_key

    keyed = items.withColumn("_k", cache_key(F.col("source"), F.col("target"), F.col("text")))
    once = first_wins(keyed.select("_k", "source", "target", "text", "ord"), ["_k"])
    return keyed.join(work(once).select("_k", "result"), "_k", "left").drop("_k")


def batches(items: DataFrame, group: str, most: int = 50, chars: int = 2000, block: int = chains.BLOCK) -> DataFrame:
    """Adds a batch number by group: a batch closes before it would pass so many items or characters. Greedy in order."""
    return chains.batches(items, group, most, chars, block)


def translate(items: DataFrame, translator, most: int = 50) -> DataFrame:
    """Adds translation by an injected callable(list of texts, locale) -> list, batch by batch; a failing batch is halved."""

    def tries(texts: list[str], locale: str) -> list[str | None]:
        try:
            return list(translator(texts, locale))
        except Exception:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return tries(texts[:half], locale) + tries(texts[half:], locale)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out: dict[int, str | None] = {}
            for locale, part in x.groupby("locale"):
                for i in range(0, len(part), most):
                    some = part.iloc[i : i + most]
                    out |= dict(zip(some.index, tries(some["source"].tolist(), locale), strict=True))
            yield x.assign(translation=pd.Series(out, dtype="object"))

    return items.mapInPandas(run, StructType([*items.schema.fields, StructField("translation", StringType())]))
