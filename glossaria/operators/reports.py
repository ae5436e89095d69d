"""Counts, pivots, guards and rankings over catalogues and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small

CODES = ["missing-default", "untranslated-missing", "untranslated-same", "placeholders"]


def status(values: DataFrame, locales: DataFrame, base: str = "en") -> DataFrame:
    """Per other locale: total source keys, translated, untranslated, percent."""
    source = values.where((F.col("locale") == base) & (F.col("value") != "")).select("key", F.col("value").alias("source"))
    g = source.join(small(locales.where(F.col("locale") != base).select("locale")), how="cross").join(values.select("key", "locale", "value"), ["key", "locale"], "left")
    done = F.coalesce((F.col("value") != "") & (F.col("value") != F.col("source")), F.lit(False))
    out = g.groupBy("locale").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("translated"))
    return out.select("locale", "total", "translated", (F.col("total") - F.col("translated")).alias("untranslated"), F.round(100.0 * F.col("translated") / F.col("total"), 2).alias("percent"))


def histogram(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def health(diagnostics: DataFrame, by: str, codes: list[str] | None = None) -> DataFrame:
    """Counts by code, pivoted over the fixed codes, with the total."""
    codes = codes or CODES
    named = lambda c: c.replace("-", "_")
    return diagnostics.groupBy(by).agg(*[F.count_if(F.col("code") == c).alias(named(c)) for c in codes], F.count(F.lit(1)).alias("total"))


def top(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest, ties by name."""
    return rows.orderBy(F.desc("n"), by).limit(n)


def leaves_by_root(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.split_part("key", F.lit("."), F.lit(1)).alias("root")).agg(F.count(F.lit(1)).alias("leaves"))


def shrink(old: DataFrame, new: DataFrame, by: str, keep: float = 0.9, small: int = 120, drop: int = 10) -> DataFrame:
    """Per group old and new counts and whether the drop is allowed: groups of `small` and more by ratio, others by number."""
    a, b = old.groupBy(by).agg(F.count(F.lit(1)).alias("old")), new.groupBy(by).agg(F.count(F.lit(1)).alias("new"))
    both = a.join(b, by, "full").select(by, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    fine = F.when(F.col("old") >= small, F.col("new") >= F.floor(F.col("old") * keep)).otherwise(F.col("old") - F.col("new") <= drop)
    return both.withColumn("delta", F.col("new") - F.col("old")).withColumn("allowed", fine)


def check_shrink(old: DataFrame, new: DataFrame, by: str) -> None:
    """Raise before a write that would lose too much; the 8 worst groups are named."""
    bad = shrink(old, new, by).where("not allowed").orderBy("delta").limit(8).collect()
    if bad:
        raise ValueError("refusing to shrink: " + ", ".join(f"{r[by]} {r.old}->{r.new}" for r in bad))


def largest(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Per group the item with most rows, ties to the smaller item."""
    n = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(item).alias(item))).alias("b")).select(group, F.col(f"b.{item}").alias(item), (-F.col("b.m")).alias("n"))


def preferred(rows: DataFrame, group: str, item: str, order: list[str]) -> DataFrame:
    """Per group the item that stands first in a fixed order."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(item)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return rows.groupBy(group).agg(F.min(F.struct(rank.alias("r"), F.col(item).alias(item))).alias("b")).select(group, F.col(f"b.{item}").alias(item))


def line_ranges(issues: DataFrame, by: list[str]) -> DataFrame:
    return issues.groupBy(*by).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count(F.lit(1)).alias("n"))


def issues_by_file(issues: DataFrame) -> DataFrame:
    """Per locale and file the sorted issues (a file's own issues, bounded by its size)."""
    return issues.groupBy("locale", "file").agg(F.array_sort(F.collect_list(F.struct("key", "code"))).alias("issues"), F.count(F.lit(1)).alias("n"))


def constants(values: DataFrame, base: str = "en") -> DataFrame:
    """Keys whose base value recurs unchanged in another locale, with the number of locales."""
    source = values.where(F.col("locale") == base).select("key", F.col("value").alias("source"))
    return values.where(F.col("locale") != base).join(source, "key").where("value = source").groupBy("key").agg(F.count_distinct("locale").alias("locales"))


def plan_summary(pending: DataFrame, hits: DataFrame) -> DataFrame:
    """Per locale: missing, filled from the cache, left to translate."""
    a = hits.groupBy("locale").agg(F.count(F.lit(1)).alias("cache_applied"))
    b = pending.groupBy("locale").agg(F.count(F.lit(1)).alias("missing"))
    return b.join(a, "locale", "left").select("locale", "missing", F.coalesce("cache_applied", F.lit(0)).alias("cache_applied"), (F.col("missing") - F.coalesce("cache_applied", F.lit(0))).alias("pending"))


def unbalanced(values: DataFrame) -> DataFrame:
    n = lambda c: F.length("value") - F.length(F.replace(F.col("value"), F.lit(c), F.lit("")))
    return values.where(n("(") != n(")"))


def reported_unused(reports: DataFrame) -> DataFrame:
    """One row: how many unused keys the reports (text) list; a report that isn't JSON lists none."""
    size = F.coalesce(F.size(F.from_json("text", "unused array<string>")["unused"]), F.lit(0))
    return reports.agg(F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("unused"))


def reference_count(missing: DataFrame) -> DataFrame:
    """One row: the missing references, and the files that have any."""
    return missing.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


def compact(issues: DataFrame, usage: DataFrame) -> DataFrame:
    """(locale, locale_file, file, first_line, last_line): where in source the keys of a locale file's issues (locale, locale_file, key) are used, as one range a file."""
    found = issues.select("locale", "locale_file", "key").distinct().join(usage.select("file", "line", "key"), "key")
    return line_ranges(found, ["locale", "locale_file", "file"]).drop("n")


def markdown(counts: DataFrame) -> DataFrame:
    """One row: a Markdown table of a report's counts (rows by its first column), which are few by their nature."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    body = counts.select(F.col(counts.columns[0]).cast("string").alias("_k"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in counts.columns]).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"]), "\n")
    head = row([F.lit(c) for c in counts.columns])
    return body.agg(F.concat(head, F.lit("\n"), row([F.lit("---") for _ in counts.columns]), F.lit("\n"), lines).alias("text"))
