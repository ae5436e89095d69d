"""Catalogue tables: rows (key, locale, file, value, ord), their de-duplication and their records by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of rows with equal keys the first in order; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(rows.columns)


def priority_last(rows: DataFrame, keys: list[str], priority: str, order: str = "ord") -> DataFrame:
    """Of rows with equal keys the lowest priority; of these the last in order."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(F.col(priority), -F.col(order))).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(rows.columns)


def records(rows: DataFrame, base: str = "en") -> DataFrame:
    """One row per key: locales (locale -> value), default_locale, locations. A key holds as many entries as locales."""
    locations = F.array_sort(F.collect_set(F.struct("locale", F.col("file").alias("uri"))))
    return rows.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "value")))).alias("locales"), F.when(F.bool_or(F.col("locale") == base), base).otherwise(F.min("locale")).alias("default_locale"), locations.alias("locations"))


def parts(rows: DataFrame, key: str = "key") -> DataFrame:
    """Adds ns, kind and slug of keys with three or more segments, null otherwise."""
    s = F.split(key, r"\.")
    deep = F.size(s) >= 3
    return rows.withColumns({"ns": F.when(deep, F.array_join(F.slice(s, 1, F.greatest(F.size(s) - 2, F.lit(1))), ".")), "kind": F.when(deep, F.element_at(s, -2)), "slug": F.when(deep, F.element_at(s, -1))})


def keys_per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.min("locale").alias("locale"), F.array_sort(F.collect_set("key")).alias("keys"))


def backing(rows: DataFrame) -> DataFrame:
    """Per key which kinds of file define it."""
    has = lambda p: F.bool_or(F.col("file").rlike(p))
    return rows.groupBy("key").agg(has(r"\.json$").alias("json"), has(r"/lang/.*\.php$").alias("lang"), has(r"\.resx$").alias("resx"), has(r"\.po$").alias("po"))


def text_keys(rows: DataFrame) -> DataFrame:
    """(ns, kind, text) -> key, with aliases for kind text and namespace Commons; the first in order wins."""
    base = parts(rows).where("slug is not null").select("ns", "kind", F.col("value").alias("text"), "key", "ord")
    alias = base.withColumn("kind", F.lit("text")).withColumn("ord", F.col("ord") + F.lit(0.25))
    common = base.where(F.col("key").startswith("Commons.")).withColumn("ns", F.lit("Commons")).withColumn("ord", F.col("ord") + F.lit(0.5))
    return first_wins(base.withColumn("ord", F.col("ord").cast("double")).unionByName(alias).unionByName(common), ["ns", "kind", "text"])


def number_slugs(items: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(ns, kind, slug, text, ord) -> final slug: different texts under one slug are numbered _2, _3 ... by first arrival,
    after the numbers that existing keys (ns, kind, slug) take."""
    each = items.groupBy("ns", "kind", "slug", "text").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("ns", "kind", "slug").orderBy("ord", "text")
    each = each.withColumn("n", F.row_number().over(w))
    if taken is not None:
        stem = F.regexp_replace("slug", "_[0-9]+$", "")
        used = taken.select("ns", "kind", stem.alias("slug")).groupBy("ns", "kind", "slug").agg(F.count(F.lit(1)).alias("used"))
        each = each.join(used, ["ns", "kind", "slug"], "left").withColumn("n", F.col("n") + F.coalesce("used", F.lit(0))).drop("used")
    return each.withColumn("final", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("n").cast("string"))))


def fifo(rows: DataFrame, cap: int, order: str = "ord") -> DataFrame:
    """The newest cap rows: a distributed top-k."""
    return rows.orderBy(F.desc(order)).limit(cap)


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
