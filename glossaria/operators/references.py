"""Calls in source against what backs their keys, and the reports that editors and fixers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import language_of, severity
from .catalog import backing, blank
from .extract import CALLS, calls

# What a call's first argument can be that is no key
TAGS = "div span p h1 h2 h3 h4 h5 h6 a img ul ol li form input button section article header footer nav main aside".split()
TERMS = "class classname style color background border padding margin width height display position top left right bottom".split()


def complex_key(key: Column) -> Column:
    """Tags, style words, class names and very long keys, as compiled code calls functions with."""
    return F.lower(key).isin([*TAGS, *TERMS]) | (F.length(key) > 100) | key.rlike("rounded-xl|bg-card|text-card")


def references(files: DataFrame) -> DataFrame:
    """(file, line, key, language) of all calls, by the names that each language uses."""
    language = files.withColumn("language", language_of(F.col("file")))
    out = calls(language, CALLS["any"], keys=("file", "language"))
    php = language.where("language = 'php'")
    out = out.unionByName(calls(php, CALLS["laravel"], keys=("file", "language")))
    out = out.unionByName(calls(language.where("language = 'python'"), CALLS["python"], keys=("file", "language")))
    return out.where(F.col("key").rlike(r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z0-9_-]+)*$") & ~complex_key(F.col("key"))).distinct()


def missing_references(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """References whose key nothing backs that their language can read: PHP reads lang files and flat JSON, C# resx, Python PO."""
    b = backing(catalogue)
    any_json = b.where("json").select("key")
    valid = {"php": b.where("lang or (json and not contains(key, '.'))").select("key"), "csharp": b.where("resx or json").select("key"), "python": b.where("po or json").select("key")}
    refs = references(files)
    out = refs.where(~F.col("language").isin(list(valid))).join(any_json, "key", "left_anti")
    for language, keys in valid.items():
        out = out.unionByName(refs.where(F.col("language") == language).join(keys, "key", "left_anti"))
    return out.select("file", "line", "key", "language")


def with_severity(diagnostics: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Adds the severity that settings give each code."""
    known = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]) if levels else F.create_map(F.lit(""), F.lit(""))
    return diagnostics.withColumn("severity", severity(F.coalesce(F.element_at(known, F.col("code")), F.lit("warning"))))


def distinct_diagnostics(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.dropDuplicates(["file", "line", "key", "code"])


def style_issues(values: DataFrame, concise: DataFrame) -> DataFrame:
    """Button texts for which a shorter form is listed (value, suggested): the list is configuration, small, joined by value."""
    buttons = values.where(F.array_contains(F.split("key", r"\."), "button"))
    return buttons.join(concise, "value").where("value <> suggested").select("key", "locale", "value", "suggested")


def pruned(report: DataFrame, fixed: DataFrame) -> DataFrame:
    """A report without the (locale, key) that were fixed."""
    return report.join(fixed.select("locale", "key"), ["locale", "key"], "left_anti")


def grown(patterns: DataFrame, found: DataFrame) -> DataFrame:
    """An ignore list (pattern) with new patterns, each once."""
    return patterns.select("pattern").union(found.select("pattern")).where(~blank(F.col("pattern"))).distinct()


def checked_parameters(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Copy requests (key, source, target) with what is wrong: same_locale, unknown_key, empty_source; null if nothing."""
    known = values.select("key").distinct().withColumn("known", F.lit(True))
    source = values.select("key", F.col("locale").alias("source"), F.col("value").alias("text"))
    both = requests.join(known, "key", "left").join(source, ["key", "source"], "left")
    issue = F.when(F.col("source") == F.col("target"), "same_locale").when(F.col("known").isNull(), "unknown_key").when(blank(F.col("text")), "empty_source")
    return both.select("key", "source", "target", issue.alias("issue"))
