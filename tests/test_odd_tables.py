"""Queries over small tables with odd or many rows, against their SQL."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossaria.operators import extract, fuzzy, rewrites, templates
from glossaria.plans import registry
from glossaria.sources import locales as src
from glossaria.sources import sinks

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def same(spark, sf, tmp_path):
    """same(name, table=rows...): a query and its SQL give the same rows where these tables replace those of the folder."""

    def check(name, **tables):
        c = duckdb.connect()
        for t in "region nation part documents pages benchmark conversations".split():
            df = tables.get(t)
            (spark.read.parquet(f"{sf}/{t}.parquet") if df is None else df).write.parquet(f"{tmp_path}/{t}.parquet")
            c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        found = QUERIES[name](spark, str(tmp_path))
        theirs = c.execute(f"select {', '.join(found.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, theirs)) and theirs

    return check


def table(spark, sf, name, **columns):
    """A table of the folder with other values in some columns."""
    return spark.read.parquet(f"{sf}/{name}.parquet").withColumns(columns)


def test_unignored_sharp_s(spark, sf, same):
    text = F.lit("Die Straße\nSee http\nother")
    same("unignored_lines", documents=table(spark, sf, "documents", text=text), benchmark=table(spark, sf, "benchmark", text=F.lit("die Straße\nanother")))


def test_scanned_calls_many_parts(spark, sf, same):
    """Parts whose sources are beyond the scan's limit of size if they stand in one file."""
    one = spark.read.parquet(f"{sf}/part.parquet").limit(1).drop("p_partkey", "p_name", "p_size")
    many = one.crossJoin(spark.range(60_000, numPartitions=1)).withColumns({"p_name": F.concat(F.lit("long name "), "id"), "p_size": (F.col("id") % 3).cast("int")}).withColumnRenamed("id", "p_partkey")
    same("scanned_calls", part=many)


@pytest.mark.parametrize("name", ["locale_round_trip", "php_round_trip", "locale_files", "php_files"])
def test_files_of_odd_locales(name, spark, sf, same):
    """Names of languages that no pattern of paths knows, texts that are quoted; files of a locale that are many."""
    lang = F.when(F.col("doc_id") % 3 == 0, "english").when(F.col("doc_id") % 3 == 1, "x").otherwise("en")
    same(name, documents=table(spark, sf, "documents", lang=lang, text=F.concat(F.lit("it's \\\\ \"q\"\n"), F.repeat("text", F.lit(3)))))


def test_texts_with_a_mark_of_their_own(spark, sf, same):
    own = F.element_at(F.array(*map(F.lit, ("\ufeff", "\ufeff\ufeffa", "a\ufeff", "\ufeff\na", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    same("bom_stripped", documents=table(spark, sf, "documents", text=F.when(F.col("doc_id") % 7 != 0, own), doc_id=F.when(F.col("doc_id") > 9, F.col("doc_id"))))


@pytest.mark.parametrize("name", ["locale_files", "php_files"])
def test_files_are_not_held_as_lines(name, spark, sf):
    """A locale's lines stream into its value: nothing gathers them in a list."""
    text = plan(QUERIES[name](spark, sf))
    assert "collect_list" not in text and "MapInArrow" in text


def test_files_over_several_batches(monkeypatch):
    rows = [("a", "1\n"), ("a", "ü\n"), (None, "x\n"), (None, "y\n"), ("b", "2\n"), ("b", "3\n"), ("b", "4\n")]
    whole = pa.RecordBatch.from_pylist([{"locale": k, "line": v} for k, v in rows])
    for n in (1, 2, 3, 7):
        found = [tuple(r.values()) for b in sinks._joined((whole.slice(i, n) for i in range(0, 7, n)), ["locale"]) for r in b.to_pylist()]
        assert found == [("a", "1\nü\n"), (None, "x\ny\n"), ("b", "2\n3\n4\n")]
    monkeypatch.setattr(sinks, "MOST", 5)
    with pytest.raises(ValueError, match="too large"):
        list(sinks._joined([whole], ["locale"]))


def test_shards_are_bounded(spark):
    rows = spark.range(300).select(F.lit("en").alias("locale"), F.concat(F.lit("a.b"), "id", F.lit(".c")).alias("key"), F.repeat(F.lit("x"), 100).alias("value"))
    files = sinks.shards(rows, ["locale"], most=3000).withColumn("n", F.length("text"))
    assert 8 <= files.count() <= 13 and files.agg(F.max("n")).first()[0] < 12_000
    paths = files.select(F.concat(F.lit("/locales/en/"), "part", F.lit(".json")).alias("path"), "text")
    assert sorted(map(tuple, src.catalog(paths).select("locale", "key", "value").collect())) == sorted(map(tuple, rows.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_maps_are_not_broadcast(spark):
    """Tables that grow with texts are merged, however small their files look."""
    files = spark.createDataFrame([("f", "<p>Hello there</p>")], "file string, text string")
    keys = spark.createDataFrame([("Hello there", "a.b")], "text string, key string")
    for df in (rewrites.rewritten(files, keys, "react"), rewrites.rewritten(files, keys, "vue"), extract.wrap_texts(files, keys)):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)


def test_neighbourhoods_are_not_broadcast(spark):
    texts = spark.createDataFrame([("g", "abc"), ("g", "abd")], "group string, text string")
    pairs = fuzzy.near_pairs(texts, texts, F.lit(1), F.array(F.lit(1))).where("distance > 0")
    assert "Broadcast" not in plan(pairs) and pairs.count() == 2
    keys = spark.createDataFrame([("a.b.c.title1",), ("a.b.c.title2",)], "key string")
    assert "Broadcast" not in plan(fuzzy.alike(keys, keys)) and fuzzy.best_alike(keys).count() == 2


def test_template_texts_come_in_pieces(spark):
    """Rows are handed on while a batch is read, in the order of the files, none lost."""
    pages = spark.range(60, numPartitions=1).select(F.concat(F.lit("/p"), "id", F.lit(".html")).alias("path"), F.concat(F.lit("<p>Text number "), "id", F.lit("</p>"), F.repeat(F.lit("<br>"), 20_000)).alias("text"))
    found = templates.extract_texts(spark, pages)
    assert sorted(r.text for r in found.collect()) == sorted(f"Text number {i}" for i in range(60))
    assert max(map(len, templates.pieces(((str(i), "<p>Some text</p>" * 1000) for i in range(300)), lambda p, s: [(p, s)], 1 << 20))) <= 70
