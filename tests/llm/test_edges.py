"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossaria.llm import common, context_mixing, exact_dedup, hilbert_ann, jaccard_join, kneser_ney, packing, pii, queries, sentencepiece_bpe, sql, toxicity, warc

EXTRA = ", ".join(f"{c} string" for c in ("id", "node", "key", "at", "_w", "n", "score", "_id", "row", "value", "code", "comp", "kept"))
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LABELS = "doc_id long, quality int, toxic int, text string, score double"


@pytest.fixture(autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def odd_rows():
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(60)] + [(61, None), (62, ""), (63, " \n\t "), (None, "a null id"), (None, None), (64, "x" * 300_000), (65, text(60_000)), (66, "É\x00\U0001f600 ß")]
    rows += [rows[3], rows[3], (67, rows[4][1]), (67, "another text with this id")]
    return [(i, t, None if k % 5 == 0 else "en", None, None if k % 3 == 0 else len(t or ""), *["x"] * 13) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 4 and 1, int(i % 9 == 0), "t", 0.0) for i in range(60)] + [(None, 1, 1, None, None), (5, None, None, None, None)], LABELS)


PER_ROW = {
    "toxicity": lambda d, l: toxicity.scored(d, l), "exact": lambda d, l: exact_dedup.dedup(d), "mixing": lambda d, l: context_mixing.scored(d), "pii": lambda d, l: pii.found(d), "quality": lambda d, l: kneser_ney.scored(d, l),
    "sentencepiece": lambda d, l: sentencepiece_bpe.encoded(d), "jaccard": lambda d, l: jaccard_join.join(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each(odd, labels, name):
    got = PER_ROW[name](odd, labels).toPandas()
    assert len(got) == odd.count() and got.doc_id.isna().sum() == 2


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, labels, name):
    assert PER_ROW[name](spark.createDataFrame([], SCHEMA), labels).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_no_labels(spark, odd, name):
    got = PER_ROW[name](odd, spark.createDataFrame([], LABELS)).toPandas()
    assert len(got) == odd.count() and (got.kept.all() if name == "quality" else (got.score == 0).all())


def test_packing(spark, odd):
    got = packing.packed(odd).toPandas()
    assert got.groupby("doc_id", dropna=False).ngroups == len({r[0] for r in odd_rows()}) and (got.length > 0).all()
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_redact_keeps_columns(odd):
    got = pii.redact(odd)
    assert got.columns == odd.columns and got.where("text is null").count() == 2


def test_stages(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{docs.count()}-{random.random()}")
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)


def test_survivors(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = exact_dedup.survivors(docs)
    low = {(r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in odd.collect()}
    assert kept.count() == len(low) and kept.columns == docs.columns
    near = {r.doc_id for r in jaccard_join.survivors(docs).collect()}
    assert near == {r.doc_id for r in docs.collect()} - {67}


def test_stages_keep_columns_of_any_name(spark, labels, tmp_path):
    names = ["a.b", "_metadata", "tick`name", "whole", "place", "struct(x)", "A B;{}"]
    rows = [(i, f"the same words stand here {'once' if i % 2 else 'twice'} and nothing else does", i, *[str(i)] * len(names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "n_chars", *names]).withColumn("lang", F.lit("en"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "docs"))
    for source in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, str(tmp_path))
            kept = out.count()
            assert name == "packing" or (out.columns == source.columns and all(r["a.b"] == r["tick`name"] == r["_metadata"] == str(r.doc_id) for r in out.collect()))
            assert kept == {"exact": 2, "near": 2, "pii": 6}.get(name, kept)


def test_rows_of_files_are_known_by_the_plan(spark, tmp_path):
    spark.range(4).selectExpr("id as doc_id", "'t' as text").write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert exact_dedup.from_files(read.where("doc_id > 1").select("text", "doc_id"))
    assert not exact_dedup.from_files(read.union(read)) and not exact_dedup.from_files(read.join(read.select("doc_id"), "doc_id")) and not exact_dedup.from_files(spark.range(3))
    twice = read.union(read)
    assert exact_dedup.dedup(twice).count() == 8 and exact_dedup.survivors(twice).count() == 1


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, point string, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in hilbert_ann.search(df, df).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 1] == [(1, 1, 10), (1, 2, 2), (1, 3, 11)] and {g[0] for g in got} == {1, 2, 10, 11}
    assert hilbert_ann.search(df.limit(0), df).count() == 0 and hilbert_ann.search(df, df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, None, None, "x"), (2, "http://a\nb/", "<p>", "x"), (None, "u", "z" * 2000, "x"), (3, "u", "z" * 2000, "x"), (3, "u", "z" * 2000, "x"), (4, "é", "", "x"), (5, "http://[::1]/", "y" * 900_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(df).toPandas()
    assert len(got) == len(rows) and got.record_type.value_counts().to_dict() == {"response": 6, "revisit": 1}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_registered(spark, sf):
    import duckdb
    import pandas as pd

    found = queries.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in found}) == list(range(1, 14))
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, text in sql.oracle_sql().items():
        ours, theirs = found[name](spark, sf).toPandas(), c.sql(text).df()
        columns = sorted(theirs.columns)
        key = next(k for k in (["page_id"], ["doc_id"], ["lang", "source", "part", "item"]) if k[0] in theirs)
        assert sorted(ours.columns) == columns
        pd.testing.assert_frame_equal(ours[columns].sort_values(key).reset_index(drop=True), theirs[columns].sort_values(key).reset_index(drop=True), check_dtype=False)


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage's rows from its own input: the classifier's own decisions, groups, components, redactions and ids in plain Python."""
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(path)
        judged = kneser_ney.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if name == "quality" else None
        docs = spark.read.parquet(path)
        rows[name] = after = docs.collect()
        low = {i: (r.text or "").translate(jaccard_join._LOWER) for i, r in before.items()}
        if name == "quality":
            assert {r.doc_id for r in after} == {r.doc_id for r in judged if r.kept} and len(after) < len(before)
        elif name == "exact":
            last = {t: max(i for i in low if low[i] == t) for t in set(low.values())}
            assert {r.doc_id for r in after} == set(last.values())
        elif name == "near":
            sets = {i: jaccard_join.shingle_set(t) for i, t in low.items()}
            root = {i: i for i in sets}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for x in sorted(sets):
                for y in sorted(sets):
                    if y < x and jaccard_join.linked(sets[x], sets[y]):
                        p, q = find(x), find(y)
                        root[max(p, q)] = min(p, q)
            assert {r.doc_id for r in after} == {i for i in sets if find(i) == i}
        elif name == "pii":
            assert {(r.doc_id, r.text) for r in after} == {(i, pii.redacted(r.text)) for i, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            tokenizer = Tokenizer.from_file(packing.default_tokenizer())
            want = {i: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in before.items()}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == want


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_scratch_tables_go(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of text number {i % 3} in all") for i in range(9)], "doc_id long, text string").selectExpr("*", "'en' as lang", "1L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0, "t", 0.0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    before = common.made()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert common.made() == before + 1 and out.select("doc_id").distinct().count() == 3
    common.clear(spark, before)
    assert common.made() == before
