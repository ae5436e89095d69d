"""Token files, whitening and divergence against the library, exact fractions and plain Python; odd rows in each."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glossaria.llm import divergence, token_files, whitening

EXTRA = ", ".join(f"{c} string" for c in ("tie", "row", "shard", "first", "n", "term", "documents", "p0", "v", "i", "limb", "entries", "length"))
DOCS = f"doc_id long, text string, lang string, source string, {EXTRA}"
VECTORS = f"vec_id long, embedding array<float>, {EXTRA}"


@pytest.fixture(autouse=True)
def shared(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 13) for r in rows], DOCS)


def odd_documents(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["Ab", "ab", "é", "x1y", "tion", "the,", "née", "_"]) + rng.choice(["", "", "q", "Z"]) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 40)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for i in range(80)]
    rows += [(90, None, "en", "a"), (91, "", "xx", "lone"), (None, "a null id", "en", "b"), (None, None, None, None), (92, text(20_000), "en", "a"), (93, "x" * 300_000, "en", "c"), (94, " \n\t ", "yy", "p"), (95, "1 2 3", "yy", "q")]
    return documents(spark, rows + [rows[3], rows[3], (rows[4][0], "another text with this id", "en", "a")])


# ---- op11 ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


@pytest.mark.parametrize("pieces", [64, 1 << 16])
def test_piece_ids_are_the_library_s(library, pieces):
    rng = random.Random(pieces)
    parts = ["a", "B", "é", "ß", "×", "÷", "1", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r", "\x0b", ",", ".", "-", "\xa0", " ", "　", "\x85", "…", "中", "😀", "<|endoftext|>", "<|", "\x1c", "\x00", "\x7f", "the", "tion", "²", "½", "_", "x" * 20]
    encode = token_files.PieceIds(token_files.default_tokenizer(), pieces)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(40)]
        raw = [t.encode() for t in texts]
        ids, count = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def expected(library, rows):
    """(doc_id, start, n_tokens, crc32) with null ids first; rows of one doc_id in the order given."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in token_files.round_trip(docs).collect()) == want


def test_token_files_of_odd_rows(spark, library):
    docs = odd_documents(spark)
    got = token_files.round_trip(docs).toPandas().sort_values("start")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(got) == len(rows) and got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    plain = lambda i: -1 if i is None or i != i else int(i)
    assert [plain(i) for i in got.doc_id] == sorted(plain(i) for i, _ in rows)
    assert Counter((plain(i), n, c) for i, n, c in zip(got.doc_id, got.n_tokens, got.ids_crc32, strict=True)) == Counter((plain(i), n, c) for i, _, n, c in expected(library, rows))
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_token_files_layout_and_selective_reads(spark, tmp_path, library, monkeypatch):
    monkeypatch.setitem(token_files.FILE_OPTIONS, "parquet.block.size", 1 << 16)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    path = str(tmp_path / "files")
    token_files.write(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path)
    groups = pages = 0
    for file in (tmp_path / "files" / "ids").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            pages += all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
            assert all("DELTA_BINARY_PACKED" in c.encodings and "RLE_DICTIONARY" not in c.encodings for k, c in columns.items() if not k.startswith("tokens"))
    assert groups > 4 and pages == groups
    stream = np.concatenate([[*x.ids, 0] for x in library.encode_batch(texts, add_special_tokens=False)])
    for a, b in ((0, 1), (10_000, 10_777), (len(stream) - 5, len(stream) + 9), (len(stream), len(stream) + 5), (0, len(stream))):
        parts = sorted(token_files.window(spark, path, a, b).collect(), key=lambda r: r.start)
        assert [t for r in parts for t in r.tokens] == stream[a:b].tolist() and (not parts or parts[0].start == a)
    some = token_files.read(spark, path).where("doc_id between 700 and 705")
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,700)" in plan
    assert {r.doc_id: list(r.tokens) for r in some.collect()} == {i: [*library.encode(texts[i], add_special_tokens=False).ids, 0] for i in range(700, 706)}
    thin = token_files.read(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in thin


# ---- op12 ----


def exact(vectors):
    """(n, sums, n * scatter) of floor(64 c) + 1000000 in Python's integers."""
    x = [[int(Fraction(c) * 64 // 1) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def test_whitening_against_exact_sums(spark):
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(300, 6)) * [1, 2, 3, 50, 0.5, 9] + [0, 1e4, -3e3, 5, 0, 1e5]).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    odd = [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [1.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, *["x"] * 13) for r in rows + odd], VECTORS)
    got = whitening.whitened(df).toPandas()
    used = rows + odd[-2:]
    x, n, s, scatter = exact([r[1] for r in used])
    assert len(got) == len(used) * 6 and set(got.n) == {n} and got.vec_id.isna().sum() == 6
    fit = whitening.fitted(df.select("vec_id", F.col("embedding").cast("array<double>")))
    assert fit.scatter == scatter and fit.sums == [a - 1_000_000 * n for a in s]
    by_id = dict(zip([r[0] for r in used], x, strict=True))
    deviation = {i: sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for i, r in by_id.items()}
    for r in got[got.component == 1].itertuples():
        assert r.deviation == deviation[None if r.vec_id != r.vec_id else int(r.vec_id)]
    w = np.array([g.sort_values("vec_id").whitened.to_numpy() for _, g in got.groupby("component")]).T
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9 and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    values = np.linalg.eigvalsh(np.array([[float(Fraction(c, n * n)) for c in r] for r in scatter]))[::-1]
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values / values.sum(), rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, *["x"] * 13) for i, v in rows], VECTORS)
    assert whitening.whitened(frame([(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whitened(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0])] * 3)).count() == 0
    line = whitening.whitened(frame([(i, [float(i), float(2 * i)]) for i in range(9)])).toPandas()
    assert set(line.component) == {1} and np.isclose(line.whitened.std(ddof=0), 1) and np.allclose(line.explained, 1)
    huge = whitening.whitened(frame([(i, [3e38 if i else -3e38, float(i)]) for i in range(4)])).toPandas()
    assert huge.deviation.isna().all() and np.isfinite(huge.whitened).all() and huge.identity_error.max() < 1e-4


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 20, 1 << 26, 1 << 40):
        x = rng.integers(-most, most, (500, 3))
        assert (whitening.product(x) == x.astype(object).T.dot(x.astype(object))).all()
    values = [0, -1, 1 << 100, -(1 << 95) - 7, 12]
    assert [sum(part[i] << whitening.LIMB * k for k, part in whitening.limbs(values)) for i in range(5)] == values


# ---- op13 ----


def audit(rows):
    """The contract in plain Python, term by term over every kept term."""
    occur, spread, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        word, found = "", []
        for c in (text or "") + " ":
            if ord(c) >= 0x80 or "a" <= c <= "z" or "A" <= c <= "Z":
                word += c.lower() if c < "\x80" else c
            elif word:
                found.append(word)
                word = ""
        occur[lang, source].update(found)
        spread[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in spread[lang].items() if n >= 3)
        v = len(kept)
        every = sum((occur[lang, s] for s in sources), Counter())

        def prices(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + v) for t in kept}

        p, q = {s: prices(occur[lang, s]) for s in sources}, prices(every)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if occur[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= 200]
    return sorted(out)


def test_divergence_against_plain_python(spark):
    docs = odd_documents(spark)
    got = sorted(tuple(r) for r in divergence.divergences(docs).collect())
    assert got == audit([tuple(r) for r in docs.collect()])
    assert {r[1] for r in got if r[0] == "yy"} == {"p", "q"} and not [r for r in got if r[0] == "xx"]
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_divergence_of_a_skewed_source(spark, monkeypatch):
    """One source with most documents, one term in all of them; partial counts pass on in small lots."""
    monkeypatch.setattr(divergence, "HELD_ROWS", 8)
    rng = random.Random(1)
    rows = [(i, "hot " + " ".join(f"t{'abcdefghij'[rng.randrange(10)]}{'xyz'[rng.randrange(3)]}" for _ in range(rng.randrange(30))), "en", "big" if i % 3 else f"s{i % 7}") for i in range(300)]
    assert sorted(tuple(r) for r in divergence.divergences(documents(spark, rows)).collect()) == audit(rows)


def test_probabilities_of_large_counts(spark):
    rows = [(0, 0, 1), (7, 7, 3), (10**12, 3 * 10**14, 10**9), (10**14, 10**14, 5), (3, 10**15 - 1, 1)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").select(divergence.probability(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // (t + k) for n, t, k in rows]
