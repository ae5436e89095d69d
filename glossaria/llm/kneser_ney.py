"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The units are characters: the MAX_SYMBOLS most frequent of the trusted texts, all others one symbol more; an n-gram is
packed into a 64-bit code. Counts, continuation counts, the discounts D1, D2, D3+ of every order and the interpolated
probabilities come from DataFrame aggregations and joins sharded by n-gram code. The model learns from every trusted text
(quality 1) and grows with their distinct n-grams, eight bytes each; it is cut into shards of at most SHARD entries which are
broadcast, and every task joins the n-grams of its documents with each shard by binary search, so that no n-gram of a
document is ever shuffled. A document's perplexity is exp(-log p / characters).

A document is rejected if its perplexity lies above its language's threshold: MARGIN times the QUANTILE of the perplexities of trusted
texts in that language, and of about its length (powers of 4). All trusted texts count there too: those of each of FOLDS folds are
scored by a model of the other folds, as texts that a model was trained on look better than others.
Perplexities of short texts spread far more than those of long ones, so one quantile for all lengths would let long junk pass.
Where there are fewer than LEAST such texts, those of the language in all lengths set the threshold, or else those of all
languages.

Defined cases: a null or empty text has a null perplexity and is kept; a null language takes the threshold of all; without
trusted texts nothing is rejected; repeated rows get a row each; very long texts are scored whole; an empty table gives no
rows; other columns are kept by keep() and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import near_bitmap, prepare, stash, text_slices, tidy, whole, without_keys

ORDER = 4
MAX_SYMBOLS = 254
#: Entries of a broadcast shard.
SHARD = 1 << 20
#: MARGIN makes up for the quantile of a few hundred texts lying below that of all.
QUANTILE, MARGIN, LEAST = 0.995, 1.03, 50
#: Folds of the trusted texts, by hash, for the thresholds.
FOLDS = 4


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters as code points, and the number of each text's characters."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def codes(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The n-gram code (ORDER symbols, the last lowest) ending at each character; 0 stands before a text's start."""
    start = np.cumsum(length) - length
    at = np.arange(len(symbols)) - np.repeat(start, length)
    out = symbols.astype(np.int64)
    for k in range(1, ORDER):
        before = np.zeros(len(symbols), np.int64)
        before[k:] = symbols[:-k] if k else symbols
        before[at < k] = 0
        out |= before << (8 * k)
    return out


def _texts(rows: pa.RecordBatch) -> list[str]:
    return rows.column(rows.schema.get_field_index("text")).fill_null("").to_pylist()


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in text_slices(batches):
        point, n = np.unique(code_points(_texts(rows))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(point.astype(np.int64)), pa.array(n.astype(np.int64))], names=["point", "n"])


def _alphabet(points: list[int]) -> np.ndarray:
    """Symbol by code point below 2^16; 255 for those not listed."""
    out = np.full(1 << 16, 255, np.uint8)
    for i, p in enumerate(points):
        if p < 1 << 16:
            out[p] = i + 1
    return out


def to_symbols(alphabet: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.where(point < 1 << 16, alphabet[np.minimum(point, (1 << 16) - 1)], np.uint8(255))


def _counter(alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_slices(batches):
            point, length = code_points(_texts(rows))
            fold = np.repeat(rows.column(rows.schema.get_field_index("fold")).to_numpy(), length).astype(np.int64)
            both, n = np.unique(codes(to_symbols(alphabet.value, point), length) | fold << (8 * ORDER), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> (8 * ORDER)), pa.array(both & ((1 << 8 * ORDER) - 1)), pa.array(n.astype(np.int64))], names=["fold", "code", "c"])

    return run


class Model:
    """alphabet; by order (index n - 1): shards of (codes, log p) and shards of (context codes, log of the weight passed down)."""

    def __init__(self, alphabet: np.ndarray):
        self.alphabet = alphabet
        self.grams: list[list] = []
        self.contexts: list[list] = []


def _counted(trusted: DataFrame) -> tuple[np.ndarray, DataFrame] | None:
    """The alphabet of all trusted texts (text, fold), and (fold, code, c): their n-grams by fold."""
    spark = prepare(trusted.sparkSession)
    points = trusted.mapInArrow(_characters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(MAX_SYMBOLS).collect()
    if not points:
        return None
    alphabet = _alphabet([r.point for r in points])
    found = trusted.mapInArrow(_counter(spark.sparkContext.broadcast(alphabet)), "fold long, code long, c long")
    return alphabet, stash(found.groupBy("fold", "code").agg(F.sum("c").alias("c")), "grams")


def train(trusted: DataFrame) -> Model | None:
    """The model of a DataFrame of trusted texts (column text), counts and probabilities by sharded joins."""
    found = _counted(trusted.select("text", F.lit(0).cast("long").alias("fold")))
    return found and _model(*found)


def _model(alphabet: np.ndarray, grams: DataFrame) -> Model | None:
    """The model of n-grams (code, c), which may come in several rows each."""
    spark = grams.sparkSession
    counts = [stash(grams.groupBy("code").agg(F.sum("c").alias("c")), "grams")]
    if counts[0].isEmpty():
        return None
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts the shorter n-gram occurs
        counts.insert(0, stash(counts[0].groupBy(F.col("code").bitwiseAND((1 << 8 * n) - 1).alias("code")).agg(F.count(F.lit(1)).alias("c")), "grams"))
    model = Model(alphabet)
    lower = spark.range(256).select(F.col("id").alias("code"), F.lit(1 / 256).alias("p"))
    for n, table in enumerate(counts, 1):
        n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
        y = n1 / max(n1 + 2 * n2, 1)
        d1, d2, d3 = (min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        with_context = table.withColumn("context", F.shiftright("code", 8)).withColumn("d", discount)
        context = with_context.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
        if n == 1:  # every symbol has a probability
            with_context = lower.select("code").join(with_context, "code", "left").select("code", F.coalesce("c", F.lit(0)).alias("c"), F.lit(0).cast("long").alias("context"), F.coalesce("d", F.lit(0.0)).alias("d"))
        suffix = F.col("code") if n == 1 else F.col("code").bitwiseAND((1 << 8 * (n - 1)) - 1)
        joined = with_context.withColumn("suffix", suffix).join(context, "context").join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = stash(joined.select("code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("taken") / F.col("total") * F.col("below")).alias("p")), "probabilities")
        model.grams.append(_shards(lower.select("code", F.log("p").alias("v"))))
        model.contexts.append(_shards(context.select(F.col("context").alias("code"), F.log(F.col("taken") / F.col("total")).alias("v"))))
    return model


def _shards(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    # codes have 32 bits: eight bytes an entry
    found = table.select("code", F.col("v").cast("float").alias("v")).toArrow()
    code, v = found.column("code").to_numpy().astype(np.uint32), found.column("v").to_numpy().astype(np.float32)
    order = np.argsort(code)
    code, v = code[order], v[order]
    del found
    tidy()
    return [(code[i : i + SHARD], v[i : i + SHARD]) for i in range(0, max(len(code), 1), SHARD)]


def _find(shards: list, code: np.ndarray) -> np.ndarray:
    """The value of each code, nan where no shard has it."""
    out, code = np.full(len(code), np.nan), code.astype(np.uint32)
    for keys, v in shards:
        if len(keys):
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = keys[at] == code
            out[hit] = v[at[hit]]
    return out


def log_p(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(natural log of the probability, characters) of each text."""
    point, length = code_points(texts)
    if not len(point):
        return np.zeros(len(texts)), length
    code, back = np.unique(codes(to_symbols(model.alphabet, point), length), return_inverse=True)
    value, todo = np.zeros(len(code)), np.arange(len(code))
    for n in range(ORDER, 0, -1):
        now = code[todo] & ((1 << 8 * n) - 1)
        found = _find(model.grams[n - 1], now)
        missing = np.isnan(found)
        value[todo[~missing]] += found[~missing]
        todo = todo[missing]
        if n > 1 and len(todo):
            value[todo] += np.nan_to_num(_find(model.contexts[n - 1], now[missing] >> 8))
    total = np.concatenate([[0.0], np.cumsum(value[back])])
    end = np.cumsum(length)
    return total[end] - total[end - length], length


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_slices(batches):
            texts = _texts(rows)
            if model.value is None:
                n, x = np.array([len(t) for t in texts]), np.full(len(texts), np.nan)
            else:
                lp, n = log_p(model.value, texts)
                x = np.exp(-lp / np.maximum(n, 1))
            x = np.where(n > 0, x, np.nan)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), rows.column(rows.schema.get_field_index("lang")), pa.array(n, pa.int64()), pa.array(x, from_pandas=True)], names=["doc_id", "lang", "n_scored", "perplexity"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, n_scored, perplexity, threshold, kept."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # of the documents only the trusted ones, and few others that the bitmap lets through, are shuffled
    of_fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).alias("fold")
    # at any size by sorting: a broadcast of the labels' ids would do for small tables only
    trusted = stash(near_bitmap(docs, good, "doc_id").join(good.hint("merge"), "doc_id").select("doc_id", "lang", "text", of_fold), "trusted")
    found = _counted(trusted)

    def scores_of(rows: DataFrame, model: Model | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)
        out = stash(rows.mapInArrow(_scores(shared), "doc_id long, lang string, n_scored long, perplexity double"), "perplexities")
        shared.destroy()
        return out

    held = None
    for k in range(FOLDS if found else 0):
        own = scores_of(trusted.where(F.col("fold") == k), _model(found[0], found[1].where(F.col("fold") != k)))
        held = own if held is None else held.unionByName(own)
    scores = scores_of(docs, found and _model(*found))
    held = (scores.limit(0) if held is None else held).where("perplexity is not null")
    level = F.percentile_approx("perplexity", QUANTILE, 100_000) * MARGIN
    common = held.agg(level).first()[0]
    long = F.floor(F.log(4.0, F.greatest("n_scored", F.lit(1)))).cast("int").alias("long")

    def levels(name: str, *by) -> DataFrame:
        """One row per language, and length: a bounded set, as languages are few and lengths at most 32."""
        return F.broadcast(held.where("lang is not null").groupBy("lang", *by).agg(level.alias(name), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= LEAST).drop("texts"))

    out = scores.withColumn("long", long).join(levels("of_length", long), ["lang", "long"], "left").join(levels("of_language"), "lang", "left")
    threshold = F.coalesce("of_length", "of_language", F.lit(common).cast("double"))
    return out.select("doc_id", "lang", "n_scored", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected; a document with several rows goes if any of them is rejected."""
    gone = stash(scored(docs, labels).where("not kept and doc_id is not null").select("doc_id").distinct(), "rejected")
    own = docs.select(whole(docs).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"))
    return without_keys(own, gone, "doc_id").select("whole.*")
