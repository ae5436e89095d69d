"""Toxicity by non-negative positive-unlabelled learning.

Classifiers (numpy) learn from confirmed toxic texts P and unlabelled texts U only; the class prior pi is the share of
confirmed toxic rows among the labelled rows of the training folds, or less where the commonest toxic words say so. The risk of a classifier g is
pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]): what the unlabelled texts cost as negatives, less what the toxic ones
among them would, never below zero (where the bracket is negative, its gradient is ascended). Several classifiers on
different draws of U are averaged.

A text's features are the hashes of its distinct words (runs of letters and digits, A-Z lower-cased) and of their
beginnings of PREFIXES bytes, which meet inflected forms. A classifier's
vocabulary is those features of P that are over-represented there against U, corrected by the prior, so the noise of rare words in a long text adds
nothing; the score is the logistic function of the summed weights.

Scale: the samples are bounded (MAX_POSITIVE, MAX_UNLABELLED texts, chosen by hash over all rows, with at most MAX_WORDS
words of vocabulary), the driver holds their hashes only. Scoring is one scan without shuffle over whole texts.

Defined cases: labels are read from rows whose crc32(doc_id) mod 5 is not 0 only; null text is empty text, and any text
without known words gets the score of the bias; a document with several labels is toxic if any of them says so; null doc_ids take no part in learning and are held out; repeated rows get
a row each; without any confirmed toxic text every score is 0; very long texts are scored whole; other columns are not
inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare, stash, text_slices, words

FOLDS = 5
#: Bounds of the training sample, of the vocabulary, and the number of averaged classifiers.
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS, MODELS = 2000, 6000, 4096, 3
PREFIXES = (4, 5, 6)
#: Most files of the labels by document, so that each scan of them has few tasks.
LABEL_FILES = 32
#: Least estimated share of toxic texts among those with a feature: prior * share in P / share in U.
PURITY = 0.85
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True


def distinct_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, (hash, row) by row and hash; bytes from 0x80 count as letters."""
    found = words(np.where(_LETTER[data], data, np.uint8(0x20)), at, PREFIXES)
    h, row = np.concatenate([found[0], *found[4::2]]), np.concatenate([found[1], *found[5::2]])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, row


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in text_slices(batches):
        h, row = distinct_words(data, at)
        cut = np.searchsorted(row, np.arange(len(at)))
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("part")), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["part", "words"])


class Model:
    """A vocabulary of hashes in order, a weight for each, a bias."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, bias: float):
        self.vocabulary, self.weight, self.bias = vocabulary, weight, bias

    def margin(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(rows, self.bias)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return self.bias + np.bincount(row, np.where(self.vocabulary[at] == h, self.weight[at], 0.0), rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """One classifier by full-batch Adam on the non-negative risk, with the logistic loss."""
    rng = np.random.default_rng(seed)
    u = [unlabelled[i] for i in rng.permutation(len(unlabelled))[: max(1, 2 * len(unlabelled) // 3)]] if unlabelled else []

    def count(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_counts=True)

    words_p, in_p = count(positive)
    words_u, in_u = count(u)
    at = np.minimum(np.searchsorted(words_u, words_p), max(len(words_u) - 1, 0))
    share_u = (np.where(words_u[at] == words_p, in_u[at], 0) if len(words_u) else 0 * in_p) / max(len(u), 1)
    share_p = in_p / max(len(positive), 1)
    # over-represented: the count among positives lies well above what the unlabelled share explains
    # the labelled share may overstate the prior: texts with a word of the toxic ones alone make up prior * share_p of U
    strong = np.flatnonzero((in_p >= max(4, 0.02 * len(positive))) & (share_p > 4 * share_u))
    strong = strong[np.argsort(-in_p[strong], kind="stable")][:16]
    if len(strong):
        prior = min(prior, max(1e-4, float(np.median(share_u[strong] / share_p[strong]))))
    expected = len(u) * prior * share_p  # texts of U with the feature, if it were in toxic texts only
    z = (share_p - share_u) / np.sqrt(np.maximum(share_u, 1 / max(len(u), 1)) / max(len(positive), 1))
    chosen = np.flatnonzero((z > 5) & (in_p >= max(4, 0.005 * len(positive))) & (len(u) * share_u * PURITY <= expected + 1.5 * np.sqrt(expected) * PURITY))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")][:MAX_WORDS]
    chosen = np.sort(chosen)
    vocabulary = words_p[chosen]

    def matrix(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        col, row = [], []
        for r, t in enumerate(texts):
            found = np.intersect1d(vocabulary, t, assume_unique=True)
            col.append(np.searchsorted(vocabulary, found))
            row.append(np.full(len(found), r))
        return np.concatenate([np.zeros(0, np.int64), *col]), np.concatenate([np.zeros(0, np.int64), *row])

    # of features in about the same positive texts, the rarest one among the unlabelled stays ("lose" goes, "loser" stays)
    pc, pr = matrix(positive)
    x = np.zeros((len(positive), len(vocabulary)), np.float32)
    x[pr, pc] = 1
    together, own, rare = x.T @ x, in_p[chosen], share_u[chosen]
    same = (together >= 0.9 * own[:, None]) & (own[None, :] >= 0.9 * own[:, None])
    better = same & ((rare[None, :] < rare[:, None]) | ((rare[None, :] == rare[:, None]) & (vocabulary[None, :] < vocabulary[:, None])))
    vocabulary = vocabulary[~better.any(axis=1)]
    (pc, pr), (uc, ur) = matrix(positive), matrix(u)
    w, b = np.zeros(len(vocabulary)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        gp = b + np.bincount(pr, w[pc], len(positive))
        gu = b + np.bincount(ur, w[uc], len(u))
        sp, su = _sigmoid(gp), _sigmoid(gu)
        # logistic loss: l(g) = log(1 + e^-g); derivative of l(-g) is sigmoid(g)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative_u, d_negative_p = su / len(u), -prior * sp / len(positive)
        if negative >= 0:
            dp, du = prior * (sp - 1) / len(positive) + d_negative_p, d_negative_u
        else:
            dp, du = -d_negative_p, -d_negative_u
        grad = np.append(np.bincount(pc, dp[pr], len(w)) + np.bincount(uc, du[ur], len(w)) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]  # no feature here speaks against toxicity
    return Model(vocabulary, w, float(b))


def learn(docs: DataFrame, labels: DataFrame) -> list[Model]:
    """Classifiers from bounded samples of the training folds; the prior from all labelled rows there."""
    labelled = labels.where((fold(F.col("doc_id"), FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    # one row per document, once for the prior and the sample: toxic where any of its rows says so
    labelled = stash(labelled.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).coalesce(LABEL_FILES), "labelled")
    n, n_toxic = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return []
    prior = min(0.5, max(1e-4, n_toxic / n))
    n_docs = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    share = lambda most, of: int(min(1.0, most / max(of, 1)) * (1 << 30)) + 1
    # both samples are thinned by hash first, so that no more than about their bounds is ever moved
    confirmed = labelled.where("toxic = 1").where(draw < share(MAX_POSITIVE, n_toxic)).select("doc_id").orderBy("doc_id").limit(MAX_POSITIVE)
    own = docs.where("doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != 0)
    # rows in an order that the plan doesn't change; a doc_id or a row that is there very often can't pass the bound
    bounded = lambda df, part, most: df.withColumn("_order", F.xxhash64("doc_id", "text")).orderBy("_order", "doc_id").limit(most).select(F.lit(part).alias("part"), "text")
    p = bounded(own.join(F.broadcast(confirmed), "doc_id"), 1, MAX_POSITIVE)
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(1 << 30)) < share(MAX_UNLABELLED, n_docs * (FOLDS - 1) // FOLDS))
    u = bounded(drawn, 0, 2 * MAX_UNLABELLED)
    found = p.unionByName(u).mapInArrow(_features, "part int, words binary").toArrow()
    texts = [np.frombuffer(x.as_buffer(), np.uint64) for x in found.column("words")]
    part = found.column("part").to_pylist()
    positive = [t for t, k in zip(texts, part, strict=True) if k]
    unlabelled = [t for t, k in zip(texts, part, strict=True) if not k]
    if not positive or not unlabelled:
        return []
    return [train(positive, unlabelled, prior, seed) for seed in range(MODELS)]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    models = spark.sparkContext.broadcast(learn(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            h, row = distinct_words(data, at)
            n = len(at) - 1
            s = np.mean([_sigmoid(m.margin(h, row, n)) for m in models.value], axis=0) if models.value else np.zeros(n)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(s)], names=["doc_id", "score"])

    return docs.mapInArrow(score, "doc_id long, score double").select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
