"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are projected to DIMS dimensions CURVES times (random orthonormal directions, a random shift each, seeds fixed) and
put in the order of their Hilbert keys, range-partitioned by Spark. The order's ranks cut each curve into blocks; a query
looks at all blocks that its window touches, the windows of all curves merge, and candidates are reranked by inner product
in double precision on the original vectors.

The half-width of the windows, as a share of all rows, is measured rather than guessed: for PILOT queries drawn by hash the
exact neighbours are found by one scan in blocks, and the smallest share of WIDTHS is taken at which the windows hold
AIM of them (a share of 1 is an exact scan). Data that a curve can follow gets narrow windows; isotropic data, on which
no index helps, gets wide ones. Every row is indexed.

Equal vectors are one point with a list of its K + 1 smallest ids, which is exact since no query needs more; so a third of
all rows in one place makes no large block. Blocks hold the same number of points, however the data are spread.

Defined cases: vectors that are null, of length zero or with null or non-finite components, of a length other than the
commonest, or zero take no part; a null id takes no part; of repeated rows (equal id) each is a candidate once per id;
queries with fewer candidates than K get all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stash

K = 20
CURVES, DIMS, BITS = 8, 8, 7
#: Points of a block: as many as half a window, within these bounds, so that a query meets about three blocks of a curve.
BLOCK, MOST = 512, 1 << 16
PILOT, AIM = 96, 0.96
WIDTHS = (0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.2, 0.25, 0.35, 0.5, 1.0)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dims), bits per dimension: Gray-code walk over the bit planes."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for i in range(dims):
            up = (x[i] >> plane) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> plane) & 1 == 1, flip ^ ((1 << plane) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> plane & 1)
    return key


def curves(dim: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(CURVES):
        q, _ = np.linalg.qr(rng.normal(size=(dim, min(DIMS, dim))))
        out.append((q, rng.uniform(0, 1, q.shape[1])))
    return out


def keys(vectors: np.ndarray, curve: tuple[np.ndarray, np.ndarray], mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Keys of vectors on one curve; the box of 4 spreads to each side of the mean takes 4 / 5 of the grid, the shift the rest."""
    directions, shift = curve
    scale = np.maximum(np.sqrt((directions**2).T @ spread**2), 1e-300)
    at = ((vectors - mean) @ directions / scale / 8 + 0.5 + shift * 0.25) / 1.25
    return hilbert((np.clip(at, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64), BITS)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k best scores, ties to the smaller id."""
    if score.shape[1] > 4 * k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        return [np.flatnonzero(row >= e)[np.lexsort((ids[np.flatnonzero(row >= e)], -row[row >= e]))][:k] for row, e in zip(score, edge[:, 0], strict=True)]
    return [np.lexsort((ids, -row))[:k] for row in score]


def points(vectors: DataFrame, column: str) -> DataFrame:
    """Distinct usable vectors: point (smallest id), ids (the K + 1 smallest), v."""
    v = F.col(column).cast("array<double>")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    size = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    own = own.join(F.broadcast(size.select("d")), F.size("v") == F.col("d"), "left_semi").distinct()
    # the K + 1 smallest ids of each distinct vector: by parts first, so that one vector with very many ids is no hot spot
    part = Window.partitionBy("h", "v", "part").orderBy("vec_id")
    whole = Window.partitionBy("h", "v").orderBy("vec_id")
    keyed = own.withColumn("h", F.xxhash64("v")).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = keyed.withColumn("r", F.row_number().over(part)).where(F.col("r") <= K + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= K + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("point"), "ids", "v")


def search(vectors: DataFrame, queries: DataFrame, column: str = "embedding", widths: tuple = WIDTHS) -> DataFrame:
    """query_id, rank, vec_id, score of the K nearest found of each row of queries (vec_id and the vector column)."""
    spark = prepare(vectors.sparkSession)
    base = stash(points(vectors, column), "points")
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    dim = len(base.select("v").first()[0])
    moments = base.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(dim)]), F.array(*[F.coalesce(F.stddev_pop(F.col("v")[i]), F.lit(0.0)) for i in range(dim)])).first()
    setup = spark.sparkContext.broadcast((curves(dim), np.array(moments[0]), np.array(moments[1])))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, mean, spread = setup.value
        for x in batches:
            if len(x):
                m = _matrix(x["v"])
                yield pd.DataFrame({"point": x["point"], "keys": list(np.stack([keys(m, c, mean, spread) for c in lines], axis=1))})

    # ranks: rows in key order, numbered by partition and place, then the partitions' first ranks added
    order = base.select("point", "v").mapInPandas(keyed, "point long, keys array<long>").select("point", F.posexplode("keys").alias("curve", "key"))
    dealt = order.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point").withColumn("at", F.monotonically_increasing_id())
    dealt = stash(dealt, "order")
    task = F.shiftright("at", 33)
    first = dealt.groupBy("curve", task.alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("least"))
    first = first.withColumn("before", F.sum("rows").over(Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("curve", "task", "least", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = stash(dealt.withColumn("task", task).join(F.broadcast(first), ["curve", "task"]).select("point", "curve", (F.col("before") + F.col("at") - F.col("least")).alias("rank")), "ranks")

    v = F.col(column).cast("array<double>")
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), v.alias("q")).where("query_id is not null")
    hash_of = lambda c: F.xxhash64(c)
    asked = asked.distinct().withColumn("h", hash_of("q")).join(base.select("point", hash_of("v").alias("h"), "v"), "h").where(F.col("q") == F.col("v")).select("query_id", "point", F.col("v").alias("q"))
    asked = stash(asked, "queries")
    total = asked.count()
    if not total:
        return spark.createDataFrame([], schema)

    # the pilot: exact neighbours of a few queries, and how far from them they lie on the curves
    share = int(min(1.0, 1.5 * PILOT / total) * (1 << 30)) + 1
    pilot = asked.where(F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(1 << 30)) < share).orderBy(F.xxhash64("query_id")).limit(PILOT).select("query_id", "point", "q").toPandas()
    if not len(pilot):
        pilot = asked.orderBy("query_id").limit(PILOT).toPandas()
    held = spark.sparkContext.broadcast((pilot["query_id"].to_numpy(), pilot["point"].to_numpy(), _matrix(pilot["q"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, own, q = held.value
        for x in batches:
            if len(x):
                score, p = q @ _matrix(x["v"]).T, x["point"].to_numpy()
                score[own[:, None] == p[None, :]] = -np.inf
                for i, c in enumerate(best(score, p, K)):
                    yield pd.DataFrame({"query_id": ids[i], "own": own[i], "point": p[c], "score": score[i, c]})

    near = base.select("point", "v").mapInPandas(scan, "query_id long, own long, point long, score double").where(F.col("score") > float("-inf"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point"))).where(F.col("r") <= K)
    apart = near.join(ranked.withColumnRenamed("rank", "there"), "point").join(ranked.select(F.col("point").alias("own"), "curve", "rank"), ["own", "curve"])
    apart = apart.groupBy("query_id", "point").agg(F.min(F.abs(F.col("there") - F.col("rank"))).alias("apart")).agg(*[F.avg((F.col("apart") <= w * n).cast("double")) for w in widths]).first()
    width = next((w for w, reached in zip(widths, apart, strict=True) if (reached or 0) >= AIM), 1.0) if any(x is not None for x in apart) else 1.0
    half = int(np.ceil(width * n))

    # blocks of the curves meet the queries whose windows touch them; a full width needs one curve only
    order_used = ranked.where("curve = 0") if half >= n else ranked
    size = min(max(BLOCK, half), MOST)
    block = F.floor(F.col("rank") / size).cast("long")
    stored = order_used.withColumn("block", block).join(base.select("point", "v"), "point").select("curve", "block", "point", F.lit(None).cast("long").alias("query_id"), "v")
    last = (n - 1) // size
    window = F.sequence(F.greatest(F.floor((F.col("rank") - half) / size), F.lit(0)).cast("long"), F.least(F.floor((F.col("rank") + half) / size), F.lit(last)).cast("long"))
    looking = order_used.join(asked, "point").withColumn("block", F.explode(window)).select("curve", "block", "point", "query_id", F.col("q").alias("v"))

    def rerank(rows: pd.DataFrame) -> pd.DataFrame:
        is_query = rows["query_id"].notna().to_numpy()
        q, c = rows[is_query], rows[~is_query]
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, p = q["query_id"].to_numpy(np.int64), c["point"].to_numpy()
        m, out = _matrix(c["v"]), []
        own, qv = q["point"].to_numpy(), _matrix(q["v"])
        for i in range(0, len(q), 1024):
            score = qv[i : i + 1024] @ m.T
            # a query's own point counts for its other ids: it is added from the list of ids afterwards
            score[own[i : i + 1024, None] == p[None, :]] = -np.inf
            for j, found in enumerate(best(score, p, K)):
                found = found[score[j, found] > -np.inf]
                out.append((np.full(len(found), ids[i + j]), p[found], score[j, found]))
        return pd.DataFrame({"query_id": np.concatenate([x[0] for x in out]), "point": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = stored.unionByName(looking).groupBy("curve", "block").applyInPandas(rerank, "query_id long, point long, score double")
    # one exact score per pair, whichever block it came from
    top = found.groupBy("query_id", "point").agg(F.max("score").alias("score"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point"))).where(F.col("r") <= K).select("query_id", "point")
    pairs = top.unionByName(asked.select("query_id", "point"))
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    full = pairs.join(asked.select("query_id", "q"), "query_id").join(base, "point").withColumn("score", exact).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.withColumn("rank", place).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
