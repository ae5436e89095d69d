"""What the operators of this subpackage share: tables, the shared scratch folder, folds, Arrow slices, hashes.

Nothing here collects rows; every helper works on one task's Arrow slice or returns a DataFrame.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
_folders: set[str] = set()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Used only where spark.checkpoint.dir is unset, as in tests on one machine.
FALLBACK = "/tmp/checkpoints/glossaria"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: Words of 64 bits in a broadcast bitmap of keys: 2 MB, whatever the input.
BITMAP_WORDS = 1 << 17
#: Text bytes that one vectorised slice holds (a longer text is a slice of its own): its arrays fit a core's cache.
SLICE_BYTES = 1 << 17


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where it isn't installed (local mode, other working folder).

    Arrow batches are bounded to fewer bytes than by default, as rows hold whole texts; a session that chose its own bound
    keeps it.
    """
    if spark.conf.get(BATCH_CONF, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only on one machine it may be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = FALLBACK
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application that is deleted when it ends."""
    own = f"{shared_dir(spark)}/glossaria/{spark.sparkContext.applicationId}"
    if own not in _folders:
        files, at = _file_system(spark, own)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _folders.add(own)
    path = f"{own}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table: lost executors cost no more than the rows read again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch paths this process has made and not cleared."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the scratch tables made since then, but one; results that still read them are void."""
    for path in _made[since:]:
        if path != keep:
            files, at = _file_system(spark, path)
            files.delete(at, True)
    _made[since:] = [x for x in _made[since:] if x == keep]


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever their names."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ASCII texts take the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts


def _bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(_w, _bits): at most BITMAP_WORDS words with a bit for each key's hash."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64))
    return keys.select(place.alias("_p")).groupBy(F.floor(F.col("_p") / 64).cast("long").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))


def looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _hit: whether the bitmap of keys has the key's bit."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64))
    marked = rows.withColumn("_p", place).withColumn("_w", F.floor(F.col("_p") / 64).cast("long"))
    found = marked.join(F.broadcast(_bitmap(keys, key)), "_w", "left")
    return found.withColumn("_hit", F.expr("coalesce((shiftrightunsigned(_bits, cast(_p % 64 as int)) & 1) = 1, false)")).drop("_p", "_w", "_bits")


def _met(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows that the bitmap of keys lets through (left_semi) or stops (left_anti); the bit is part of the join's condition."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64))
    marked, bits = rows.withColumn("_p", place).withColumn("_w", F.floor(F.col("_p") / 64).cast("long")), _bitmap(keys, key).withColumnRenamed("_w", "_v")
    bit = F.expr("(shiftrightunsigned(_bits, cast(_p % 64 as int)) & 1) = 1")
    return marked.join(F.broadcast(bits), (F.col("_w") == F.col("_v")) & bit, how).drop("_p", "_w")


def near_bitmap(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the wanted keys: a semi join against a bitmap of fixed size, never missing one."""
    return _met(rows, wanted, key, "left_semi")


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Anti join that shuffles only the rows whose key's bit is set; the others (most, where few keys go) stay in place."""
    sure = _met(rows, gone, key, "left_anti")
    return sure.unionByName(near_bitmap(rows, gone, key).join(gone.select(key), key, "left_anti").select(sure.columns))


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches by bytes of text; gives (rows, bytes of all texts as uint8, offsets of length rows + 1)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("").cast(pa.large_string())
        n, (_, offsets, data) = len(column), column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], (at[i : j + 1] - at[i])
            i = j
    tidy()


def tidy() -> None:
    """Give freed memory back to the system at a task's end: a worker that waits shouldn't hold its last task's arrays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- vectorised words -------------------------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in (("p", _P), ("q", _P_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, at: np.ndarray, prefixes: tuple[int, ...] = (), space: np.ndarray = _SPACE) -> tuple:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, A-Z lower-cased: (64-bit hash, row, start, end) per word in text order.

    space: by byte, whether it parts words instead. For each of prefixes, two more arrays: hash and row of the first so many bytes of each longer word.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, *[none.astype(np.uint64), none] * len(prefixes)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # a text starts here: no word goes over it
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power(n)
    total = np.cumsum(_BYTE[data] * power)
    h = total[end]
    inner = start > 0
    h[inner] -= total[start[inner] - 1]
    h *= inverse[start]
    row = np.searchsorted(at, start, "right") - 1
    more = []
    for k in prefixes:
        longer = end - start >= k
        x = total[start[longer] + k - 1] - np.where(inner[longer], total[start[longer] - 1], np.uint64(0))
        more += [mix(x * inverse[start[longer]] + np.uint64(k)), row[longer]]
    return mix(h), row, start, end + 1, *more


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
