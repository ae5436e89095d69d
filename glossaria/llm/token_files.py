"""Token ids in Parquet list columns: dictionary-encoded ids, delta-encoded metadata, bounded row groups and page indexes.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and Spark's Parquet writer makes one shard
file of it. A row is a document: doc_id, shard, first (ids before it in its shard), n_tokens and tokens. Ids are encoded by
a dictionary, the other columns by deltas, with small pages and page indexes: a read of some documents or of a window of
the token stream touches their pages only, a read of the metadata touches no ids. A second, tiny table has a row per shard
with the number of ids before it, made from the written metadata.

Scale: one shuffle of the texts, which carries a third of all rows with one doc_id as well as any (ties part by the hash of
the text, then of the row's place in its file). A task holds one slice of text and a table of at most PIECES encoded pieces. Shards follow the
session's shuffle partitions and adaptive sizes. What goes through one task is a row per shard.

Defined cases: null text is empty text (the end id alone); null doc_ids come first; rows with equal doc_id are ordered by
the hash of their text, and all are kept; an empty table gives a file set without rows; very long texts are one row; the
added tokens of the tokenizer's file are recognised inside texts, as the tokenizers library does; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, prepare, scratch, stash, text_slices
from .exact_dedup import from_files, place

END = 0
#: Bytes of a row group before compression, bytes and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 64 << 10, 512
#: Pieces of text whose ids a worker keeps, and the longest piece among them.
PIECES, PIECE_BYTES = 1 << 20, 16
SLICE = 1 << 19
SCHEMA = "doc_id long, shard int, first long, n_tokens int, tokens array<int>"
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": ROW_GROUP_BYTES,
    "parquet.page.size": PAGE_BYTES,
    "parquet.page.row.count.limit": PAGE_ROWS,
    "parquet.dictionary.page.size": 2 << 20,
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}

SPACE, WHITE, LETTER, DIGIT, MARK, UNSURE = range(6)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13]], _CLASS[32] = WHITE, SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[128:] = UNSURE
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = UNSURE  # control characters: left in the piece they stand in
#: Last bytes of the white space beyond ASCII, and first bytes of what may be such.
_WHITE_ENDS = np.zeros(256, bool)
_WHITE_ENDS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WHITE_STARTS = np.zeros(256, bool)
_WHITE_STARTS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * (PIECE_BYTES - 7), np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; letters from U+00C0 to U+017F count, other characters beyond ASCII are unsure."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte: only where the byte-level pre-tokenizer certainly parts, whatever stands around.

    It never joins two of letters, digits and marks (but an apostrophe and letters), nor anything before white space with
    it; the last blank of a run goes with what follows; one other white-space character stands alone.
    """
    kind = classes(data)
    before, here = kind[:-1], kind[1:]
    solid = (kind >= LETTER) & (kind <= MARK)
    sure_before = solid[:-1] | ((before == UNSURE) & ~_WHITE_ENDS[data[:-1]] & (data[:-1] >= 0x80))
    sure_here = solid[1:] | ((here == UNSURE) & ~_WHITE_STARTS[data[1:]] & (data[1:] >= 0xC0))
    out = np.zeros(len(data), bool)
    out[1:] = solid[:-1] & solid[1:] & (before != here) & ~((data[:-1] == ord("'")) & (here == LETTER))
    out[1:] |= sure_before & (here <= WHITE)
    out[1:-1] |= (here[:-1] == SPACE) & sure_here[1:]  # a blank and what follows
    alone = np.zeros(len(data), bool)
    alone[1:] = (here == WHITE) & sure_before
    starts = at[:-1][at[:-1] < len(data)]
    alone[starts] = kind[starts] == WHITE
    out[1:] |= alone[:-1] & solid[1:]
    out[starts] = True
    return out


def taken(flat: np.ndarray, off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at off and are so long, one behind the other."""
    upto = np.cumsum(count, dtype=np.int64)
    return flat[np.repeat(off - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]


class PieceIds:
    """Ids of whole texts by the tokenizers library, piece by piece: each distinct short piece is encoded once while it is kept.

    Pieces are known by their bytes (two words and a length, so short ones exactly); longer pieces, and texts that hold one
    of the tokenizer's added tokens, go to the library as they stand.
    """

    def __init__(self, path: str, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.line = self.one("\n")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.pieces, self.slots = pieces, 1 << (2 * pieces - 1).bit_length()
        self.clear()

    def one(self, text: str) -> np.ndarray:
        return np.array(self.batch([text], add_special_tokens=False)[0].ids, np.uint32)

    def clear(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.a, self.b = np.zeros(self.pieces, np.uint64), np.zeros(self.pieces, np.uint64)
        self.size, self.off, self.count = np.zeros(self.pieces, np.uint8), np.zeros(self.pieces, np.int64), np.zeros(self.pieces, np.int32)
        self.again = np.zeros(self.pieces, bool)
        self.flat, self.used, self.known = np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 for a new one."""
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        slot = self.slot(a, b, size)
        while len(todo):
            entry = self.table[slot]
            held = entry >= 0
            todo, slot, entry = todo[held], slot[held], entry[held]
            same = (self.a[entry] == a[todo]) & (self.b[entry] == b[todo]) & (self.size[entry] == size[todo])
            out[todo[same]] = entry[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (self.slots - 1)
        return out

    def slot(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + size.astype(np.uint64))) & np.uint64(self.slots - 1)).astype(np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Keep new, distinct pieces."""
        n, total = len(a), len(ids)
        if self.known + n > self.pieces:
            self.forget()
        if self.known + n > self.pieces or not n:
            return
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        new = np.arange(self.known, self.known + n)
        self.a[new], self.b[new], self.size[new], self.count[new], self.again[new] = a, b, size, count, False
        self.off[new] = self.used + np.cumsum(count) - count
        self.flat[self.used : self.used + total] = ids
        self.known, self.used = self.known + n, self.used + total
        slot, todo = self.slot(a, b, size), new
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (self.slots - 1)

    def forget(self) -> None:
        """Keep the pieces that were met again since they came, if they are at most half."""
        stay = np.flatnonzero(self.again[: self.known])
        a, b, size = self.a[stay].copy(), self.b[stay].copy(), self.size[stay].copy()
        count = self.count[stay].copy()
        ids = taken(self.flat, self.off[stay], count)
        self.clear()
        if len(stay) <= self.pieces // 2:
            self.add(a, b, size, ids, count)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece). Pieces without white space, but for one blank in front, go many at a time, a line break between two."""
        texts = [x.decode() for x in pieces]
        plain = [i for i, x in enumerate(texts) if len(y := x.split()) == 1 and (y[0] == x or (x[0] == " " and y[0] == x[1:]))] if len(self.line) == 1 else []
        parts, counts, order = [], [], []
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = self.one("\n".join([texts[i] for i in some]))
            breaks = np.flatnonzero(ids == self.line[0])
            if len(breaks) == len(some) - 1:
                order += some
                parts.append(np.delete(ids, breaks))
                counts.append(np.diff(breaks, prepend=-1, append=len(ids)) - 1)
        rest = sorted(set(range(len(texts))).difference(order))
        if rest:
            each = [x.ids for x in self.batch([texts[i] for i in rest], add_special_tokens=False)]
            order += rest
            parts.append(np.array([y for x in each for y in x], np.uint32))
            counts.append(np.array([len(x) for x in each]))
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, count, order = np.concatenate(parts), np.concatenate(counts), np.array(order)
        return taken(flat, (np.cumsum(count) - count)[back := np.argsort(order)], count[back]), count[back]

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of texts given as bytes and offsets."""
        n = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        edge = cuts(data, at)
        if self.added is not None and (odd := [m.start() for m in self.added.finditer(data.tobytes())]):
            for row in set((np.searchsorted(at, odd, "right") - 1).tolist()):
                edge[at[row] + 1 : at[row + 1]] = False
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        size = end - start
        padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
        view = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        short = size <= PIECE_BYTES
        where = np.flatnonzero(short)
        s, e, z = start[where], end[where], size[where]
        a = view[s + 8] & _MASKS[z]
        b = np.where(z > 8, view[e], np.uint64(0))
        entry = np.full(len(start), -1, np.int64)
        entry[where] = self.find(a, b, z)
        new = np.flatnonzero(entry[where] < 0)
        self.again[entry[entry >= 0]] = True
        if len(new):
            order = new[np.lexsort((z[new], b[new], a[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (z[order[1:]] != z[order[:-1]])
            lead = order[first]
            self.add(a[lead], b[lead], z[lead], *self.encode([data[i:j].tobytes() for i, j in zip(s[lead].tolist(), e[lead].tolist(), strict=True)]))
            entry[where] = self.find(a, b, z)
        held = entry >= 0
        off, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        off[held], count[held] = self.off[entry[held]], self.count[entry[held]]
        flat = self.flat
        if not held.all():  # long pieces, and short ones that the table has no room for
            once = np.flatnonzero(~held)
            ids, count[once] = self.encode([data[i:j].tobytes() for i, j in zip(start[once].tolist(), end[once].tolist(), strict=True)])
            off[once] = self.used + np.cumsum(count[once]) - count[once]
            flat = np.concatenate([flat[: self.used], ids])
        upto = np.concatenate([[0], np.cumsum(count)])
        return taken(flat, off, count), np.diff(upto[np.searchsorted(start, at)])


@lru_cache
def _piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def encoder(path: str):
    """Rows of one range, in order: each gets its ids with the end id, and the number of ids before it in this shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, done = _piece_ids(path), TaskContext.get().partitionId(), 0
        for rows, data, at in text_slices(batches, limit=SLICE):
            ids, count = encode(data, at)
            ends = np.cumsum(count)
            ids = np.insert(ids, ends, np.uint32(END)).view(np.int32)
            offsets = np.concatenate([[0], ends + np.arange(1, len(count) + 1)])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            doc_id = rows.column(rows.schema.get_field_index("doc_id"))
            columns = [doc_id, pa.array(np.full(len(count), shard, np.int32)), pa.array(done + offsets[:-1]), pa.array((count + 1).astype(np.int32)), tokens]
            done += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode docs (doc_id, text) and write them below path: `ids`, a shard file per range of doc_id, and `shards`, a row per shard."""
    spark = prepare(docs.sparkSession)
    if not from_files(docs):
        docs = stash(docs.select("doc_id", "text"), "token-docs")
    at = place(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"), F.xxhash64(at).alias("row"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "tie", "row")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(encoder(tokenizer or default_tokenizer()), SCHEMA).write.options(**FILE_OPTIONS).parquet(f"{path}/ids")
    each = _ids(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each.withColumn("before", before).coalesce(1).write.parquet(f"{path}/shards")


def _ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/ids")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, n_tokens, n_documents, before: ids of all earlier shards."""
    return spark.read.schema("shard int, n_tokens long, n_documents long, before long").parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens. Columns and rows that aren't asked for aren't read."""
    known = shards(spark, path).select("shard", "before")
    return _ids(spark, path).join(known, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")


def window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids from start to stop of the whole stream: doc_id, start and the part of tokens inside, of the shards and pages that hold them."""
    inside = shards(spark, path).where((F.col("before") < stop) & (F.col("before") + F.col("n_tokens") > start)).select("shard", "before")
    span = inside.agg(F.min("shard"), F.max("shard"), F.min("before")).first()  # one row
    if span[0] is None:
        return read(spark, path).limit(0).select("doc_id", "start", "tokens")
    rows = _ids(spark, path).where(F.col("shard").between(span[0], span[1]) & (F.col("first") < stop - span[2]))
    at = rows.join(inside, "shard").withColumn("start", F.col("before") + F.col("first")).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skipped = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    kept = (F.least(F.col("start") + F.col("n_tokens"), F.lit(stop)) - F.col("start")).cast("int") - skipped
    return at.select("doc_id", (F.col("start") + skipped).alias("start"), F.slice("tokens", skipped + 1, kept).alias("tokens"))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        tokens = rows.column(3)
        values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<i4")
        at = tokens.offsets.to_numpy().tolist()
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs and read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "token-files")
    write(docs, path, tokenizer)
    return read(spark, path).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
