"""N-gram Jaccard join by universe partition and the pigeonhole principle; every link is verified on the words themselves.

A document's set is its distinct 5-word shingles (64-bit hashes here, words again in the verification). Two sets X, Y with
Jaccard >= 0.8 differ in at most H = (|X| + |Y|) / 9 shingles. Sizes are cut into bands; a band's universe is cut by a
hash into m segments, somewhat more than the largest H of its pairs. A set indexes, under its own band, every non-empty
segment subset, and for the first D segments its one-deletion neighbourhood. The larger set of a pair probes its own band
and, where sizes allow, the band below with an allocation v: 0 skips a segment, 1 asks for an equal subset, 2 for one
that differs by at most one shingle. As sum(v) >= H + 1, one segment must answer, so no link is missed. The allocation is
by cost, over all documents: once the lists are gathered their lengths are known, and each set takes v = 0 for as many
segments as it can spare, those with the longest lists. 2 serves sets with fewer than H + 1 segments in use. Sets
that no allocation covers ("loose") are compared with all sets of fitting size in the bands beside theirs; they come up about
never.

Copies of a set are one node from the start: rows in the lists carry the first 64 bits of the set's hash, and sets that
share these without being equal are candidates themselves. Equal 128-bit hashes count as equal sets; every other link is
verified on the words. Each list yields star pairs to one hub first, found in a streaming pass over the sorted shuffle
partition, so a list of any length costs its length. After the stars are verified and joined into components, the sets of
lists that still span components meet a few neighbours each in random orders of their lists, which joins most of a large
group at a cost in proportion to its lists. Then all pairs of a probing and an indexed set of one list
that lie in different components and are not yet verified are verified too: every link between components is found, links
within one are not needed for the classes. Before verification two sound bounds apply: the sizes, and the parity bitmaps of
both sets (at least two bits a shingle), whose differing bits can't outnumber the differing shingles.

Defined cases: null or blank texts have n_shingles 0 and link with nothing; fewer than five words make one shingle of the
whole sequence; a null doc_id takes no part and has a null component; repeated rows get a row each with the same
component, and each row of a doc_id with several texts links it; an empty table gives no rows; very long texts are
cut into slices of their own and never truncated; other columns of any name are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, mix, near_bitmap, prepare, stash, text_slices, tidy, to_signed, whole, without_keys, words
from .components import components

N = 5
LEAST = 4  # smallest size with a partner that is not equal: 4 of 5
#: Rows of a list up to which its length is exact; a longer one counts as this long.
LONG = 1 << 13
SALT_ROWS = 512
#: Sets with more copies than this, and than a HEAVY-th of all rows, are met by broadcast: at most HEAVY of them.
COPIES, HEAVY = 512, 1 << 14
#: Distinct sets that a task remembers, so as not to emit copies again.
SEEN = 1 << 16
BITS = ["p0", "p1", "p2", "p3"]
CARRIED = ["n", *BITS, "whole"]
#: In lists that still span components after the stars: rounds of random orders, and neighbours there that a set meets.
ROUNDS, BESIDE = 2, 2
#: Rows of a list: own band (indexed, may probe), band below (may probe), probes of one-deletion neighbourhoods, indexed one-deletions.
OWN, BELOW, TWICE, DELETED = 0, 1, 2, 3


@lru_cache
def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowest size, highest size, segments, segments with one-deletion neighbourhoods) by band."""
    lo, hi = [LEAST], []
    while lo[-1] < 1 << 40:
        hi.append(max(lo[-1] + 2, int(lo[-1] * 1.6)))
        lo.append(hi[-1] + 1)
    lo, hi = np.array(lo[:-1]), np.array(hi)
    m = np.ceil(0.26 * hi).astype(np.int64) + 4
    return lo, hi, m, np.where(hi <= 64, m, -(-m // 32))


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hash, row) sorted by row and hash, and the number per row."""
    h, row, _, _ = words(data, at)
    rows = len(at) - 1
    count = np.bincount(row, minlength=rows)
    c = mix(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(0, np.uint64)
    full_row = np.zeros(0, np.int64)
    if len(h) >= N:
        k = len(h) - N + 1
        whole = row[:k] == row[N - 1 :]
        x = np.zeros(k, np.uint64)
        for i in range(N):
            x += h[i : i + k] * c[i]
        full, full_row = x[whole], row[:k][whole]
    short = (count > 0) & (count < N)
    if short.any():
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        mine = short[row]
        x = np.zeros(rows, np.uint64)
        np.add.at(x, row[mine], h[mine] * c[np.arange(len(h))[mine] - first[row[mine]]])
        x += count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        full, full_row = np.concatenate([full, x[short]]), np.concatenate([full_row, np.flatnonzero(short)])
    x = mix(full)
    order = np.lexsort((x, full_row))
    x, full_row = x[order], full_row[order]
    if len(x):
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (full_row[1:] != full_row[:-1])
        x, full_row = x[new], full_row[new]
    return x, full_row, np.bincount(full_row, minlength=rows)


def set_hash(x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(x):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        hi[row[first]] = np.add.reduceat(mix(x + np.uint64(0x1234567)), first)
        lo[row[first]] = np.add.reduceat(mix(x ^ np.uint64(0xABCDEF0123456789)), first)
    return hi, lo


def parity(x: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A bitmap per set, each bit the parity of the shingles that fall on it: two bits a shingle or more, a power of two.

    Gives the bitmaps folded to 4 words of 64 bits, and whole. A bitmap folds by the exclusive or of its halves.
    """
    words = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(words)])
    at = start[row] * 64 + ((x >> np.uint64(8)).astype(np.int64) & (words[row] * 64 - 1))
    odd = (np.bincount(at, minlength=start[-1] * 64) & 1).astype(np.uint8)
    bits = np.packbits(odd, bitorder="little").view(np.int64)
    whole = [bits[i:j] for i, j in zip(start[:-1], start[1:], strict=True)]
    return np.array([np.bitwise_xor.reduce(b.reshape(-1, 4), axis=0) for b in whole]).reshape(len(size), 4), whole


class Scheme:
    """The segments of the sets of one slice under one band each.

    spare is the number of a set's segments that need not probe; where it is negative, so many of its segments with
    one-deletion neighbourhoods probe for these too. A set that lacks even those is loose.
    """

    def __init__(self, x: np.ndarray, row: np.ndarray, size: np.ndarray, band: np.ndarray):
        _, hi, m, d = bands()
        rows, b = len(size), band[row]
        token = mix(x + np.uint64(0x51ED270B) * (b + 1).astype(np.uint64))
        seg = (((token >> np.uint64(32)) * m[b].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((seg, row))
        self.token, t_row, t_seg = token[order], row[order], seg[order]
        new = np.ones(len(order), bool)
        new[1:] = (t_seg[1:] != t_seg[:-1]) | (t_row[1:] != t_row[:-1])
        first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # segment entry of each token
        self.row, self.seg = t_row[first], t_seg[first]
        self.count = np.diff(np.append(first, len(order)))
        self.sum = np.add.reduceat(self.token, first) if len(first) else np.zeros(0, np.uint64)
        self.place = (self.seg.astype(np.uint64) << np.uint64(8)) + band[self.row].astype(np.uint64) + np.uint64(1)
        self.deletes = (self.seg < d[band[self.row]]) & (self.count >= 2)
        need = (size + np.minimum(size, hi[np.maximum(band, 0)])) // 9 + 1
        self.spare = np.bincount(self.row, minlength=rows) - need
        short = np.maximum(-self.spare, 0)
        self.loose = short > np.bincount(self.row[self.deletes], minlength=rows)
        # the first short[row] entries with neighbourhoods of each set probe for these
        mine = np.flatnonzero(self.deletes)
        start = np.searchsorted(self.row[mine], np.arange(rows))
        self.twice = np.zeros(len(self.row), bool)
        self.twice[mine] = np.arange(len(mine)) - start[self.row[mine]] < short[self.row[mine]]

    @staticmethod
    def keyed(content: np.ndarray, place: np.ndarray, space: int) -> np.ndarray:
        return mix(content ^ mix(place + np.uint64(space << 60))) & ~np.uint64(3)

    def deletions(self, entries: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, row) of each subset of the marked entries with one shingle taken out."""
        mine = entries[self.of]
        of = self.of[mine]
        return self.keyed(self.sum[of] - self.token[mine], self.place[of], space), self.row[of]

    def rows(self, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(keys, row, code) of what goes into the lists: subsets in space 0, one-deletions of indexed sets in space 1."""
        yield self.keyed(self.sum, self.place, 0), self.row, OWN if own else BELOW
        if own:
            yield *self.deletions(self.deletes, 1), DELETED
        if self.twice.any():
            yield *self.deletions(self.twice, 0), TWICE
            yield self.keyed(self.sum[self.twice], self.place[self.twice], 1), self.row[self.twice], TWICE


def schemes(x: np.ndarray, row: np.ndarray, size: np.ndarray) -> Iterator[tuple[Scheme, bool]]:
    """The schemes of a slice: own bands, then for those sets that can be larger partners across, the band below."""
    lo, hi, _, _ = bands()
    band = np.searchsorted(lo, size, "right") - 1
    mine = (band >= 0)[row]
    if mine.any():
        yield Scheme(x[mine], row[mine], size, band), True
    below = (band >= 1) & (-(-4 * size // 5) <= hi[np.maximum(band - 1, 0)])
    mine = below[row]
    if mine.any():
        yield Scheme(x[mine], row[mine], size, np.where(below, band - 1, -1)), False


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column(rows.schema.get_field_index("doc_id"))
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


_PROFILE = "doc_id long, n long, hi long, lo long, own long, below long, loose boolean, " + ", ".join(f"{x} long" for x in BITS) + ", whole array<long>"


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in text_slices(batches):
        x, row, size = shingles(data, at)
        hi, lo = set_hash(x, row, len(size))
        loose, spare = np.zeros(len(size), bool), np.zeros((2, len(size)), np.int64)
        for s, own in schemes(x, row, size):
            met = np.bincount(s.row, minlength=len(size)) > 0
            loose |= s.loose & met
            spare[0 if own else 1] = np.where(met, np.maximum(s.spare, 0), 0)
        folded, whole = parity(x, row, size)
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(b) for b in whole])]), pa.int32()), pa.array(np.concatenate(whole)))
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), *map(pa.array, (size, to_signed(hi), to_signed(lo), *spare, loose)), *map(pa.array, np.ascontiguousarray(folded.T)), whole], names=[c.split()[0] for c in _PROFILE.split(", ")])


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Emits (key with code, node): a node is the first hash of a set, so copies of a set are one node."""
    seen: set[int] = set()
    for rows, data, at in text_slices(batches):
        _, valid = _ids(rows)
        x, row, size = shingles(data, at)
        hi, _ = set_hash(x, row, len(size))
        use = valid & (size >= LEAST)
        if len(seen) > SEEN:
            seen.clear()
        for i, k in zip(np.flatnonzero(use).tolist(), hi[use].tolist(), strict=True):
            use[i] = k not in seen
            seen.add(k)
        mine = use[row]
        keys, nodes = [], []
        for s, own in schemes(x[mine], row[mine], np.where(use, size, 0)):
            for key, r, code in s.rows(own):
                keys.append(key | np.uint64(code))
                nodes.append(hi[r])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(to_signed(np.concatenate(keys))), pa.array(to_signed(np.concatenate(nodes)))], names=["sig", "node"])


_GATHERED = "key long, node long, code int, hub long, hub_code int, length int"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (sig, node): the lists of at least two sets, one of them indexed and another probing.

    Each row gets its list's hub (the first row) and length. Memory is one Arrow batch and LONG rows of the open list:
    beyond these its rows go out as they come, with LONG + 1 as their length.
    """
    held_sig, held_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_key, long_hub, long_code = None, 0, 0

    def rows(sig: np.ndarray, node: np.ndarray, hub: np.ndarray, hub_code: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig >> 2), pa.array(node), pa.array((sig & 3).astype(np.int32)), pa.array(hub), pa.array(hub_code.astype(np.int32)), pa.array(length.astype(np.int32))], names=[c.split()[0] for c in _GATHERED.split(", ")])

    def closed(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
        """Whole lists."""
        if not len(sig):
            return None
        key, code = sig >> 2, sig & 3
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        length = np.diff(np.append(start, len(sig)))
        last = start + length - 1
        # codes ascend in a list: some row is indexed if the first is OWN or the last DELETED, some row may probe if the first isn't DELETED
        good = (length > 1) & (code[start] != DELETED) & ((code[start] == OWN) | (code[last] == DELETED))
        out = good[of]
        at = start[of[out]]
        return rows(sig[out], node[out], node[at], code[at], np.minimum(length, LONG + 1)[of[out]]) if out.any() else None

    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)  # copies of a set meet here
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        if long_key is not None:
            n = int(np.searchsorted(sig >> 2, long_key, "right"))
            if n:
                yield rows(sig[:n], node[:n], np.full(n, long_hub), np.full(n, long_code), np.full(n, LONG + 1))
            if n == len(sig):
                continue
            long_key, sig, node = None, sig[n:], node[n:]
        if len(held_sig) and held_sig[-1] == sig[0] and held_node[-1] == node[0]:
            sig, node = sig[1:], node[1:]
        sig, node = np.concatenate([held_sig, sig]), np.concatenate([held_node, node])
        cut = int(np.searchsorted(sig >> 2, sig[-1] >> 2))
        if (done := closed(sig[:cut], node[:cut])) is not None:
            yield done
        held_sig, held_node = sig[cut:], node[cut:]
        if (n := len(held_sig)) > LONG:
            long_key, long_hub, long_code = held_sig[0] >> 2, held_node[0], held_sig[0] & 3
            yield rows(held_sig, held_node, np.full(n, long_hub), np.full(n, long_code), np.full(n, LONG + 1))
            held_sig, held_node = held_sig[:0], held_node[:0]
    if (done := closed(held_sig, held_node)) is not None:
        yield done


_LOWER = str.maketrans(UPPER, LOWER)
_SPACES = re.compile("[\x20\x09-\x0d]+")


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    w = [x for x in _SPACES.split((text or "").translate(_LOWER)) if x]
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(N)), strict=False)) if len(w) >= N else {tuple(w)}


def linked(a: set, b: set) -> bool:
    if not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, held_set = None, set()
    for x in batches:
        keep = []
        for a, ta, tb in zip(x.a, x.text_a, x.text_b, strict=True):
            if held != (a, ta):
                held, held_set = (a, ta), shingle_set(ta)
            keep.append(linked(held_set, shingle_set(tb)))
        yield x.loc[np.array(keep, bool), ["a", "b"]]
    tidy()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of doc_ids whose word sets link; the hub's text is salted over many pairs."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    texts = stash(near_bitmap(own, ids, "id").join(ids, "id").dropDuplicates(["id", "text"]), "pair-texts")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    left = texts.withColumnsRenamed({"id": "a", "text": "text_a"}).join(salts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).drop("salts").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return left.join(right, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a long, b long").distinct()


def _may_link(a: str, b: str) -> str:
    """Sound bounds for a pair whose sizes and parity bits carry these endings, the cheap ones first."""
    folded = " + ".join(f"bit_count({x}{a} ^ {x}{b})" for x in BITS)
    # of two lengths, the longer bitmap is folded once
    word = f"(whole{a}[i] ^ if(size(whole{a}) > size(whole{b}), whole{a}[i + size(whole{b})], 0L)) ^ (whole{b}[i] ^ if(size(whole{b}) > size(whole{a}), whole{b}[i + size(whole{a})], 0L))"
    apart = f"aggregate(sequence(0, least(size(whole{a}), size(whole{b})) - 1), 0, (sum, i) -> sum + bit_count({word}))"
    return f"5 * least(n{a}, n{b}) >= 4 * greatest(n{a}, n{b}) and case when 9 * ({folded}) > n{a} + n{b} then false when size(whole{a}) = 4 and size(whole{b}) = 4 then true else 9 * ({apart}) <= n{a} + n{b} end"


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (hi, lo, n) with the columns of their set. Sets with a large share of all rows, of which there can be but
    HEAVY, are met by broadcast, so that no task gets all rows of one."""
    total = rows.count()
    heavy = F.col("copies") > max(COPIES, total // HEAVY)
    big = sets.where(heavy).drop("copies")
    found = rows.join(F.broadcast(big.withColumn("_big", F.lit(True))), ["hi", "lo", "n"], "left")
    hot = found.where("_big").drop("_big")
    return hot.unionByName(found.where("_big is null").select(rows.columns).join(sets.where(~heavy).drop("copies"), ["hi", "lo", "n"]))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, representative (smallest doc_id with an equal set)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiled = stash(docs.mapInArrow(profile, _PROFILE), "profiles")
    nodes = profiled.where("n > 0 and doc_id is not null")
    facts = ["own", "below", "loose", *CARRIED[1:]]  # the same in all copies of a set
    sets = stash(nodes.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in facts]), "sets")

    shared = docs.mapInArrow(lists, "sig long, node long").repartition(F.shiftright("sig", 2)).sortWithinPartitions("sig", "node").mapInArrow(gather, _GATHERED)
    shared = stash(shared, "lists")
    # the allocation: of each set and band, the spare segments with the longest lists don't probe
    place = F.row_number().over(Window.partitionBy("node", "code").orderBy(F.desc("length"), "key"))
    spare = sets.groupBy(F.col("hi").alias("node")).agg(F.min("own").alias("own"), F.min("below").alias("below"))
    probes = F.when(F.col("code") == OWN, F.col("place") > F.col("own")).when(F.col("code") == BELOW, F.col("place") > F.col("below")).otherwise(F.col("code") == TWICE)
    shared = shared.join(spare, "node").withColumn("place", place).select("key", "node", "code", "hub", "hub_code", probes.alias("probes")).where(f"probes or code in ({OWN}, {DELETED})")
    shared = stash(shared, "allocated")

    def represented(pairs: DataFrame) -> DataFrame:
        """Pairs (node_a, node_b) as distinct pairs (a < b) of representatives within the bounds."""
        for x in ("a", "b"):
            pairs = pairs.join(sets.select("hi", "rep", *CARRIED).withColumnsRenamed({"hi": f"node_{x}", "rep": x, **{c: f"{c}_{x}" for c in CARRIED}}), f"node_{x}")
        return pairs.where(f"a <> b and {_may_link('_a', '_b')}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    fits = f"hub <> node and ((probes and hub_code = {OWN}) or (hub_code in ({BELOW}, {TWICE}) and code = {DELETED}))"
    stars = shared.where(fits).select(F.least("hub", "node").alias("node_a"), F.greatest("hub", "node").alias("node_b")).distinct()
    # sets that share the first hash are one node: they are pairs as well
    twins = sets.groupBy("hi").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("hi").alias("node_a"), F.col("hi").alias("node_b"))
    tried = stash(represented(stars.unionByName(twins)), "stars")
    # a doc_id with several texts connects their sets
    several = nodes.select("doc_id", "hi", "lo", "n").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    own = nodes.join(several, "doc_id", "left_semi").join(sets.select("hi", "lo", "n", "rep"), ["hi", "lo", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    comps = components(stash(verified(tried, docs).unionByName(own), "links"))

    def unsettled(lists: DataFrame) -> DataFrame:
        """The rows of those lists that span components and have a set that probes."""
        at = lists.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        spanning = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("probes").alias("some"), F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts")).where("some and x <> y").select("key", "salts")
        return at.join(spanning, "key")

    def linked_further(new: DataFrame) -> DataFrame:
        more = stash(verified(new, docs), "links")
        return comps if more.isEmpty() else components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))

    thin = unsettled(shared.select("key", F.col("node").alias("hi"), F.expr(f"code in ({OWN}, {DELETED})").alias("indexed"), "probes").join(sets.select("hi", "rep"), "hi")).drop("comp", "salts")
    held = stash(thin.join(sets.select("hi", "rep", *CARRIED), ["hi", "rep"]), "unsettled")
    side = F.struct("rep", "comp", "indexed", "probes", *CARRIED)
    for turn in range(ROUNDS):
        # each set of a list that still spans components beside the next ones of a random order
        chance = F.xxhash64("hi", "key", F.lit(turn))
        place = Window.partitionBy("key", F.pmod(chance, F.col("salts"))).orderBy(chance)
        met = unsettled(held).withColumn("one", side).withColumns({f"next{k}": F.lag("one", k).over(place) for k in range(1, BESIDE + 1)})
        beside = met.select("one", F.explode(F.array(*[f"next{k}" for k in range(1, BESIDE + 1)])).alias("two"))
        flat = beside.select(*[F.col(f"{x}.{c}").alias(f"{c}_{y}") for x, y in (("one", "a"), ("two", "b")) for c in ("rep", "comp", "indexed", "probes", *CARRIED)])
        close = flat.where(f"comp_a <> comp_b and (probes_a and indexed_b or probes_b and indexed_a) and {_may_link('_a', '_b')}")
        new = stash(close.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "neighbours")
        if new.isEmpty():
            break
        comps, tried = linked_further(new), tried.unionByName(new)
    # what still spans components: all pairs of different components that the bounds let through
    held = unsettled(held).drop("salts")
    p, i = (held.where(side).select("key", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", *CARRIED)]) for x, side in (("a", "probes"), ("b", "indexed")))
    found = p.join(i, "key").where(f"comp_a <> comp_b and {_may_link('_a', '_b')}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = stash(found.unionByName(_beside(sets)).distinct(), "pairs")
    new = stash(found.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not new.isEmpty():
        comps = linked_further(new)
    classed = stash(sets.select("hi", "lo", "n", "rep", "copies").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("hi", "lo", "n", "copies", "rep", F.coalesce("comp", "rep").alias("comp")), "classes")
    out = _with_sets(nodes.select("doc_id", "hi", "lo", "n"), classed).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("rep").alias("representative"))
    rest = profiled.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("representative"))
    return out.unionByName(rest)


def _beside(sets: DataFrame) -> DataFrame:
    """Pairs of each loose set with every set of fitting size that the bounds let through, met by size class."""
    a, b = ([F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in CARRIED]] for x in ("a", "b"))
    loose = sets.where("loose").select(*a).withColumn("wide", F.explode(F.sequence(F.floor(F.log2(F.col("n_a") * 0.79)), F.floor(F.log2(F.col("n_a") * 1.26)))))
    others = sets.select(*b, F.floor(F.log2("n")).alias("wide"))
    return loose.join(others, "wide").where(f"a <> b and {_may_link('_a', '_b')}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the smallest doc_id, of its rows all with it.

    Documents without words stay, as they link with nothing; rows with a null doc_id stay.
    """
    gone = stash(join(docs).where("component_id <> doc_id").select("doc_id").distinct(), "near-gone")
    own = docs.select(whole(docs).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"))
    return without_keys(own, gone, "doc_id").select("whole.*")
