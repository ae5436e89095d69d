"""Language-model scoring by online logistic context mixing.

A text is its UTF-8 bytes and an end symbol. Each symbol is a path of binary decisions in a code tree chosen by the byte
before (Huffman trees of the training counts, so a byte takes about as many decisions as it has bits of order-1 entropy).
Three predictors, each a table hashed by a context (two bytes, four bytes, the letters of the word so far; A-Z lower-cased), give the
odds of a decision's bit from the training counts of their context. A mixer adds the odds with weights gated by the depth
in the tree and the place in the word, and a refinement by gate and step of the mixed odds corrects the sum. Weights and
refinements start from values learned on all training texts, and both adapt
after every block of BLOCK symbols of the text itself; the predictors' counts don't change while a text is scored. Texts are
lower-cased (A-Z) first, as for the base. The cost in bits of all decisions is the text's code length; score is its log10 probability, bits_per_byte the length per byte.

Starting values are fitted across PARTS parts of the training texts: a part's decisions are tallied by gate and steps of the
three odds, which come from the counts of the other parts, so no text vouches for itself. The tally has a fixed number of
cells; weights by gate and then refinements are the likeliest ones for it (Newton's method). The final predictors count all parts.

The base is an add-one unigram over word tokens; its counts, and those of the predictors, come from all training texts
(crc32(doc_id) mod 7 is not 2).

Scale: tables have a fixed number of slots, tasks add counts in them and send the non-zero ones by shard; a shard is summed
and turned into odds by one task. The base's frequent tokens (at most HEAVY) are broadcast, only the others are joined
by shuffle, each document's repeated tokens counted first; no key of that join occurs more often than the rarest broadcast
one in training. Everything is processed in slices of bounded size.

Defined cases: null text is empty text (one end token, the end symbol's cost); a null doc_id is in fold 0, learned from and
returned as null; repeated rows get a row each; very long texts are scored whole, block by block; without training texts
every symbol costs the same tree path at even odds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare, stash, text_slices, to_signed, words

FOLDS, HELD = 7, 2
END, SYMBOLS = 256, 257
#: Slots of the predictors' tables, and shards of each.
SLOTS = (1 << 15, 1 << 16, 1 << 17)
SHARDS = 128
#: Parts of the training texts for the first weights, and steps of a predictor's odds in the tally of decisions.
PARTS, LEVELS = 2, 32
#: Passes over texts that are given to set the first weights.
EPOCHS = 4
BLOCK, GATES, RATE = 256, 15, 0.006
#: A predictor's weight where nothing is known.
FIRST = 0.4
#: Steps of the mixed odds that have a refinement of their own under each gate, and its rate.
STEPS, REFINING = 24, 0.02
HEAVY = 1 << 17
#: The mixed odds end here on either side, so no bit is impossible.
EDGE = np.float32(11.5)
#: Odds are kept as eighths in a byte.
SCALE = 16.0
#: Bytes of a slice, few enough for a core's cache with all arrays over its decisions; decisions tallied at a time.
SLICE, COUNTED = 1 << 16, 1 << 22
_END_TOKEN = np.uint64(0x9D39247E33776D41)
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_INSIDE = np.append(_LETTERS, False)
_LOW = np.arange(SYMBOLS, dtype=np.uint16)
_LOW[ord("A") : ord("Z") + 1] += 32


# ---- symbols, trees, contexts -----------------------------------------------------------------------------------


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (A-Z lower-cased) with their ends, each text's number of symbols, and each symbol's place in its text."""
    length = np.diff(at) + 1
    ends = np.cumsum(length) - 1
    is_end = np.zeros(ends[-1] + 1, bool)
    is_end[ends] = True
    out = np.full(len(is_end), END, np.uint16)
    out[~is_end] = _LOW.take(data)
    place = np.arange(len(out), dtype=np.int32) - np.repeat((ends - length + 1).astype(np.int32), length)
    return out, length, place


def before(symbols: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The symbol k places before, 0 before the text's start. place is 0 where a text begins."""
    out = np.zeros(len(symbols), np.uint16)
    out[k:] = symbols[:-k]
    for start in np.flatnonzero(place == 0).tolist():
        out[start : start + k] = 0  # where a text is shorter, the next one's first places are meant too
    return out


def _scatter(x: np.ndarray) -> np.ndarray:
    """16 well-mixed bits of 32."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x >> np.uint32(16)


@lru_cache(2)
def _word_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)):
        x = np.full(n, base, np.uint32)
        x[0] = 1
        out.append(np.multiply.accumulate(x, dtype=np.uint32))
    return out[0], out[1]


class Trees:
    """A code tree by the byte before: (first, length) of each leaf's path in flat arrays of nodes and bits.

    Every symbol that occurs in training has a leaf (without any counts, all have). Those that never do, of which nothing is
    known, share one more and cost the same there.
    """

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(256, SYMBOLS).astype(np.float64)
        seen = (counts.sum(0) > 0) | (counts.sum() == 0)
        seen[END] = True
        listed = np.flatnonzero(seen)
        unseen = SYMBOLS - len(listed)
        leaves = self.leaves = max(2, len(listed) + (unseen > 0))
        self.leaf = np.full(SYMBOLS, leaves - 1, np.uint16)
        self.leaf[listed] = np.arange(len(listed))
        self.shared = leaves - 1 if unseen else -1
        self.rest_bits = float(np.log2(max(unseen, 1)))
        by_leaf = np.zeros((256, leaves))
        by_leaf[:, : len(listed)] = counts[:, listed]
        share = by_leaf.sum(0) / max(by_leaf.sum(), 1)
        nodes, bits = [], []
        self.first = np.zeros(256 * leaves, np.int32)
        self.length = np.zeros(256 * leaves, np.int32)
        at = 0
        for prev in range(256):
            for leaf, path in enumerate(self._huffman(by_leaf[prev] + 0.5 * share + 1e-3)):
                self.first[prev * leaves + leaf], self.length[prev * leaves + leaf] = at, len(path)
                nodes += [n for n, _ in path]
                bits += [b for _, b in path]
                at += len(path)
        self.node, self.bit = np.array(nodes, np.uint32), np.array(bits, np.int8)
        self.sign = (2 * self.bit - 1).astype(np.float32)
        part = (counts.sum(1) + 1) / (counts.sum() + 256)
        self.regions = []
        for slots in SLOTS:
            size = np.maximum(1, (part * (slots - 256)).astype(np.int64))
            self.regions.append((np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint32), size.astype(np.uint32)))

    @staticmethod
    def _huffman(weight: np.ndarray) -> list[list[tuple[int, int]]]:
        """Of each leaf, the (node, bit) pairs from the root."""
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        child = {}
        for fresh in range(n, 2 * n - 1):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            child[fresh] = (a[1], b[1])
            heapq.heappush(heap, (a[0] + b[0], fresh))
        paths: list = [None] * n
        todo = [(heap[0][1], [])]
        while todo:
            i, path = todo.pop()
            if i < n:
                paths[i] = path
            else:
                todo += [(c, [*path, (i - n, bit)]) for bit, c in enumerate(child[i])]
        return paths

    def slots(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The byte before, the slot of each predictor, and the letters of the word so far (4 stands for more)."""
        b1, b2, b3, b4 = (before(symbols, place, k) for k in (1, 2, 3, 4))
        raw, by = b1, b1.astype(np.intp)
        # letters of the word so far: difference of weighted sums over the run of letters before each symbol
        n = len(symbols)
        inside = _INSIDE.take(b1)
        inside[place == 0] = False
        index = np.arange(n, dtype=np.int32)
        run = np.maximum.accumulate(np.where(inside, np.int32(-1), index))
        power, inverse = _word_power(1 << (max(n, SLICE) - 1).bit_length())
        b1 = b1.astype(np.uint32)
        total = np.cumsum((b1 + np.uint32(1)) * power[:n], dtype=np.uint32)
        word = (total - total.take(run)) * inverse[:n] + b1
        four = b2 | b3.astype(np.uint32) << np.uint32(9) | b4.astype(np.uint32) << np.uint32(18)
        out = []
        for context, (start, size) in zip((b2.astype(np.uint32), four, word), self.regions, strict=True):
            out.append(start.take(by) + (_scatter(context) * size.take(by) >> np.uint32(16)))
        return raw.astype(np.uint32), out, np.minimum(index - run, 4)


# ---- training ---------------------------------------------------------------------------------------------------


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, c): 0 a word token's hash, 1 a pair of byte before and symbol."""
    pairs = np.zeros(256 * SYMBOLS, np.int64)
    held, size = [], 0

    def out(kind: int, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(c)], names=["kind", "key", "c"])

    for _, data, at in text_slices(batches):
        h, _, _, _ = words(data, at)
        held.append(np.concatenate([h, np.full(len(at) - 1, _END_TOKEN)]))
        size += len(held[-1])
        symbols, _, place = stream(data, at)
        pairs += np.bincount(before(symbols, place, 1).astype(np.int64) * SYMBOLS + symbols, minlength=len(pairs))
        if size > 1 << 21:
            key, c = np.unique(np.concatenate(held), return_counts=True)
            yield out(0, to_signed(key), c)
            held, size = [], 0
    if held:
        key, c = np.unique(np.concatenate(held), return_counts=True)
        yield out(0, to_signed(key), c)
    some = np.flatnonzero(pairs)
    if len(some):
        yield out(1, some, pairs[some])


def _context_counts(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, leaf = np.uint32(trees.value.leaves), trees.value.leaf
        counts = [np.zeros(s * int(leaves), np.int32) for s in SLOTS]
        for _, data, at in text_slices(batches, limit=SLICE):
            symbols, _, place = stream(data, at)
            found = leaf.take(symbols)
            for table, slot in zip(counts, trees.value.slots(symbols, place)[1], strict=True):
                # in place: a count of all cells at once would make an array of the table's size
                np.add.at(table, (slot * leaves + found).astype(np.intp), np.int32(1))
        for k, table in enumerate(counts):
            for shard, part in enumerate(np.split(table, SHARDS)):
                some = np.flatnonzero(part)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shard], pa.int32()), pa.array([some.astype(np.uint32).tobytes()]), pa.array([part[some].astype(np.uint32).tobytes()])], names=["k", "shard", "at", "c"])

    return run


def _odds(trees, parts: int):
    def turned(k: int, shard: int, table: np.ndarray) -> bytes:
        slots, leaves = SLOTS[k] // SHARDS, trees.value.leaves
        table = table.reshape(slots, leaves)
        out = np.zeros((slots, leaves), np.int8)
        start, size = trees.value.regions[k]
        for prev in range(256):
            a, b = max(int(start[prev]) - shard * slots, 0), min(int(start[prev]) + int(size[prev]) - shard * slots, slots)
            if a >= b or not table[a:b].any():
                continue
            sides = np.zeros((2, leaves, leaves), np.float32)
            row = slice(prev * leaves, (prev + 1) * leaves)
            first, length = trees.value.first[row], trees.value.length[row]
            leaf = np.repeat(np.arange(leaves), length)
            path = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
            sides[trees.value.bit[path], leaf, trees.value.node[path]] = 1
            zero, one = table[a:b] @ sides[0], table[a:b] @ sides[1]
            out[a:b] = np.clip(np.rint(np.log((one + 0.3) / (zero + 0.3)) * SCALE), -127, 127)
        return out.tobytes()

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sum a shard's counts task by task, and turn them into the odds of every node of every slot: of all parts, and without each."""
        k, shard = int(key[0]), int(key[1])
        table = np.zeros((parts, SLOTS[k] // SHARDS * trees.value.leaves), np.float32)
        for x in batches:
            for part, at, c in zip(x["part"], x["at"], x["c"], strict=True):
                table[part, np.frombuffer(at, np.uint32)] += np.frombuffer(c, np.uint32)
        every = table.sum(0)
        without = range(parts) if parts > 1 else ()
        odds = [turned(k, shard, every), *(turned(k, shard, np.delete(table, part, 0).sum(0)) for part in without)]
        yield pd.DataFrame({"without": [-1, *without], "k": k, "shard": shard, "odds": odds})

    return run


class Mixer:
    """Trees, the predictors' odds, and the gated weights that a text starts from."""

    def __init__(self, trees: Trees, odds: list[np.ndarray]):
        self.trees, self.odds = trees, odds
        self.weight = np.full((GATES, len(SLOTS)), FIRST, np.float32)
        self.refined = np.zeros(GATES * STEPS, np.float32)

    def cells(self, levels: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tally's cell of every decision: gate, the level of each predictor's odds, bit."""
        symbols, _, place = stream(data, at)
        b1, slots, letters = self.trees.slots(symbols, place)
        leaves = np.uint32(self.trees.leaves)
        path = b1 * leaves + self.trees.leaf.take(symbols)
        count = self.trees.length.take(path)
        ends = np.cumsum(count, dtype=np.int32)
        begin = ends - count
        of = np.repeat(np.arange(len(symbols), dtype=np.int32), count)
        at_path = (self.trees.first.take(path) - begin).take(of)
        at_path += np.arange(len(of), dtype=np.int32)
        node = self.trees.node.take(at_path)
        out = (letters.astype(np.int32) * np.int32(3) + np.int32(2)).take(of)
        out[begin] -= 2
        out[begin[count > 1] + 1] -= 1
        for table, slot in zip(levels, slots, strict=True):
            out *= np.int32(LEVELS)
            out += table.take((slot * leaves).take(of) + node)
        out *= np.int32(2)
        out += self.trees.bit.take(at_path)
        return out

    def cost(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text, and the weights and refinements that each text ends with."""
        symbols, length, place = stream(data, at)
        docs = len(length)
        b1, slots, letters = self.trees.slots(symbols, place)
        # all texts move on together, a block of each at a time
        step = place // BLOCK
        order = np.argsort(step.astype(np.int16) if step.max() < 1 << 15 else step, kind="stable")
        steps = np.bincount(step)
        # texts numbered from the one with most blocks on: those still there in a step are the first ones
        blocks = (length + BLOCK - 1) // BLOCK
        number = np.empty(docs, np.int32)
        number[np.argsort(-blocks, kind="stable")] = np.arange(docs)
        there = docs - np.cumsum(np.bincount(blocks))[: len(steps)]
        b1 = b1.take(order)
        leaf, leaves = self.trees.leaf.take(symbols), self.trees.leaves
        path = b1.astype(np.intp) * leaves + leaf.take(order)
        count = self.trees.length.take(path)
        ends = np.cumsum(count, dtype=np.int64)
        begin = ends - count
        # the symbol that each decision belongs to: marks at the first decisions, summed up
        marks = np.zeros(ends[-1], np.int8)
        marks[begin[1:]] = 1
        of = np.cumsum(marks, dtype=np.int64)
        at_path = (self.trees.first.take(path) - begin).take(of, mode="clip")
        at_path += np.arange(ends[-1])
        node, sign = self.trees.node.take(at_path, mode="clip").astype(np.intp), self.trees.sign.take(at_path, mode="clip")
        doc = np.repeat(number, length)
        kind = letters.take(order) * np.int32(3) + doc.take(order) * np.int32(GATES)
        gate = (kind + np.int32(2)).astype(np.intp).take(of, mode="clip")
        gate[begin] = kind  # a symbol's first decision, its second, and all others
        second = count > 1
        gate[begin[second] + 1] = kind[second] + 1
        step_of = gate * STEPS
        # every index is in range: mode clip only spares the check for it
        x = []
        for odds, slot in zip(self.odds, slots, strict=True):
            at_odds = (slot.take(order).astype(np.intp) * leaves).take(of, mode="clip")
            at_odds += node
            x.append(np.multiply(odds.take(at_odds, mode="clip"), np.float32(1 / SCALE), dtype=np.float32))
        w = [np.tile(self.weight[:, k], docs) for k in range(len(SLOTS))]
        refined = np.tile(self.refined, docs)
        nats = np.empty(ends[-1], np.float32)
        a = 0
        for end, n in zip(ends[np.cumsum(steps) - 1].tolist(), there.tolist(), strict=True):
            g, s = gate[a:end], sign[a:end]
            margin = w[0].take(g, mode="clip")
            margin *= x[0][a:end]
            for k in range(1, len(SLOTS)):
                margin += w[k].take(g, mode="clip") * x[k][a:end]
            # the refinement of these odds: what the text, and the training texts before it, showed where the odds were alike
            like = margin * np.float32(1.5)
            like += np.float32(STEPS / 2)
            np.maximum(like, 0, out=like)
            like = np.minimum(like, STEPS - 1, out=like).astype(np.intp)
            like += step_of[a:end]
            margin += refined.take(like, mode="clip")
            margin *= s
            np.maximum(margin, -EDGE, out=margin)
            np.minimum(margin, EDGE, out=margin)
            wrong = 1 / (1 + np.exp(margin))  # probability of the other bit
            np.log(1 - wrong, out=nats[a:end])
            wrong *= s
            for k in range(len(SLOTS)):
                w[k][: n * GATES] += RATE * np.bincount(g, wrong * x[k][a:end], n * GATES).astype(np.float32)
            refined[: n * GATES * STEPS] += REFINING * np.bincount(like, wrong, n * GATES * STEPS).astype(np.float32)
            a = end
        # a text's decisions lie together in each step: sums over these runs, then over the steps
        run = np.concatenate([[0], np.flatnonzero(np.diff(doc.take(order) + step.take(order).astype(np.int64) * docs)) + 1])
        bits = -np.bincount(doc.take(order.take(run)), np.add.reduceat(nats, begin.take(run), dtype=np.float64), docs)
        unseen = np.bincount(doc[leaf == self.trees.shared], minlength=docs) * self.trees.rest_bits
        weight = np.stack(w, axis=1).reshape(docs, GATES, -1)
        return (bits / np.log(2) + unseen)[number], weight[number], refined.reshape(docs, -1)[number]


def _trees(pairs: list[tuple[int, int]]) -> Trees:
    counts = np.zeros(256 * SYMBOLS, np.int64)
    for key, c in pairs:
        counts[key] = c
    return Trees(counts)


def _predictors(parts: list[DataFrame], trees) -> DataFrame:
    """(without, k, shard, odds): the odds of each shard, from all parts (-1), and if there are several, without each."""
    counted = [p.select("text").mapInArrow(_context_counts(trees), "k int, shard int, at binary, c binary").withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    every = counted[0]
    for c in counted[1:]:
        every = every.unionByName(c)
    return every.groupBy("k", "shard").applyInPandas(_odds(trees, len(parts)), "without int, k int, shard int, odds binary")


def _mixer(trees: Trees, found: DataFrame, without: int = -1) -> Mixer:
    odds = [np.zeros((s, trees.leaves), np.int8) for s in SLOTS]
    for r in found.where(F.col("without") == without).collect():
        n = SLOTS[r.k] // SHARDS
        odds[r.k][r.shard * n : (r.shard + 1) * n] = np.frombuffer(r.odds, np.int8).reshape(n, trees.leaves)
    return Mixer(trees, [o.reshape(-1) for o in odds])


def _tally(mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GATES * LEVELS ** len(SLOTS) * 2, np.int64)
        levels = [level(np.arange(-128, 128)).astype(np.uint8)[o.view(np.uint8) ^ 128] for o in mixer.value.odds]
        held, size = [], 0
        for _, data, at in text_slices(batches, limit=SLICE):
            held.append(mixer.value.cells(levels, data, at))
            size += len(held[-1])
            if size > COUNTED:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    return run


def level(odds: np.ndarray) -> np.ndarray:
    """The step of odds (sixteenths, -128 to 127) in the tally; those around 0 share one."""
    return np.minimum((odds + 128 + 128 // LEVELS) * LEVELS >> 8, LEVELS - 1)


def _newton(x: np.ndarray, one: np.ndarray, zero: np.ndarray, start: np.ndarray, offset: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By group the likeliest weights of x (rows, k) for counts of ones and zeros, drawn to their start by one decision's weight."""
    w = start.astype(np.float64)
    k, n = x.shape[1], len(w)

    def loss(w: np.ndarray) -> np.ndarray:
        m = offset + (x * w[group]).sum(1)
        return np.bincount(group, one * np.logaddexp(0, -m) + zero * np.logaddexp(0, m), n) + 0.5 * ((w - start) ** 2).sum(1)

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(offset + (x * w[group]).sum(1), -40, 40)))
        wrong, bend = zero * p - one * (1 - p), (one + zero) * p * (1 - p)
        g = np.stack([np.bincount(group, wrong * x[:, i], n) for i in range(k)], 1) + w - start
        h = np.stack([np.stack([np.bincount(group, bend * x[:, i] * x[:, j], n) for j in range(k)], 1) for i in range(k)], 1) + np.eye(k)
        move = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        rate = np.ones(n)
        for _ in range(20):  # a step that loses is halved
            then = loss(w - rate[:, None] * move)
            if (better := then <= now + 1e-9 * np.abs(now)).all():
                break
            rate[~better] /= 2
        w, now = w - np.where(better, rate, 0.0)[:, None] * move, np.where(better, then, now)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fitted(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and refinements by gate and step from the tally of decisions: cells and their counts."""
    pair, bit = cell >> 1, (cell & 1).astype(bool)
    pair, back = np.unique(pair, return_inverse=True)
    one, zero = np.bincount(back[bit], n[bit], len(pair)), np.bincount(back[~bit], n[~bit], len(pair))
    middle = np.array([np.mean([o for o in range(-128, 128) if level(np.array(o)) == k]) for k in range(LEVELS)]) / SCALE
    x = np.stack([middle[pair // LEVELS**i % LEVELS] for i in range(len(SLOTS) - 1, -1, -1)], 1)
    gate = pair // LEVELS ** len(SLOTS)
    weight = _newton(x, one, zero, np.full((GATES, len(SLOTS)), FIRST), np.zeros(len(pair)), gate)
    margin = (x * weight[gate]).sum(1)
    step = gate * STEPS + np.clip(margin * 1.5 + STEPS / 2, 0, STEPS - 1).astype(np.int64)
    refined = _newton(np.ones((len(pair), 1)), one, zero, np.zeros((GATES * STEPS, 1)), margin, step)
    return weight.astype(np.float32), refined[:, 0].astype(np.float32)


def train_across(parts: list[DataFrame], pairs: list[tuple[int, int]]) -> Mixer:
    """Predictors from all texts of all parts; the first weights from the texts of each part under the predictors of the others."""
    spark = prepare(parts[0].sparkSession)
    trees = _trees(pairs)
    shared = spark.sparkContext.broadcast(trees)
    found = stash(_predictors(parts, shared), "predictors")
    tally = None
    for i, p in enumerate(parts):
        others = spark.sparkContext.broadcast(_mixer(trees, found, i))
        cells = stash(p.select("text").mapInArrow(_tally(others), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "decisions")
        others.destroy()
        tally = cells if tally is None else tally.unionByName(cells)
    cells = tally.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most GATES * LEVELS^3 * 2 rows
    mixer = _mixer(trees, found)
    if len(cells):
        mixer.weight, mixer.refined = fitted(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    return mixer


def train(texts: DataFrame, mixing: list[str], pairs: list[tuple[int, int]]) -> Mixer:
    """Predictors from all texts; pairs: counts of (byte before, symbol); mixing: given texts that set the first weights."""
    spark = prepare(texts.sparkSession)
    trees = _trees(pairs)
    mixer = _mixer(trees, _predictors([texts], spark.sparkContext.broadcast(trees)))
    if mixing:
        encoded = [t.encode() for t in mixing]
        data, at = np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded])])
        for _ in range(EPOCHS):
            _, w, refined = mixer.cost(data, at)
            mixer.refined = refined.mean(0).astype(np.float32)
            mixer.weight = w.mean(0).astype(np.float32)
    return mixer


# ---- scoring ----------------------------------------------------------------------------------------------------

_OUT = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, bits double, known long, base double, rare array<long>, times array<long>"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, heavy, log_heavy = model.value
        row = TaskContext.get().partitionId() << 33
        for rows, data, at in text_slices(batches, limit=SLICE):
            n = len(at) - 1
            bits, _, _ = mixer.cost(data, at)
            h, r, _, _ = words(data, at)
            tokens = np.bincount(r, minlength=n) + 1
            h, r = np.concatenate([h, np.full(n, _END_TOKEN)]), np.concatenate([r, np.arange(n)])
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(h)))
            h, r = h[first], r[first]
            if len(heavy):
                place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                hit = heavy[place] == h
            else:
                place, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            base = np.bincount(r[hit], times[hit] * log_heavy[place[hit]], n) if hit.any() else np.zeros(n)
            known = np.bincount(r[hit], times[hit], n).astype(np.int64)
            rest = ~hit
            cut = pa.array(np.searchsorted(r[rest], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(n)), rows.column(rows.schema.get_field_index("doc_id")), rows.column(rows.schema.get_field_index("held_out")), pa.array(tokens.astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), pa.array(bits), pa.array(known), pa.array(base),
                pa.ListArray.from_arrays(cut, pa.array(to_signed(h[rest]))), pa.ListArray.from_arrays(cut, pa.array(times[rest].astype(np.int64))),
            ], names=[x.split()[0] for x in _OUT.split(", ")])
            row += n

    return run


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"))
    trained = own.where("not held_out")
    counts = stash(trained.select("text").mapInArrow(_token_counts, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c")), "tokens")
    tokens = counts.where("kind = 0").select("key", "c")
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the most frequent tokens by a threshold from a histogram of counts (a few hundred rows), so that no task sends its own top
    step = F.floor(F.log2("c") * 8).cast("int")
    room, least = HEAVY, 1 << 30
    for r in sorted(tokens.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        if r.n > room:
            break
        room, least = room - r.n, r.step
    heavy = tokens.where(step >= least).toPandas()
    pairs = [(r.key, r.c) for r in counts.where("kind = 1").collect()]
    part = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(PARTS))
    mixer = train_across([trained.where(part == i) for i in range(PARTS)], pairs)

    below = n + v + 1
    key = heavy["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    log_heavy = np.log10((heavy["c"].to_numpy(np.float64)[order] + 1) / below)
    model = spark.sparkContext.broadcast((mixer, key[order], log_heavy))
    found = stash(own.mapInArrow(_score(model), _OUT), "scores")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    rest = rare.join(tokens, "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(below)))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("also"))
    return found.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
