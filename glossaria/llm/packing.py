"""Cost-balanced packing of tokenised documents into sequences of at most LENGTH tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n^2 (attention stays inside a piece). Documents of a window, in
descending length, go to the lowest-cost sequence that has room for them; where none has, the document is cut and its first
part fills the lowest-cost sequence with any room. A window of T tokens makes T // LENGTH full sequences and cuts what remains
into sequences at powers of two, so no sequence needs padding.

Scale: one scan, no shuffle. Each task packs its own rows in windows of WINDOW_TOKENS tokens, which bounds its memory; a
lost task is done again from its input split with the same result. Sequence ids carry the task's number in the upper bits.

Defined cases: null text is empty text (the end id alone); a null doc_id is returned as null; repeated rows are packed
each; ties go by doc_id, then arrival; very long texts are cut over many sequences; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import prepare, text_slices

LENGTH, END = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
WINDOW_TOKENS = 1 << 22
NONE = (float("inf"), -1)
#: Words kept with their ids (up to as many again from before), and the longest odd word that is kept.
CACHED, CACHED_CHARS = 300_000, 64
LOWERED = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: What the vocabulary's special tokens begin with.
SPECIAL = "<|"
#: All ASCII punctuation; none of it counts as a letter or digit.
MARKS = string.punctuation
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, word by word.

    The vocabulary's pre-tokenizer never joins over a blank or line break, so those cut a text safely; each distinct word
    is encoded once while it stays in the cache. The pre-tokenizer also parts letters from marks behind them, so words of
    letters are encoded without their marks, in lower case, many at a time: each ends with one word-end token, which cuts
    the ids again (else they are encoded one by one).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.batch(texts, add_special_tokens=False)]

    def letters(self, found: list[str]) -> list[bytes]:
        """Ids of words of letters only."""
        out = []
        for i in range(0, len(found), 512):
            some = found[i : i + 512]
            ids = np.array(self.batch([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                out += self.each(some)
                continue
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        # A-Z in lower case at once, as the vocabulary has it, but where that could make a special token
        low = [t if SPECIAL in t else t.encode(errors="surrogatepass").translate(LOWERED).decode(errors="surrogatepass") for t in texts]
        cut = [t.replace("\n", " ").split(" ") for t in low]
        if len(self.known) > CACHED:
            self.known, self.old = {"": b""}, self.known
        known, old = self.known, self.old
        new = set().union(*cut).difference(known) if cut else set()
        again = old.keys() & new
        known.update({word: old[word] for word in again})
        new -= again
        plain = [word for word in new if word.isalpha() and (word.isascii() or word.lower().isalpha())]
        known.update(zip(plain, self.letters(plain), strict=True))
        parted, odd = [], []
        for word in new.difference(plain):
            stem = word.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                parted.append((word, stem, word[len(stem) :]))
            else:
                odd.append(word)
        for todo, encode in (({s for _, s, _ in parted}, self.letters), ({t for _, _, t in parted}, self.each)):
            todo = [x for x in todo if x not in known]
            known.update(zip(todo, encode(todo), strict=True))
        known.update({word: known[stem] + known[tail] for word, stem, tail in parted})
        once = {}
        for word, ids in zip(odd, self.each(odd), strict=True):
            (known if len(word) <= CACHED_CHARS else once)[word] = ids
        if once:
            known = known | once
        found = known.__getitem__
        return [b"".join(map(found, words)) for words in cut]


@lru_cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


class Rooms:
    """The open sequences by the room they have: the lowest-cost one with enough of it, in a tree of minima over rooms."""

    def __init__(self, sequences: int):
        self.heaps: list[list] = [[] for _ in range(LENGTH + 1)]
        self.heaps[LENGTH] = [(0.0, s) for s in range(sequences)]
        self.size = 1 << LENGTH.bit_length()
        self.tree = [NONE] * (2 * self.size)
        self._settle(LENGTH)

    def _settle(self, room: int) -> None:
        i = self.size + room
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else NONE
        while i > 1:
            i >>= 1
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a < b else b

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._settle(room)

    def take(self, least: int, used: list[int]) -> tuple[float, int] | None:
        """The lowest-cost sequence with at least so much room, taken out."""
        i, best = self.size + least, NONE
        while i > 1:  # the leaf, and all that lies to the right of its way up
            x = self.tree[i] if i == self.size + least else NONE
            best = x if x < best else best
            if not i & 1 and self.tree[i + 1] < best:
                best = self.tree[i + 1]
            i >>= 1
        if best is NONE:
            return None
        room = LENGTH - used[best[1]]
        heapq.heappop(self.heaps[room])
        self._settle(room)
        return best


def pack(lengths: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset, sequence length) of documents with these lengths, descending."""
    total = sum(lengths)
    full = total // LENGTH
    rest = total - full * LENGTH
    size = [LENGTH] * full + [1 << b for b in range(LENGTH.bit_length() - 1, -1, -1) if rest >> b & 1]
    used = [0] * len(size)
    rooms, tail, out = Rooms(full), full, []
    for doc, n in enumerate(lengths):
        start = 0
        while start < n:
            left = n - start
            cost, s = rooms.take(min(left, LENGTH), used) or rooms.take(1, used) or (0.0, tail)
            part = min(left, size[s] - used[s])
            out.append((doc, start, part, s, used[s], size[s]))
            start += part
            used[s] += part
            if s >= full:
                tail += used[s] == size[s]
            elif used[s] < LENGTH:
                rooms.put(cost + LINEAR * part + QUADRATIC * part * part, s, LENGTH - used[s])
    return out


def packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path)
        end = np.array([END], "<u4").tobytes()
        task, sequences = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            order = sorted(range(len(held)), key=lambda i: (-len(held[i][1]), held[i][0] is None, held[i][0] or 0, i))
            pieces = pack([len(held[i][1]) // 4 for i in order])
            rows = []
            for doc, start, n, s, offset, size in pieces:
                doc_id, ids = held[order[doc]]
                rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, task + sequences + s, offset, size))
            sequences += 1 + max(p[3] for p in pieces)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for rows, _, _ in text_slices(batches):
            texts = rows.column(rows.schema.get_field_index("text")).fill_null("").to_pylist()
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, found in zip(ids, encode(texts), strict=True):
                held.append((doc_id, found + end))
                tokens += len(found) // 4 + 1
            if tokens >= WINDOW_TOKENS:
                yield flush()
                held, tokens = [], 0
        if held:
            yield flush()

    return run


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(packer(tokenizer or default_tokenizer()), SCHEMA)
