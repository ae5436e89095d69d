"""SentencePiece merge-type encoding by backtracking, and decoding.

The normalised text is cut where no piece of the vocabulary can reach across (before a run of word marks, around
characters that are in no piece). In each chunk an Aho-Corasick automaton gives the longest piece at every position; the
encoder appends the longest piece whose neighbour check passes, else tries the next shorter prefix piece, else marks the
position as failed in a bitfield and steps back. Two neighbours are compatible if merging the characters of both again by
the merge order ends in these two pieces. Decoding is the library's.

Scale: one scan, no shuffle; ids of distinct chunks and answers of the neighbour check are kept in bounded tables per
worker.

Defined cases: null text is empty text (begin and end id only); null doc_id stays null; repeated rows give a row each;
very long texts and chunks are encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, text_slices

MARK = "▁"
CACHED, CACHED_CHARS, CACHED_PAIRS = 300_000, 64, 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """Ids of one text, as little-endian unsigned 32-bit bytes without begin and end."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if not odd[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.bytes_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.length = [len(p) for p in self.piece]
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p in self.piece]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.alphabet = set("".join(self.id))
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if "\n" not in self.alphabet else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        #: Characters that stand side by side in some piece; between others no merge can reach.
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def merged(self, text: str) -> list[str]:
        """Merge characters in the order of the pieces' scores, leftmost first: the definition of the encoding."""
        s = list(text)
        score = self.score
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                x = score.get(s[k] + s[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            found = self.pairs[key] = self.merged(x + y) == [x, y]
        return found

    def backtrack(self, text: str) -> list[int] | None:
        """Ids of a chunk all of whose characters are pieces."""
        n = len(text)
        longest = [-1] * (n + 1)
        best = [0] * n
        for end, (i, size) in self.automaton.iter(text):
            start = end - size + 1
            if size > best[start]:
                best[start], longest[start] = size, i
        if n and best[0] == n:  # a piece of its own
            text_ids = [longest[0]]
            if self.merged(text) == [text]:
                return text_ids
        length, shorter, compatible = self.length, self.shorter, self.compatible
        failed = bytearray((n >> 3) + 1)  # a bit for each position, set once no encoding leads on from it
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at]
            else:
                if not ids:
                    return None
                failed[at >> 3] |= 1 << (at & 7)
                token = ids.pop()
                at -= length[token]
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk, from those of its parts between which no piece reaches across."""
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if not cuts:
            return self.part(text)
        return b"".join([self.kept(text[i:j], self.part) for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)])

    def part(self, text: str) -> bytes:
        """Ids of a part; a character in no piece is a part of its own."""
        if text not in self.alphabet and len(text) == 1:
            return np.array(self.ids_of(text), "<u4").tobytes()
        ids = self.backtrack(text)
        if ids is None:
            ids = [k for p in self.merged(text) for k in self.ids_of(p)]
        return np.array(ids, "<u4").tobytes()

    def kept(self, text: str, encode) -> bytes:
        """From the table of known texts (two generations of at most CACHED each), or encoded and kept there."""
        found = self.known.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = encode(text)
            if len(text) <= CACHED_CHARS:
                if len(self.known) > CACHED:
                    self.known, self.old = {}, self.known
                self.known[text] = found
        return found

    def ids_of(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.bytes_id[b] for b in piece.encode()]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = self.cut.findall(MARK + text.replace(" ", MARK))
        known = self.known
        new = {c: self.kept(c, self.chunk) for c in set(chunks).difference(known)}
        return b"".join([known.get(c) or new[c] for c in chunks]) if new else b"".join(map(known.__getitem__, chunks))


@lru_cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for rows, _, _ in text_slices(batches):
            n, ids_sha, text_sha = [], [], []
            for text in rows.column(rows.schema.get_field_index("text")).fill_null("").to_pylist():
                ids = encode.begin + encode(text) + encode.end
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                text_sha.append(sha(encode.sp.decode(np.frombuffer(ids, "<u4").tolist()).encode()))
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_run(model or default_model()), SCHEMA)
