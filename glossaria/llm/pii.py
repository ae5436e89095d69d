"""Personal data by offset-preserving deobfuscation.

Plain identifiers are found on the text itself. Every text also goes through a chain of transducers, each of which rewrites the tape and carries for every character of the rewritten text the source span it came
from: homoglyphs and digits of other scripts to ASCII, invisible characters to nothing; runs of spelled digits to digits;
at/dot disguises to "@" and ".". Identifiers found on the tape are mapped back to source characters and added unless they
lie within a plain span of their kind: one that a plain span only overlaps is kept whole beside it.

Scale: one scan, no shuffle; a text that no transducer changes costs a search by each pattern and no tape. Addresses, in
signs or in words, are looked for from their sign outwards, so that the cost is in proportion to the text, whatever it is.

Defined cases: null text is empty text (no spans); null doc_id stays null; repeated rows give a row each; very long texts are
searched whole, and so are long runs of letters, figures or signs in them; an empty table gives no rows; other columns are kept by redact() and ignored otherwise. Spans count code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _FIGURES, _BLANKS = string.ascii_letters + string.digits + "._%+-", string.digits, " \t"
# What stands behind the sign of an address, and what stands behind its first number of an ip
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_THREE = re.compile(r"(?<=[0-9])(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def run_start(text: str, end: int, least: int, chars: str) -> int:
    """Where the run of these characters that ends before end begins, not before least; costs the run's length."""
    step = 64
    while True:
        a = max(least, end - step)
        rest = text[a:end].rstrip(chars)
        if rest or a == least:
            return a + len(rest)
        step *= 4


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each "@" outwards, so a long run of letters without one costs nothing."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = run_start(text, at, least, _LOCAL)
        host = _HOST.match(text, at + 1) if start < at else None
        least = host.end() if host else at + 1
        if host:
            yield start, least
        at = text.find("@", least)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """From the three last numbers to the first one's beginning."""
    least, m = 0, _THREE.search(text)
    while m:
        start = run_start(text, m.start(), least, _FIGURES)
        if start < m.start():
            yield start, m.end()
            least = m.end()
            m = _THREE.search(text, least)
        else:  # the number before belongs to the last match
            m = _THREE.search(text, m.start() + 1)


def _ip_ok(s: str) -> bool:
    return all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 9 <= len(_DIGIT.findall(s)) <= 15


def plain(text: str) -> list[Span]:
    """Identifiers as they stand: leftmost, non-overlapping per kind, failing matches dropped without another try."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", i, j) for i, j in _ips(text) if _ip_ok(text[i:j])]
        found += [("card", *m.span()) for m in CARD.finditer(text) if len(m[0]) >= 13 and _card_ok(m[0])]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if _phone_ok(m[0])]
    return found


# ---- transducers ------------------------------------------------------------------------------------------------

# Letters of other scripts that look like ASCII ones, as pairs
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "ԝ": "w", "х": "x", "һ": "h", "ѵ": "v", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ϲ": "c", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", " ": " ", " ": " ", " ": " ", " ": " ", "﹢": "+",
}
_INVISIBLE = "­​‌‍⁠﻿"
GLYPHS: dict[str, str] = dict(_LOOKALIKE) | {c: "" for c in _INVISIBLE}
GLYPHS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
GLYPHS |= {chr(c): n for c in range(0x1D400, 0x1D800) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
GLYPHS |= {chr(c): n for c in range(0x2460, 0x24EA) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()}
GLYPHS |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.category(chr(c)) == "Nd" and chr(c) not in GLYPHS}
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
_LATIN_GLYPHS = tuple(c for c in GLYPHS if c <= "\xff")

# Spelled digits
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGITS: dict[str, str] = {w: str(d) for line in _SPELLED for d, w in enumerate(line.split())} | {"oh": "0", "ein": "1", "zwo": "2", "une": "1"}
_PLUS, _POINT, _DASH = "plus|más|mas", "dot|point|punkt|punto", "dash|hyphen|minus"
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Least number of digits in a row, spelled or not, that counts as a run of spelled digits.
RUN = 4
_NUMBER = rf"(?:{_WORD}|[0-9]+)"
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:{_PLUS})[ \t]+)?{_NUMBER}(?:(?:[ \t]+(?:{_POINT}|{_DASH})[ \t]+|[ \t]*[,.-][ \t]*|[ \t]+){_NUMBER}){{{RUN - 1},}}(?!\w)")
_TOKEN = re.compile(rf"(?i)(?<!\w)(?:({_WORD})|({_PLUS})|({_POINT}))(?!\w)")
_AT, _DOT = "at|arroba|ät|@", "dot|punkt|punto|point|\\."
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKET_AT = re.compile(rf"(?i)(?<=[a-z0-9._%+-])[ \t]*{_OPEN}[ \t]*(?:{_AT})[ \t]*{_CLOSE}[ \t]*(?=[a-z0-9-])")
_BRACKET_DOT = re.compile(rf"(?i)(?<=[a-z0-9-])[ \t]*{_OPEN}[ \t]*(?:{_DOT})[ \t]*{_CLOSE}[ \t]*(?=[a-z0-9-])")
#: What can stand between name and host of a spelled address; what stands behind it
_AT_WORD = re.compile(r"(?i)@|(?<=[ \t])(?:at|arroba)(?=[ \t])")
_WORDY_REST = re.compile(r"(?i)[a-z0-9-]+(?P<rest>(?:(?:[ \t]+(?:dot|punkt|punto)[ \t]+|[ \t]*\.[ \t]*)[a-z0-9-]+)*(?:[ \t]+(?:dot|punkt|punto)[ \t]+|[ \t]+\.[ \t]*|\.[ \t]+|\.)[a-z]{2,24})(?![\w-])")
_WORDY_DOT = re.compile(r"(?i)[ \t]+(?:dot|punkt|punto)[ \t]+|[ \t]*\.[ \t]*")
# Character references of the two signs
_REFERENCES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "&#46;": ".", "&#x2e;": ".", "&period;": "."}
_REFERENCE = re.compile("|".join(_REFERENCES), re.I)
# Necessary parts of the bracket patterns and of _WORDY, quick to search
_BRACKETED = re.compile(rf"(?i){_OPEN}[ \t]*(?:{_AT}|{_DOT})[ \t]*{_CLOSE}")
_SPACED_DOT = re.compile(r"(?i)[ \t](?:dot|punkt|punto)[ \t]")


class Tape:
    """A rewritten text; of each character, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) of the tape by a text, for edits in order; each new character stands for all replaced ones."""
        text, start, end, at = [], [], [], 0
        for i, j, new in edits:
            text += self.text[at:i], new
            start += self.start[at:i] + [self.start[i]] * len(new)
            end += self.end[at:i] + [self.end[j - 1]] * len(new)
            at = j
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _glyphs(text: str) -> Iterator[tuple[int, int, str]]:
    if _has_glyph(text):
        yield from ((m.start(), m.end(), GLYPHS[m[0]]) for m in _GLYPH.finditer(text))


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    whole = None
    for run in _SPELLED_RUN.finditer(text):
        if len({m[0].lower() for m in _TOKEN.finditer(run[0]) if m[1]} | {*_DIGIT.findall(run[0])}) < 2:
            continue  # one word again and again is no number
        if whole is None:
            whole = {x for _, s, e in plain(text) for x in (s, e)}
        at = run.start()
        tokens = list(re.finditer(rf"(?i){_WORD}|{_PLUS}|{_POINT}|{_DASH}|[0-9]+|[^0-9\w]+", run[0]))
        for k, m in enumerate(tokens):
            i, j, word = at + m.start(), at + m.end(), m[0].lower()
            if word in DIGITS:
                yield i, j, DIGITS[word]
            elif word[0].isalpha():
                known = _TOKEN.fullmatch(word)
                yield i, j, "" if known is None else "." if known[3] else "+"
            elif not word[0].isdigit():
                # a plain identifier and the figures beside it are not one number
                if {i, j} & whole and all(t[0].isdigit() for t in tokens[k - 1 : k + 2 : 2]):
                    continue
                yield i, j, "." if word.strip() == "." else ""


def _references(text: str) -> Iterator[tuple[int, int, str]]:
    if "&" in text:
        yield from ((m.start(), m.end(), _REFERENCES[m[0].lower()]) for m in _REFERENCE.finditer(text))


def _bracket_at(text: str) -> Iterator[tuple[int, int, str]]:
    if _BRACKETED.search(text):
        yield from ((m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text))


def _bracket_dot(text: str) -> Iterator[tuple[int, int, str]]:
    if _BRACKETED.search(text):
        yield from ((m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text))


def _name(text: str, end: int, least: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The name that ends before end, in words joined by spelled dots: its start and those dots with their blanks."""
    start, parts, dots = end, [], []
    while (at := run_start(text, start, least, _LOCAL)) < start:
        parts.append((at, start))
        blank = run_start(text, at, least, _BLANKS)
        word = run_start(text, blank, least, _LOCAL) if blank < at else blank
        before = run_start(text, word, least, _BLANKS) if text[word:blank].lower() in ("dot", "punkt", "punto") else word
        if before == word or run_start(text, before, least, _LOCAL) == before:
            break
        dots.append((before, at))
        start = before
    # the name starts at a word's beginning: the outermost part that has one
    for k in range(len(parts) - 1, -1, -1):
        i, j = parts[k]
        while i < j and i and (text[i - 1] == "." or text[i - 1] == "_" or text[i - 1].isalnum()):
            i += 1
        if i < j:
            return i, dots[:k][::-1]
    return None


def _wordy(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" not in text and not _SPACED_DOT.search(text):
        return
    least, sign = 0, _AT_WORD.search(text)
    while sign:
        a = run_start(text, sign.start(), least, _BLANKS)
        b = sign.end()
        while b < len(text) and text[b] in _BLANKS:
            b += 1
        name = _name(text, a, least)
        m = _WORDY_REST.match(text, b) if name else None
        if m is None:
            sign = _AT_WORD.search(text, sign.end())
            continue
        least = m.end()
        spelled_dot = re.search(r"(?i)[ \t](?:dot|punkt|punto)[ \t]", m["rest"])
        # a bare "at" needs a spelled dot beside it
        if (b - a > len(sign[0]) or re.search(r"[ \t]", m["rest"])) and (sign[0] == "@" or spelled_dot):
            yield from ((i, j, ".") for i, j in name[1])
            yield a, b, "@"
            for d in _WORDY_DOT.finditer(m["rest"]):
                # a spaced full stop behind a plain address ends its sentence
                if b - a == 1 and d[0] != "." and d[0].strip() == "." and "." in m["rest"][: d.start()]:
                    break
                yield m.start("rest") + d.start(), m.start("rest") + d.end(), "."
        sign = _AT_WORD.search(text, least)


def _has_glyph(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # most texts of Western languages end here, fast
    except UnicodeEncodeError:
        return _GLYPH.search(text) is not None
    return any(c in text for c in _LATIN_GLYPHS)


_TRANSDUCERS = (_glyphs, _spelled, _references, _bracket_at, _bracket_dot, _wordy)


def disguised(text: str) -> Tape | None:
    """The tape of a text that a transducer changes, else None; every transducer is asked about every text."""
    tape = None
    for transducer in _TRANSDUCERS:
        if edits := list(transducer(tape.text if tape else text)):
            tape = tape or Tape(text)
            tape.rewrite(edits)
    return tape


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the tape shows: those within no plain span of their kind."""
    tape = disguised(text)
    if tape is None or tape.text == text:
        return []
    known: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
    for kind, s, e in sorted(base, key=lambda x: x[1]):
        known[kind][0].append(s)
        known[kind][1].append(e)
    out: list[Span] = []
    for kind, i, j in plain(tape.text):
        s, e = tape.start[i], tape.end[j - 1]
        starts, ends = known[kind]
        # plain spans of a kind don't overlap: only the last that starts no later can hold this one
        at = bisect_right(starts, s) - 1
        if at < 0 or ends[at] < e:
            out.append((kind, s, e))
    return out


def written(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
    for rows, _, _ in text_slices(batches):
        out = []
        for doc_id, text in zip(rows.column(rows.schema.get_field_index("doc_id")).to_pylist(), rows.column(rows.schema.get_field_index("text")).fill_null("").to_pylist(), strict=True):
            base = plain(text)
            more = added(text, base)
            kinds = [k for k, _, _ in base]
            out.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def found(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, plain spans counted by kind, base_sha256, spans (all of them), n_added."""
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_find, SCHEMA)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one, which the first and longest names."""
    base = plain(text)
    spans = sorted(base + added(text, base), key=lambda x: (x[1], -x[2]))
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += text[at:s], f"[{k.upper()}]"
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced; nulls stay null."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(x: pd.Series) -> pd.Series:
        return x.map(lambda t: redacted(t) if t is not None else None)

    return docs.withColumn(text, clean(text))
