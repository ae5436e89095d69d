"""What a text is made of: its words, the pieces of a word, sets of characters. The rules on texts are written with these."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, DIGITS, HEX = string.ascii_letters, string.digits, "0123456789abcdefABCDEF"


def made_of(text: Column, chars: str) -> Column:
    """Nothing but these characters, and something."""
    return (text != "") & (F.translate(text, chars, "") == "")


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def has_any(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "") != text


def words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def runs(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_]+"), lambda w: w != "")


def single(text: Column) -> Column:
    """One word, without white space."""
    return (text != "") & ~text.rlike(r"\s")


def starts(text: Column, *beginnings: str) -> Column:
    out = F.lit(False)
    for b in beginnings:
        out = out | text.startswith(b)
    return out


def one_of(items: Column, names: list[str] | tuple[str, ...]) -> Column:
    """Whether an array holds one of the names."""
    return F.arrays_overlap(items, F.array(*map(F.lit, names)))


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def rest(text: Column, n: int = 1) -> Column:
    """The text without its first n characters."""
    return F.substring(text, n + 1, 1 << 30)
