"""Words and letters of a text: the units in which repetition and leaks are counted."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

APOSTROPHES = "'’ʼ＇"
SPACELESS = ((0x0E01, 0x0E5B), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x2FA1F))
TOP = 0x30000


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, mark or digit; is it of a script written without spaces."""
    unit = np.fromiter((unicodedata.category(chr(cp))[0] in "LMN" for cp in range(TOP)), bool, TOP)
    spaceless = np.zeros(TOP, bool)
    for lo, hi in SPACELESS:
        spaceless[lo : hi + 1] = True
    return unit, spaceless & unit


@cache
def word_finder():
    # Marks above 0x10000 are left out: they would be compared one by one for every character.
    marks = "".join(re.escape(chr(cp)) for cp in range(0x300, 0x10000) if unicodedata.category(chr(cp))[0] == "M")
    part = f"[\\w{marks}]+"
    return re.compile(f"{part}(?:[{APOSTROPHES}]{part})*").findall


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str) -> np.ndarray:
    """The code points of letters, marks and digits, in lower case."""
    return letters_of_lower(text.lower()).astype(np.uint32)


def letters_of_lower(text: str) -> np.ndarray:
    codes = np.minimum(code_points(text), TOP - 1)
    return codes[tables()[0][codes]].astype(np.uint64)


def spaceless_share(text: str) -> float:
    """The part of the letters that belongs to a script without spaces."""
    if text.isascii():
        return 0.0
    codes = np.minimum(code_points(text), TOP - 1)
    unit, spaceless = tables()
    n = int(unit[codes].sum())
    return float(spaceless[codes].sum()) / n if n else 0.0


def words(text: str) -> list[str]:
    """Lower-case words: runs of letters, marks and digits; an apostrophe between them belongs to the word."""
    return words_of_lower(text.lower())


def words_of_lower(text: str) -> list[str]:
    if text.isascii():
        return ASCII_WORDS(text)
    return word_finder()(text)


def hashes(items: list[str]) -> np.ndarray:
    """64-bit hashes, equal within a process only."""
    return np.fromiter(map(hash, items), np.int64, len(items)).view(np.uint64)


ASCII_WORDS = re.compile(r"\w+(?:'\w+)*", re.ASCII).findall
ODD = np.uint64(0x9E3779B97F4A7C15)


def windows(units: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` units."""
    n = len(units) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = units.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(1)) * ODD
        x ^= x >> np.uint64(29)
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + x[k : k + n]
    return out
