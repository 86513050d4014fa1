"""One consistent form for text that only looks the same.

A longest-match transducer is compiled from a rule table (width and compatibility forms of letters, invisible characters,
kinds of space, shapes of apostrophe, composed and decomposed accents, look-alike letters of other scripts) and run once
over the grapheme clusters of a text. The table is checked for conflicts when it is compiled: a source has one target, and
every target is a fixed point.

Defined results: null stays null, "" stays "", a text of invisible characters becomes "". Case, accents, punctuation,
digits and the number of spaces are kept; line breaks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (and two rare Latin shapes) drawn like a Latin letter.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іıι", "j": "јϳ", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Լ",
    "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ",
    "Y": "УΥҮ", "Z": "Ζ",
}
# Left out: п and г, which resemble n and r only in italics.
APOSTROPHES = "’‘‛ʼʻʽʹ′＇`´ꞌ"
LONGEST_KNOWN = 32
# Invisible although not of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"


def _is_invisible(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def _letters_only(text: str) -> bool:
    return bool(text) and all(unicodedata.category(c)[0] in "LM" for c in text)


def _assigned() -> range:
    return range(0x20, 0x30000)


def rules(look_alikes: bool = True) -> dict[str, str]:
    """Source sequence -> target sequence, for every source whose target differs from it."""
    alike = {src: latin for latin, sources in LOOK_ALIKES.items() for src in sources} if look_alikes else {}
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"conflicting targets for {source!r}")

    for cp in _assigned():
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xE000 or 0x20000 <= cp < 0x2F800:
            continue  # ideographs, Hangul syllables and surrogates have no rule
        ch = chr(cp)
        if _is_invisible(ch):
            put(ch, "")
        elif unicodedata.category(ch) == "Zs" or ch == "\t":
            if ch != " ":
                put(ch, " ")
        elif ch in APOSTROPHES:
            put(ch, "'")
        else:
            how = unicodedata.decomposition(ch)
            flat = unicodedata.normalize("NFKD", ch) if how.startswith(("<wide>", "<narrow>")) else unicodedata.normalize("NFD", ch)
            if how.startswith("<") and _letters_only(unicodedata.normalize("NFKC", ch)):
                flat = unicodedata.normalize("NFKD", ch)
            if ch in alike:
                flat = ch  # drawn like a letter although its compatibility form is another one
            mapped = "".join("'" if c in APOSTROPHES else alike.get(c, c) for c in flat)
            target = unicodedata.normalize("NFC", mapped)
            if target != ch:
                put(ch, target)
            if how and not how.startswith("<") and len(flat) == 2 and len(target) == 1:
                put(flat, target)
    return table


class Transducer:
    """Longest-match rewriting of one grapheme cluster at a time; results of clusters and words are kept in bounded memos."""

    def __init__(self, table: dict[str, str], memo: int = 200_000):
        self.root: dict = {}
        for source, target in table.items():
            node = self.root
            for ch in source:
                node = node.setdefault(ch, {})
            node[""] = target
        # Only code points below 0x10000 and two ranges above: a class with many single code points above is searched one by
        # one for every character. Other marks there begin a cluster of their own.
        extenders = [chr(cp) for cp in range(0x20, 0x10000) if unicodedata.category(chr(cp))[0] == "M" or _is_invisible(chr(cp))]
        extenders += [chr(cp) for cp in range(0x1160, 0x1200)] + ["ﾞ", "ﾟ"]
        inside = "".join(map(re.escape, extenders)) + "\U000E0000-\U000E007F\U000E0100-\U000E01EF"
        self.clusters = re.compile(f"[^{inside}][{inside}]*|[{inside}]+").findall
        self.changed_ascii = {ord(s) for s in table if len(s) == 1 and s.isascii()}
        self.touched = re.compile("[" + "".join(map(re.escape, sorted(s for s in table if s.isascii() and len(s) == 1))) + "]").search if self.changed_ascii else (lambda _: None)
        self.memo: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.size = memo
        for source, target in table.items():
            if self.cluster(target) != target:
                raise ValueError(f"the target of {source!r} is not a fixed point")

    def cluster(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, best, end = self.root, None, i
            for j in range(i, len(text)):
                node = node.get(text[j])
                if node is None:
                    break
                if "" in node:
                    best, end = node[""], j + 1
            if best is None:
                best, end = text[i], i + 1
            out.append(best)
            i = end
        joined = "".join(out)
        return joined if joined.isascii() else unicodedata.normalize("NFC", joined)

    def __call__(self, text: str | None) -> str | None:
        if text is None or (text.isascii() and not self.touched(text)):
            return text
        # No rule begins with a blank or spans one, so words are rewritten apart, each once while it is remembered.
        return " ".join(map(self.word, text.split(" ")))

    def word(self, text: str) -> str:
        known = self.words.get(text)
        if known is None:
            known = unicodedata.normalize("NFC", "".join(map(self.part, self.clusters(text))))  # joins what the clusters leave apart: marks above 0x10000
            if len(text) <= LONGEST_KNOWN:
                if len(self.words) >= self.size:
                    self.words.clear()
                self.words[text] = known
        return known

    def part(self, text: str) -> str:
        done = self.memo.get(text)
        if done is None:
            if len(self.memo) >= self.size:
                self.memo.clear()
            done = self.memo[text] = self.cluster(text)
        return done


@cache
def transducer(look_alikes: bool = True) -> Transducer:
    return Transducer(rules(look_alikes))


@F.pandas_udf(T.StringType())
def _seen(texts: pd.Series) -> pd.Series:
    run = transducer(True)
    return pd.Series([run(t) if isinstance(t, str) else None for t in texts], dtype=object)


def as_seen(text: Column | str) -> Column:
    """The text as a reader sees it; equal for texts that look the same."""
    return _seen(text)
