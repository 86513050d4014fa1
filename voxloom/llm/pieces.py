"""Problem 10: splitting oversized items at natural boundaries, by agglomerative merging.

A text is tokenized once; a cut can only lie between tokens that begin a character. Atomic segments are sentences, where a
sentence is too long its clauses, then words, then characters. Adjacent segments wait in a heap and the pair at the weakest
boundary (then the smallest pair, then the first) is merged while the pair, with the overlap before it, fits the limit. A piece
is a segment with the overlap taken from the text before it.

Sizes are those of a part tokenized on its own. The tokenizer never looks across certain places ("clean" ones, see ``Sized``),
so between them the tokens of the part are those of the whole text, and only what sticks out on either side is encoded again.

Defined results: null and empty texts, and texts within the limit, give no pieces; the pieces of a text cover it without gaps;
none is above the limit; consecutive pieces share at least overlap_tokens tokens and only so many more as complete a
character. An overlap that is not below its limit, and a limit that cannot hold the overlap and one more character of a text,
raise an error: no text is dropped and no limit or overlap is changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxloom.functions import frames
from voxloom.llm import units
from voxloom.llm.tokens import TOKENIZER, byte_lengths, encoding
from voxloom.plans.shared import spread_out

# Strength of a boundary, from a place inside a word to an empty line.
INSIDE, SPACELESS, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
KINDS = ("inside", "letter", "space", "clause", "sentence", "line", "paragraph")
LIMIT_BLOCK = 1000
BLANK, SENTENCE_MARK, CLAUSE_MARK, CLOSER, UNSPACED, NEWLINE = (1 << k for k in range(6))
LETTER, NUMBER, WHITE, OTHER = range(4)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: what it means for a boundary (bits), and its class in the tokenizer's pattern."""
    import unicodedata

    role = np.zeros(units.TOP, np.uint8)
    for bit, chars in ((BLANK, " \t\n\r　\xa0"), (SENTENCE_MARK, ".!?…。！？।"), (CLAUSE_MARK, ",;:、，；："), (CLOSER, "\"'”’»」』)]）】"), (NEWLINE, "\n\r")):
        role[[ord(c) for c in chars]] |= bit
    role[units.tables()[1]] |= UNSPACED
    first = np.array([unicodedata.category(chr(cp))[0] for cp in range(units.TOP)])
    kind = np.full(units.TOP, OTHER, np.uint8)
    kind[first == "L"], kind[first == "N"] = LETTER, NUMBER
    kind[[cp for cp in range(0x3001) if chr(cp).isspace() and not 0x1C <= cp <= 0x1F]] = WHITE
    return role, kind


def token_starts(text: str, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """For each token and the end, the byte and the code point where it begins; -1 for code points inside a character."""
    ids = encoding(path).encode_ordinary(text)
    ends = np.concatenate(([0], np.cumsum(byte_lengths(path)[ids]))) if ids else np.zeros(1, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    first = (raw & 0xC0) != 0x80
    place = np.concatenate((np.where(first, np.cumsum(first) - 1, -1), [len(text)]))
    return ends, place[ends]


class Sized:
    """A text with its tokens, the strength of every place between them, and exact sizes of its parts.

    A place is clean if the tokenizer's pattern ends a match there whatever stands on the other side: between a letter, a number
    and another sign (unless an apostrophe comes before), before white space, and after a single white-space character other
    than a blank.
    """

    def __init__(self, text: str, path: str = TOKENIZER):
        self.text, self.path = text, path
        self.ends, self.starts = token_starts(text, path)
        self.n = len(self.ends) - 1
        self.at: list[int] | None = None  # set by prepare()

    def prepare(self) -> Sized:
        role_of, kind_of = _tables()
        codes = np.minimum(units.code_points(self.text), units.TOP - 1)
        role, kind = role_of[codes], kind_of[codes]
        starts, n = self.starts, self.n
        ok = np.flatnonzero((starts > 0) & (starts < len(codes)))
        p = starts[ok]
        before, after, before2 = role[p - 1], role[p], role[np.maximum(p - 2, 0)]
        blank = (after & BLANK) > 0
        level = np.where(blank, SPACE, np.where((before & after & UNSPACED) > 0, SPACELESS, INSIDE))
        closed = (before & CLOSER) > 0
        mark = np.where(closed, before2, before)
        free = blank | (np.where(closed, codes[np.maximum(p - 2, 0)], codes[p - 1]) > 0x2FFF)
        level = np.where(((before & CLAUSE_MARK) > 0) & free, CLAUSE, level)
        level = np.where(((mark & SENTENCE_MARK) > 0) & free, SENTENCE, level)
        newline = (codes[p - 1] == 10) & ((after & NEWLINE) == 0)
        double = newline & ((before2 & NEWLINE) > 0) & ((codes[np.maximum(p - 2, 0)] == 10) | (codes[np.maximum(p - 3, 0)] == 10))
        level = np.where(newline, LINE, level)
        strength = np.full(n + 1, -1, np.int8)
        strength[ok] = np.where(double, PARAGRAPH, level)
        a, b = kind[p - 1], kind[p]
        single = (a == WHITE) & (codes[p - 1] != 32) & (b != WHITE) & ((p < 2) | (kind[np.maximum(p - 2, 0)] != WHITE))
        clean = np.zeros(n + 1, bool)
        clean[ok] = ((a != WHITE) & (b == WHITE)) | single | ((a != b) & (a != WHITE) & (b != WHITE) & (codes[p - 1] != 39))
        clean[[0, n]] = True
        at = np.arange(n + 1)
        self.last_clean = np.maximum.accumulate(np.where(clean, at, 0)).tolist()
        self.next_clean = np.minimum.accumulate(np.where(clean, at, n)[::-1])[::-1].tolist()
        self.allowed = np.flatnonzero(strength >= 0)
        placed = np.zeros(n + 1, np.int64)
        placed[self.allowed] = self.allowed
        self.floor = np.maximum.accumulate(placed).tolist()  # the last place to cut at or before each token
        self.ceiling = np.minimum.accumulate(np.where(strength >= 0, at, n)[::-1])[::-1].tolist()  # the first one at or after it
        self.strength, self.levels = strength, strength.tolist()
        self.at, self.byte = starts.tolist(), self.ends.tolist()
        self.encode = encoding(self.path).encode_ordinary
        return self

    def count(self, a: int, b: int) -> int:
        """The tokens of the text between two places, tokenized on its own."""
        p, q = self.next_clean[a], self.last_clean[b]
        if p > q:
            return self.encoded(a, b)
        size = q - p
        if a < p:
            size += self.encoded(a, p)
        if q < b:
            size += self.encoded(q, b)
        return size

    def encoded(self, a: int, b: int) -> int:
        part = self.text[self.at[a] : self.at[b]]
        size = _known.get((self.path, part))
        if size is None:
            size = len(self.encode(part))
            if len(part) <= 16:
                if len(_known) > 200_000:
                    _known.clear()
                _known[self.path, part] = size
        return size


_known: dict[tuple[str, str], int] = {}


class Splitter:
    """One text under one limit."""

    def __init__(self, sized: Sized, limit: int, overlap: int):
        self.s, self.limit, self.overlap = sized, limit, overlap
        self.leads: dict[int, int] = {0: 0}
        allowed = sized.allowed
        if overlap:  # the first piece must hold the overlap of the second
            k = int(np.searchsorted(allowed, overlap))
            while k > 0 and sized.count(0, int(allowed[k - 1])) >= overlap:
                k -= 1
            while k < len(allowed) and sized.count(0, int(allowed[k])) < overlap:
                k += 1
            allowed = allowed[k:]
        self.places = allowed

    def lead(self, begin: int) -> int:
        """Where a piece whose own part begins here starts: the last place that leaves the overlap."""
        if not self.overlap:
            return begin
        found = self.leads.get(begin)
        if found is None:
            s, overlap = self.s, self.overlap
            at = s.floor[max(0, begin - overlap)]
            while at > 0 and s.count(at, begin) < overlap:
                at = s.floor[at - 1]
            while (nearer := s.ceiling[at + 1]) < begin and s.count(nearer, begin) >= overlap:
                at = nearer
            found = self.leads[begin] = at
        return found

    def fits(self, begin: int, end: int) -> bool:
        lead, s = self.lead(begin) if self.overlap else begin, self.s
        p, q = s.next_clean[lead], s.last_clean[end]
        if q - p > self.limit:
            return False
        loose = s.byte[end] - s.byte[lead] if p > q else q - p + s.byte[p] - s.byte[lead] + s.byte[end] - s.byte[q]
        return loose <= self.limit or s.count(lead, end) <= self.limit  # a token has a byte at least

    def atoms(self, lo: int, hi: int, level: int = SENTENCE) -> list[int]:
        """Places between atomic segments of tokens lo..hi: cut at this level and above, finer where a segment does not fit."""
        inside = self.places[np.searchsorted(self.places, lo + 1) : np.searchsorted(self.places, hi)]
        cuts = inside[self.s.strength[inside] >= level].tolist()
        out = []
        for a, b in zip([lo, *cuts], [*cuts, hi]):
            if a > lo:
                out.append(a)
            if not self.fits(a, b):
                if level == INSIDE:
                    raise ValueError(f"a limit of {self.limit} tokens cannot hold {self.overlap} tokens of overlap and the text at character {self.s.at[a]}")
                out.extend(self.atoms(a, b, level - 1))
        return out

    def cuts(self) -> list[int]:
        """Where segments begin, after the merges."""
        n, levels = self.s.n, self.s.levels
        inner = self.atoms(0, n)
        begin, end = [0, *inner], [*inner, n]
        count = len(begin)
        following, before = [*range(1, count), -1], list(range(-1, count - 1))
        # An entry is one number, level, size and left segment after one another; it is stale when the size is another by now.
        bits = (n + 1).bit_length()
        mask, fits, push, pop = (1 << bits) - 1, self.fits, heapq.heappush, heapq.heappop
        heap = [(levels[begin[i + 1]] << bits | end[i + 1] - begin[i]) << bits | i for i in range(count - 1)]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry & mask
            j = following[i]
            if j < 0 or end[j] - begin[i] != entry >> bits & mask or not fits(begin[i], end[j]):
                continue
            end[i], following[i] = end[j], following[j]
            following[j] = -1  # it is part of i now
            k, h = following[i], before[i]
            if k >= 0:
                before[k] = i
                push(heap, (levels[begin[k]] << bits | end[k] - begin[i]) << bits | i)
            if h >= 0:
                push(heap, (levels[begin[i]] << bits | end[i] - begin[h]) << bits | h)
            begin[j] = -1
        return [b for b in begin if b >= 0]


def checked(limit: int, overlap: int) -> tuple[int, int]:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"no pieces of {limit} tokens can share {overlap}")
    return limit, overlap


def pieces(text: str | None, limit: int, overlap: int, path: str = TOKENIZER, known: Sized | None = None) -> list[tuple[int, int, int, int, str]]:
    """[(start, end, tokens, shared tokens, kind of the cut before)] of a text above the limit, positions in code points."""
    checked(limit, overlap)
    if not text:
        return []
    s = known or Sized(text, path)
    if s.n <= limit:
        return []
    if s.at is None:
        s.prepare()
    work = Splitter(s, limit, overlap)
    cuts = work.cuts()
    out = []
    for begin, stop in zip(cuts, [*cuts[1:], s.n]):
        lead = work.lead(begin)
        out.append((s.at[lead], s.at[stop], s.count(lead, stop), s.count(lead, begin) if lead < begin else 0, KINDS[s.levels[begin]] if begin else "start"))
    return out


def split_oversized(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, limit_name, piece_no, start_pos, end_pos, tokens, shared_tokens, cut, text) for every document above a limit.

    A document is one row and is split where it lies; nothing is shuffled. A document id that comes twice is split twice.
    Limits are a table of settings, read on the driver and sent out in blocks.
    """
    names = ["doc_id", "limit_name", "piece_no", "start_pos", "end_pos", "tokens", "shared_tokens", "cut", "text"]
    stated = [(r["limit_name"], *checked(r["max_tokens"], r["overlap_tokens"] or 0)) for r in limits.where("max_tokens is not null").toLocalIterator()]
    rows = spread_out(documents.select("doc_id", "text").where("text <> ''"), "doc_id")
    schema = "doc_id long, limit_name string, piece_no int, start_pos int, end_pos int, tokens int, shared_tokens int, cut string, text string"
    out = None
    for block in batched(stated or [("", 1 << 62, 0)], LIMIT_BLOCK):
        least = min(most for _, most, _ in block)

        def run(batches: Iterator[pd.DataFrame], block=block, least=least) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made, size = [], 0
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    if 4 * len(text) <= least:  # a token has a byte at least
                        continue
                    known = Sized(text, tokenizer)
                    for name, most, overlap in block:
                        for k, (a, b, n, shared, cut) in enumerate(pieces(text, most, overlap, tokenizer, known)):
                            made.append((doc, name, k, a, b, n, shared, cut, text[a:b]))
                            size += b - a
                    if size > 4_000_000:
                        yield frames.frame(names, made)
                        made, size = [], 0
                yield frames.frame(names, made)

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
