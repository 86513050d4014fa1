"""Problem 8: passages of evaluation items inside corpus documents.

Items and documents are brought to one form and cut into overlapping windows of the length that counts as a leak. Every
window gets a 64-bit SimHash over its five-unit shingles. The items' fingerprints go into a multi-index: with radius r the
64 bits are cut into r + 1 blocks, and two fingerprints within r bits agree in one block at least, so every such pair is
found. Candidates are verified by the exact similarity of their shingles, weighted by how few items have a shingle, and by
the longest run of equal units.

Units are words, or letters where the item is written without spaces. Equal windows have equal fingerprints, so a shared run
of a window's length is never missed. The documents are scanned once and nothing of them is shuffled but the hits. The item
set is a stated query set: it is sent to the executors in blocks of bounded size.

Defined results: null and short texts have no windows and give no row; a document delivered twice gives one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import frames
from voxloom.llm import units
from voxloom.llm.canon import LOOK_ALIKES, transducer
from voxloom.plans.shared import spread_out

SHINGLE = 5
RADIUS = 3
SIMILARITY = 0.8
WORDS = 20
LETTERS = 40
ITEM_BLOCK = 20_000
SLICE = 40_000
MOST_PAIRS = 4_000_000
HITS = "doc_id long, item_id long, similarity double, run long, windows long, unit string"
NOTHING = np.zeros(0, np.uint64)

# Lower-case letters whose capital is drawn like a Latin capital although they themselves are not.
_lower = {c for latin, src in LOOK_ALIKES.items() if latin.islower() for c in src}
FOLD = {ord(c.lower()): latin.lower() for latin, src in LOOK_ALIKES.items() if latin.isupper() for c in src if c.lower() not in _lower and c.lower() != c}


class _Plain(dict):
    """The seen form of a word without case, remembered."""

    def __missing__(self, word: str) -> str:
        done = transducer(True).word(word).lower().translate(FOLD) if not word.isascii() else word.lower()
        if len(word) <= 32:
            if len(self) > 300_000:
                self.clear()
            self[word] = done
        return done


class _Ids(dict):
    """Hashes of words without their apostrophes, equal in all processes."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        done = self[word] = xxhash.xxh3_64_intdigest(word.replace("'", ""))
        return done


_plain, _ids = _Plain(), _Ids()


def plain(text: str) -> str:
    """The seen form without case."""
    return text.lower() if text.isascii() else " ".join(map(_plain.__getitem__, text.split(" ")))


def _word_ids(text: str) -> np.ndarray:
    found = units.words_of_lower(text)
    return np.fromiter(map(_ids.__getitem__, found), np.uint64, len(found))


def fingerprints(shingles: np.ndarray, per_window: int) -> np.ndarray:
    """The SimHash of every run of ``per_window`` shingles."""
    n = len(shingles) - per_window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):  # spread the bits: votes need independent ones
        x = shingles ^ (shingles >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros((len(x) + 1, 64), np.uint8 if per_window < 128 else np.int32)  # small differences survive the wrapping around
    np.cumsum(bits, axis=0, dtype=votes.dtype, out=votes[1:])
    ones = votes[per_window:] - votes[:-per_window]
    return np.packbits(ones * 2 > per_window, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


@dataclass
class Mode:
    """The windows of all items of one kind of unit, and their multi-index."""

    width: int
    radius: int
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # a hash of each window
    shingles: dict = field(default_factory=dict)
    weight: dict = field(default_factory=dict)
    blocks: list = field(default_factory=list)

    def build(self, sequences: dict[int, np.ndarray]) -> Mode:
        per = self.width - SHINGLE + 1
        item, at, prints, whole, having = [], [], [], [], {}
        for key, seq in sequences.items():
            s = self.shingles[key] = units.windows(seq, SHINGLE)
            f = fingerprints(s, per)
            item.append(np.full(len(f), key, np.int64))
            at.append(np.arange(len(f)))
            prints.append(f)
            whole.append(units.windows(seq, self.width))
            for x in set(s.tolist()):
                having[x] = having.get(x, 0) + 1
        self.weight = {x: 1 / n for x, n in having.items()}
        if item:
            self.item, self.at, self.prints, self.whole = map(np.concatenate, (item, at, prints, whole))
        edges = np.linspace(0, 64, self.radius + 2).astype(int)
        for lo, hi in zip(edges, edges[1:]):
            block = self._block(self.prints, lo, hi)
            many = np.bincount(block.astype(np.int64), minlength=1 << int(hi - lo))
            self.blocks.append((lo, hi, np.argsort(block, kind="stable"), np.cumsum(many) - many, many))
        return self

    @staticmethod
    def _block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << int(hi - lo)) - 1)

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position among ``prints``, item window) of all pairs within the radius; a pair may come more than once."""
        for lo, hi, order, first, many in self.blocks:
            mine = self._block(prints, lo, hi)
            counts = many[mine]
            some = np.flatnonzero(counts)
            ends = np.cumsum(counts[some])
            start = 0
            while start < len(some):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MOST_PAIRS, "right")))
                part = some[start:stop]
                n = counts[part]
                left = np.repeat(part, n)
                right = order[np.repeat(first[mine[part]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
                if close.any():
                    yield left[close], right[close]
                start = stop

    def leaks(self, sequences: list[np.ndarray], similarity: float) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(document, item) -> (best weighted similarity, longest run of equal units, verified windows), documents by their place.

        Documents are joined into slices, so that arrays are long however short the documents are; a long one fills several.
        """
        width = self.width
        seen: dict[tuple[int, int], list] = {}
        if not len(self.prints):
            return {}
        slice_, size = [], 0
        for doc, seq in enumerate(sequences):
            for offset in range(0, len(seq) - width + 1, SLICE):
                slice_.append((doc, offset, seq[offset : offset + SLICE + width - 1]))
                size += len(slice_[-1][2])
                if size >= SLICE:
                    self._scan(slice_, similarity, seen)
                    slice_, size = [], 0
        if slice_:
            self._scan(slice_, similarity, seen)
        out = {}
        for key, (value, count, runs) in seen.items():
            run = longest = 0
            before = None
            for diagonal, i in sorted(runs):
                run = run + 1 if before == (diagonal, i - 1) else 1
                before = (diagonal, i)
                longest = max(longest, run)
            out[key] = (value, longest + width - 1 if longest else 0, count)
        return out

    def _scan(self, parts: list[tuple[int, int, np.ndarray]], similarity: float, seen: dict) -> None:
        width, per = self.width, self.width - SHINGLE + 1
        units_ = np.concatenate([p for _, _, p in parts])
        sizes = np.array([len(p) for _, _, p in parts])
        begins = np.cumsum(sizes) - sizes
        windows = sizes - width + 1  # windows that lie inside their part
        places = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        shingles = units.windows(units_, SHINGLE)
        pairs = [(places[left], right) for left, right in self.near(fingerprints(shingles, per)[places])]
        if not pairs:
            return
        left, right = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
        left, right = np.unique(np.stack((left, right)), axis=1) if len(pairs) > 1 else (left, right)
        owner = np.searchsorted(begins, left, "right") - 1
        equal = units.windows(units_, width)[left] == self.whole[right]
        for p, i, j, same in zip(owner.tolist(), left.tolist(), right.tolist(), equal.tolist()):
            doc, offset, _ = parts[p]
            item, k = int(self.item[j]), int(self.at[j])
            value = 1.0
            if not same:
                x, y = set(shingles[i : i + per].tolist()), set(self.shingles[item][k : k + per].tolist())
                value = sum(self.weight.get(w, 1.0) for w in x & y) / sum(self.weight.get(w, 1.0) for w in x | y)
                if value < similarity:
                    continue
            entry = seen.setdefault((doc, item), [0.0, 0, set()])
            entry[0] = max(entry[0], value)
            entry[1] += 1
            if same:
                here = offset + i - int(begins[p])
                entry[2].add((here - k, here))


@dataclass
class Index:
    words: Mode
    letters: Mode

    @classmethod
    def of(cls, items: list[tuple[int, str]], words: int, letters: int, radius: int) -> Index:
        by_word, by_letter = {}, {}
        for key, text in items:
            form = plain(text)
            if units.spaceless_share(form) > 0.5:
                by_letter[key] = units.letters_of_lower(form)
            else:
                by_word[key] = _word_ids(form)
        return cls(Mode(words, radius).build(by_word), Mode(letters, radius).build(by_letter))


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, letters: int = LETTERS, radius: int = RADIUS, similarity: float = SIMILARITY, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, run, windows, unit): which documents contain passages of which items."""
    stated = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    out = None
    for block in batched(((r["item_id"], r["text"]) for r in stated.toLocalIterator()), item_block):
        index = documents.sparkSession.sparkContext.broadcast(Index.of(list(block), words, letters, radius))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            both = index.value
            for batch in batches:
                ids, forms = batch["doc_id"].tolist(), [plain(t) if isinstance(t, str) else "" for t in batch["text"]]
                found = both.words.leaks([_word_ids(f) for f in forms], similarity)
                rows = [(ids[d], item, *v, "word") for (d, item), v in found.items()]
                if len(both.letters.prints):
                    # A text without letters of scripts without spaces has no window of them.
                    found = both.letters.leaks([units.letters_of_lower(f) if not f.isascii() and units.spaceless_share(f) > 0 else NOTHING for f in forms], similarity)
                    rows += [(ids[d], item, *v, "letter") for (d, item), v in found.items()]
                yield frames.frame(["doc_id", "item_id", "similarity", "run", "windows", "unit"], rows)

        hits = spread_out(documents.select("doc_id", "text"), "doc_id").mapInPandas(scan, HITS)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = documents.sparkSession.createDataFrame([], HITS)
    best = F.max(F.struct("run", "similarity", "windows", "unit")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", "b.run", "b.windows", "b.unit")


def found(leaks: DataFrame, words: int = WORDS, letters: int = LETTERS) -> DataFrame:
    return leaks.where(F.col("run") >= F.when(F.col("unit") == "word", words).otherwise(letters)).select("doc_id", "item_id")
