"""Where sentences begin in text that has no marks: a linear chain over characters.

Every character at which a sentence could begin (the first of a word, or any letter of a script written without spaces) is
tagged as boundary or inside. Its score is that of a logistic model over the character sequences on either side, hashed into one
table of weights for all scripts; neighbouring tags are tied by how often they follow each other, and Viterbi decoding picks the
likeliest tags of a stretch. The model is fitted to sentences whose marks are stripped and which are joined into one line.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from voxloom.llm import units

BITS = 18
LEFT, RIGHT = (1, 2, 3, 4, 5), (1, 2, 3, 4, 5, 6, 8)
EPOCHS, RATE, DECAY = 20, 0.5, 1e-6
HELD_OUT = 10
PAD = 0x110000
ENDS = " .!?…。！？｡।॥,，、;:\"'“”«»「」『』"


@cache
def _joins() -> np.ndarray:
    """By code point: marks, which no sentence begins with."""
    return np.fromiter((unicodedata.category(chr(cp))[0] == "M" for cp in range(units.TOP)), bool, units.TOP)


def places(text: str) -> np.ndarray:
    """Positions at which a sentence could begin although no mark says so."""
    codes = np.minimum(units.code_points(text), units.TOP - 1)
    letter, unspaced = units.tables()
    if len(codes) < 2:
        return np.zeros(0, np.int64)
    here, before = codes[1:], codes[:-1]
    ok = letter[here] & ~_joins()[here]
    words = (before == 32) & np.concatenate(([False], letter[codes[:-2]]))
    letters = unspaced[here] & unspaced[before]
    return np.flatnonzero(ok & (words | letters)) + 1


def _features(text: str, at: np.ndarray) -> np.ndarray:
    """Hashes of the sequences left and right of each position."""
    wide = max(max(LEFT) + 1, max(RIGHT))
    codes = np.concatenate((np.full(wide, PAD, np.uint64), units.code_points(text).astype(np.uint64), np.full(wide, PAD, np.uint64)))
    right = at + wide
    left = right - (codes[right - 1] == 32)  # the blank before a word tells nothing
    out = []
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        sides = {}
        for side, start, step, sizes in ((1, left - 1, -1, LEFT), (2, right, 1, RIGHT)):
            h = np.full(len(at), side, np.uint64)
            for n in range(max(sizes)):
                h = (h ^ codes[start + step * n]) * mix
                h ^= h >> np.uint64(29)
                if n + 1 in sizes:
                    out.append(h + np.uint64(n))
                    sides[side, n + 1] = h
        for a, b in ((1, 1), (2, 2), (2, 4)):
            out.append((sides[1, a] * np.uint64(31) ^ sides[2, b]) * mix)
        k = np.stack(out, axis=1)
        return ((k * mix) >> np.uint64(64 - BITS)).astype(np.int64)


class Begins:
    def __init__(self, weights: np.ndarray, bias: float, again: float):
        self.weights, self.bias = weights, bias
        self.again = again  # what it costs to begin a sentence at the place after one

    def scores(self, text: str, at: np.ndarray) -> np.ndarray:
        return self.weights[_features(text, at)].sum(axis=1) + self.bias if len(at) else np.zeros(0)

    def boundaries(self, text: str) -> list[int]:
        """Positions tagged as boundary."""
        at = places(text)
        score = self.scores(text, at).tolist()
        inside, begins, back = 0.0, -math.inf, []
        for s in score:
            tied = begins + self.again
            back.append((begins > inside, tied > inside))
            inside, begins = max(inside, begins), max(inside, tied) + s
        tag, out = begins > inside, []
        for i in range(len(score) - 1, -1, -1):
            if tag:
                out.append(int(at[i]))
            tag = back[i][1] if tag else back[i][0]
        return out[::-1]


def stripped(sentence: str) -> str:
    return re.sub(f"^[{re.escape(ENDS)}]+|[{re.escape(ENDS)}]+$", "", sentence)


def joined(sentences: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """One line without marks between the sentences, and where they begin but for the first."""
    line, begins = "", []
    for s in filter(None, map(stripped, sentences)):
        if line:
            tight = bool(units.spaceless_share(line[-1]) and units.spaceless_share(s[0]))
            line += "" if tight else " "
            begins.append(len(line))
            if rng.random() < 0.2:
                s = s[0].lower() + s[1:]
        line += s
    return line, begins


def fit(sentences: list[str], rounds: int = 3, seed: int = 5) -> Begins:
    """From whole sentences; without any, a model that finds no boundary. The bias is set on a tenth of them that is held out."""
    held = sentences[::HELD_OUT]
    model = _fit([s for k, s in enumerate(sentences) if k % HELD_OUT], rounds, seed)
    rng, scores, truth = random.Random(seed + 1), [], []
    for line, begins in _lines(held, rng):
        at = places(line)
        scores.append(model.scores(line, at))
        truth.append(np.isin(at, begins))
    if scores and (y := np.concatenate(truth)).any():
        s = np.concatenate(scores)
        order = np.argsort(-s)
        right, given = np.cumsum(y[order]), np.arange(1, len(s) + 1)
        score = 2 * right / (given + y.sum())  # F1
        k = int(score.argmax())
        model.bias -= float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    return model


def _lines(sentences: list[str], rng: random.Random) -> Iterator[tuple[str, list[int]]]:
    """Lines of two to six sentences of one script, as in a text."""
    mixed = list(sentences)
    rng.shuffle(mixed)
    mixed.sort(key=_script)
    k = 0
    while k < len(mixed):
        n = rng.randint(2, 6)
        yield joined(mixed[k : k + n], rng)
        k += n


def _fit(sentences: list[str], rounds: int, seed: int) -> Begins:
    rng = random.Random(seed)
    rows, truth, follow, count = [], [], 0, 0
    for _ in range(rounds):
        for line, begins in _lines(sentences, rng):
            at = places(line)
            if len(at):
                rows.append(_features(line, at))
                y = np.isin(at, begins)
                truth.append(y)
                follow, count = follow + int((y[1:] & y[:-1]).sum()), count + int(y.sum())
    weights = np.zeros(1 << BITS)
    if not count:
        return Begins(weights, -10.0, 0.0)
    x, y = np.concatenate(rows), np.concatenate(truth).astype(float)
    seen = np.full(1 << BITS, 1e-6)
    bias, order = math.log(y.mean() / (1 - y.mean() + 1e-9)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for part in np.array_split(order.permutation(len(x)), max(1, len(x) // 20_000)):
            f, t = x[part], y[part]
            error = 1 / (1 + np.exp(-(weights[f].sum(axis=1) + bias))) - t
            grad = np.bincount(f.ravel(), np.repeat(error, f.shape[1]), 1 << BITS) / len(part) ** 0.5 + DECAY * weights
            seen += grad * grad
            weights -= RATE * grad / np.sqrt(seen + 1e-2)
    return Begins(weights.astype(np.float32), bias, math.log((follow + 0.5) / count) - math.log(y.mean()))


def _script(sentence: str) -> str:
    letters = [c for c in sentence if c.isalpha()]
    return unicodedata.name(letters[len(letters) // 2], "?").split()[0] if letters else "?"
