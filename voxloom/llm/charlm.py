"""Character language models: interpolated Kneser-Ney, one per language, in sorted hash arrays shared by all languages.

For each order there is one sorted array of n-gram hashes (the union over languages) with a matrix of log probabilities, and
one sorted array of context hashes with a matrix of log back-off weights. A text is scored for all languages at once: its
n-grams are looked up by binary search at the highest order, those not found one order lower with the back-off weight of
their context added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ORDER = 5
DISCOUNT = 0.75
VOCABULARY = 4000
MEMO = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n characters."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ codes[k : k + size]) * _MULTIPLIER
            out ^= out >> np.uint64(32)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _encode(texts: list[str]) -> np.ndarray:
    """The texts one after the other, each between spaces wide enough that no n-gram holds two texts."""
    pad = " " * (ORDER - 1)
    return np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class _One:
    """Counts of one language."""

    def __init__(self, texts: list[str]):
        codes = _encode(texts)
        grams: list = [None]
        for n in range(1, ORDER + 1):
            h = _hash(codes, n)
            keys, first, counts = np.unique(h, return_index=True, return_counts=True)
            context = _hash(codes, n - 1)[first] if n > 1 else np.zeros(len(keys), np.uint64)
            suffix = _hash(codes, n - 1)[first + 1] if n > 1 else np.zeros(len(keys), np.uint64)
            grams.append([keys, counts.astype(float), context, suffix])
        for n in range(1, ORDER):  # lower orders count the different characters before an n-gram
            keys, before = np.unique(grams[n + 1][3], return_counts=True)
            at = _find(keys, grams[n][0])
            grams[n][1] = np.where(at >= 0, before[at], 1.0).astype(float)
        self.grams = grams
        self.p: list = [None]
        self.contexts: list = [None]
        for n in range(1, ORDER + 1):
            keys, counts, context, suffix = grams[n]
            ctx, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=counts)
            followers = np.bincount(inverse)
            weight = DISCOUNT * followers / total
            lower = np.full(len(keys), 1 / VOCABULARY) if n == 1 else self.p[n - 1][_find(grams[n - 1][0], suffix)]
            self.p.append(np.maximum(counts - DISCOUNT, 0) / total[inverse] + weight[inverse] * lower)
            self.contexts.append((ctx, weight))


@dataclass
class Models:
    languages: list[str]
    keys: list  # by order: sorted hashes of n-grams
    logp: list  # by order: their log probabilities, a column for each language
    contexts: list
    backoff: list

    @classmethod
    def fit(cls, texts: dict[str, list[str]]) -> Models:
        languages = sorted(texts)
        ones = [_One(texts[x]) for x in languages]
        keys, logp, contexts, backoff = [None], [None], [None], [None]
        for n in range(1, ORDER + 1):
            union = np.unique(np.concatenate([o.grams[n][0] for o in ones]))
            ctx_union = np.unique(np.concatenate([o.contexts[n][0] for o in ones]))
            context, suffix = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
            for o in ones:
                at = _find(union, o.grams[n][0])
                context[at], suffix[at] = o.grams[n][2], o.grams[n][3]
            weights = np.zeros((len(ctx_union), len(ones)), np.float32)
            for j, o in enumerate(ones):
                weights[_find(ctx_union, o.contexts[n][0]), j] = np.log(o.contexts[n][1])
            if n == 1:
                p = np.full((len(union), len(ones)), np.log(1 / VOCABULARY), np.float32) + weights[_find(ctx_union, context)]
            else:
                p = logp[n - 1][_find(keys[n - 1], suffix)] + weights[_find(ctx_union, context)]
            for j, o in enumerate(ones):
                p[_find(union, o.grams[n][0]), j] = np.log(o.p[n])
            keys.append(union)
            logp.append(p.astype(np.float32))
            contexts.append(ctx_union)
            backoff.append(weights)
        return cls(languages, keys, logp, contexts, backoff)

    def _score(self, hashes: list, ends: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the characters at ``ends`` after their n - 1 predecessors."""
        if n == 0:
            return np.full((len(ends), len(self.languages)), np.log(1 / VOCABULARY), np.float32)
        starts = ends - n + 1
        at = _find(self.keys[n], hashes[n][starts])
        out = self.logp[n][at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lower = self._score(hashes, ends[missing], n - 1)
            if n > 1:
                ctx = _find(self.contexts[n], hashes[n - 1][starts[missing]])
                lower = lower + np.where(ctx[:, None] >= 0, self.backoff[n][ctx], 0)
            else:
                lower = lower + self.backoff[1][0]
            out[missing] = lower
        return out

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """The log probability of every piece but its first ORDER - 1 characters, which are context."""
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes = [None, *(_hash(codes, n) for n in range(1, ORDER + 1))]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.ones(len(codes), bool)
        begin = np.cumsum(sizes) - sizes
        for k in range(ORDER - 1):
            inside[begin + k] = False
        rows = self._score(hashes, np.flatnonzero(inside), ORDER).astype(np.float64)
        scored = sizes - (ORDER - 1)
        return np.add.reduceat(rows, np.cumsum(scored) - scored, axis=0)

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Mean negative log probability a character (nats), a row for each text and a column for each language.

        Texts are words with single spaces. A word is scored after the characters that can influence it and the result kept,
        so a word that comes again after the same characters costs one look-up.
        """
        memo, kept = self.__dict__.setdefault("_memo", {}), self.__dict__.get("_kept")
        if len(memo) > MEMO:
            memo.clear()
            kept = None
        index, counts, fresh = [], [], []
        lead = " " * (ORDER - 1)
        for text in texts:
            tail, words = lead, text.split(" ")
            for word in words:
                key = tail + word + " "
                at = memo.get(key)
                if at is None:
                    at = memo[key] = len(memo)
                    fresh.append(key)
                index.append(at)
                tail = key[-(ORDER - 1) :]
            counts.append(len(words))
        for lo in range(0, len(fresh), 20_000):
            rows = self._pieces(fresh[lo : lo + 20_000])
            kept = rows if kept is None else np.concatenate([kept, rows])
        self._kept = kept
        if not texts:
            return np.zeros((0, len(self.languages)))
        counts = np.array(counts)
        total = np.add.reduceat(kept[index], np.cumsum(counts) - counts, axis=0)
        return -total / np.array([len(t) + 1 for t in texts])[:, None]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}
