"""Class-conditional Kneser-Ney models of how words are spelled.

Each class has its own counts of the longest character n-grams of words (word
bounds are characters, and near a word's start the whole beginning counts). What
a class has not seen backs off to one shared model of the shorter n-grams, with
continuation counts over both classes together: a rare expression that neither
class knows well gets the same share in both, so it speaks for neither.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from darwise.llm.text import flat, mix

STRIDE = 0x9E3779B97F4A7C15  # odd; powers of it tell the places of a gram's characters apart
START, END = "\x02", "\x03"


def ngrams(word: str, order: int) -> list[str]:
    """The longest n-gram that ends at each character, from the word's start on."""
    w = START + word + END
    return [w[max(0, i + 1 - order) : i + 1] for i in range(1, len(w))]


class SharedBackoff:
    """The model as it is defined, for a few n-grams; ``fitted`` makes the same of many.

    ``counts``: longest n-gram to its counts in either class.
    """

    def __init__(self, counts: dict[str, tuple[int, int]], order: int):
        self.order, self.counts = order, counts
        self.totals: dict[str, list[int]] = {}  # context: count and distinct continuations in either class
        ones = twos = 0
        for gram, pair in counts.items():
            held = self.totals.setdefault(gram[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                held[c] += pair[c]
                held[2 + c] += pair[c] > 0
                ones += pair[c] == 1
                twos += pair[c] == 2
        self.discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        # Shorter n-grams count the distinct characters in front of them.
        self.lower: dict[str, int] = {}
        seen = list(counts)
        while True:
            below: dict[str, int] = {}
            for g in seen:
                if len(g) > 1:
                    below[g[1:]] = below.get(g[1:], 0) + 1
            if not below:
                break
            for g, n in below.items():
                self.lower[g] = self.lower.get(g, 0) + n
            seen = list(below)
        self.lower_totals: dict[str, list[int]] = {}
        for gram, n in self.lower.items():
            held = self.lower_totals.setdefault(gram[:-1], [0, 0])
            held[0] += n
            held[1] += 1
        self.alphabet = max(2, len({g[-1] for g in counts}) + 1)

    def shared(self, gram: str) -> float:
        """Share of the last character after the others, by the pooled counts."""
        p = 1.0 / self.alphabet
        for at in range(len(gram) - 1, -1, -1):
            held = self.lower_totals.get(gram[at:-1])
            if held is None:
                break
            n, types = held
            p = (max(self.lower.get(gram[at:], 0) - self.discount, 0.0) + self.discount * types * p) / n
        return p

    def step(self, gram: str) -> float:
        """Log of the last character's share in class 1 over that in class 0."""
        held = self.totals.get(gram[:-1])
        if held is None:
            return 0.0  # both back off alike
        d, p, pair = self.discount, self.shared(gram[1:]), self.counts.get(gram, (0, 0))
        each = [(max(pair[c] - d, 0.0) + d * held[2 + c] * p) / held[c] if held[c] else p for c in (0, 1)]
        return math.log(each[1]) - math.log(each[0])

    def log_ratio(self, word: str) -> float:
        """Log of the word's share in class 1 over that in class 0."""
        return sum(self.step(gram) for gram in ngrams(word, self.order))


def fitted(grams: pa.Array, pairs: np.ndarray, order: int) -> dict[str, np.ndarray]:
    """The steps of ``SharedBackoff``, for all n-grams at once and without its dicts: sorted hash arrays, as `Steps` takes them.

    ``pairs`` has the counts of each distinct n-gram in either class. A step of
    a character that neither class has seen after a context is the context's
    alone, as the shared share falls out of the ratio.
    """
    codes, size = _codes(grams)
    n, ends, power = len(size), np.cumsum(size) - 1, [np.uint64(pow(STRIDE, j, 2**64)) for j in range(order + 2)]
    back = np.zeros((order, n), np.uint64)  # values of the characters from the end
    for j in range(order):
        back[j, size > j] = _values(codes[ends[size > j] - j])
    whole = sum((back[j] * power[j + 1] for j in range(order)), np.zeros(n, np.uint64))
    before = sum((back[j] * power[j] for j in range(1, order)), np.zeros(n, np.uint64))  # all but the last character
    keys = mix(whole)
    contexts, of = np.unique(mix(before), return_inverse=True)
    total = [np.bincount(of, pairs[:, c], len(contexts)) for c in (0, 1)]
    types = [np.bincount(of, pairs[:, c] > 0, len(contexts)) for c in (0, 1)]
    ones, twos = int((pairs == 1).sum()), int((pairs == 2).sum())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5

    # Shorter n-grams count the distinct characters in front of them: one is taken off, again and again.
    left, cut, found = np.arange(n), 0, []
    while len(left := left[size[left] - cut > 1]):
        cut += 1
        at = size[left] - cut  # place from the end of the character taken off
        off = back[at, left]
        whole[left] -= off * np.array(power, np.uint64)[at + 1]
        before[left] -= off * np.array(power, np.uint64)[at]
        own, first, count = np.unique(mix(whole[left]), return_index=True, return_counts=True)
        left = left[first]
        found.append((own, count, mix(before[left])))
    lower, first, same = np.unique(np.concatenate([f[0] for f in found] or [keys[:0]]), return_index=True, return_inverse=True)
    counts = np.bincount(same, np.concatenate([f[1] for f in found] or [size[:0]]), len(lower))
    above, of_lower = np.unique(np.concatenate([f[2] for f in found] or [keys[:0]])[first], return_inverse=True)
    sums, kinds = np.bincount(of_lower, counts, len(above)), np.bincount(of_lower, minlength=len(above))

    p, going = np.full(n, 1.0 / max(2, len(np.unique(back[0])) + 1)), np.ones(n, bool)
    tail, context = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for m in range(1, order):  # the last m characters
        tail += back[m - 1] * power[m]
        if m > 1:
            context += back[m - 1] * power[m - 1]
        rows = np.flatnonzero(going & (size > m))
        known, at = _search(above, mix(context[rows]))
        going[:] = False
        rows, at = rows[known], at[known]
        going[rows] = True
        held, where = _search(lower, mix(tail[rows]))
        p[rows] = (np.maximum(np.where(held, counts[where] if len(lower) else 0, 0) - d, 0) + d * kinds[at] * p[rows]) / sums[at]

    share = [np.where(total[c][of] > 0, (np.maximum(pairs[:, c] - d, 0) + d * types[c][of] * p) / np.maximum(total[c][of], 1), p) for c in (0, 1)]
    alone = [np.where(total[c] > 0, d * types[c] / np.maximum(total[c], 1), 1.0) for c in (0, 1)]
    order_of = np.argsort(keys)
    return {
        "grams": keys[order_of], "grams_step": (np.log(share[1]) - np.log(share[0]))[order_of],
        "contexts": contexts, "contexts_step": np.log(alone[1]) - np.log(alone[0]),
    }


def _search(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their places."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(1))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the texts' lengths."""
    data, _ = flat(texts)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(codes: np.ndarray, place: np.ndarray, most: int, skip: int) -> np.ndarray:
    """For each place a hash of the up to ``most`` characters that end ``skip`` before it, within its own text."""
    value, out, at = _values(codes), np.zeros(len(codes), np.uint64), np.arange(len(codes))
    for j in range(most):
        held = place >= j + skip
        out[held] += value[at[held] - j - skip] * np.uint64(pow(STRIDE, j + 1, 2**64))
    return mix(out)


class Steps:
    """Log ratios of words from a fitted model's arrays: two binary searches for each character."""

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.arrays, self.order = arrays, order

    def _find(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = _search(self.arrays[name], keys)
        return found, self.arrays[f"{name}_step"][at] if len(self.arrays[name]) else np.zeros(len(keys))

    def log_ratios(self, words: list[str]) -> np.ndarray:
        """As `SharedBackoff.log_ratio`, for many words."""
        if not words:
            return np.zeros(0)
        codes, size = _codes(pa.array([START + w + END for w in words]))
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        seen, step = self._find("grams", _hashes(codes, place, self.order, 0))
        known, other = self._find("contexts", _hashes(codes, place, self.order - 1, 1))
        each = np.where(seen, step, np.where(known, other, 0.0))
        each[place == 0] = 0.0  # the start is given
        return np.add.reduceat(each, np.flatnonzero(place == 0))
