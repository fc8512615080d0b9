"""Hashed word n-grams of texts as sparse vectors, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex

# words, numbers, and runs of the same kind of mark; case is kept as a shape below
_TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
# words remembered per worker; beyond it the memory starts afresh
_MEMORY = 1 << 20
# n-gram shares are small numbers; this brings them near one
SCALE = 20.0


class NgramHasher:
    """Word unigrams and bigrams of a text, hashed into ``1 << bits`` slots.

    A word counts in lower case; its shape (all capitals, capitalized, lower case, number, marks) and the repetition of the
    word before are words of their own, so are bigrams of shapes. Hashes do not depend on the process.
    """

    def __init__(self, bits: int):
        self.mask = np.uint64((1 << bits) - 1)
        self._start()

    def _start(self) -> None:
        self._place: dict[str, int] = {}
        self._codes = np.zeros((1 << 12, 2), dtype=np.uint64)

    def _learn(self, words: Iterable[str]) -> None:
        for word in words:
            if word not in self._place:
                at = len(self._place)
                if at == len(self._codes):
                    self._codes = np.concatenate([self._codes, np.zeros_like(self._codes)])
                self._codes[at] = _fnv(word.lower()), _fnv("\x00" + _shape(word))
                self._place[word] = at

    def slots(self, text: str) -> np.ndarray:
        """Slots of all n-grams, one per occurrence."""
        words = _TOKEN.findall(text)
        if not words:
            return np.zeros(0, dtype=np.int64)
        if len(self._place) > _MEMORY:
            self._start()
        try:
            at = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            self._learn(words)
            at = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        codes = self._codes[at]
        word, shape = codes[:, 0], codes[:, 1]
        with np.errstate(over="ignore"):
            bigrams = word[:-1] * _MULT + word[1:]
            shapes = shape[:-1] * _MULT + shape[1:] + np.uint64(1)
            # a word two places earlier counts as well, since marks may stand between
            again = int((word[1:] == word[:-1]).sum() + (word[2:] == word[:-2]).sum())
            every = np.concatenate([word, shape, bigrams, shapes, np.full(again, _SAME)])
            every ^= every >> np.uint64(29)
            every *= _MULT
        return ((every >> np.uint64(20)) & self.mask).astype(np.int64)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and how often each occurs per word."""
        slots, counts = np.unique(self.slots(text), return_counts=True)
        return slots, counts / max(1, counts.sum()) * SCALE

    def dot(self, weights: np.ndarray, text: str) -> float:
        """The vector's product with ``weights``, without sorting the slots."""
        slots = self.slots(text)
        return float(weights[slots].sum()) / max(1, len(slots)) * SCALE


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "0"
    if not word[0].isalpha():
        return "^" + word[:3]
    return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"


def _fnv(text: str) -> int:
    value = 0xCBF29CE484222325
    for byte in text.encode("utf-8", "surrogatepass"):
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value


_SAME = np.uint64(_fnv("\x00same"))
