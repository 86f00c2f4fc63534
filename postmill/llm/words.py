"""Words of a text, and hashed word runs, for the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

_TAG = re.compile(r"<[^>]*>")
_UNICODE_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def unicode_words(text: str | None) -> list[str]:
    """Runs of Unicode letters and digits of the lower-cased text, each <...> taken for a space."""
    text = text or ""
    return _UNICODE_WORD.findall((_TAG.sub(" ", text) if "<" in text else text).lower())


def ascii_words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 of the lower-cased text, each <...> taken for a space."""
    text = (text or "").lower()
    return _ASCII_WORD.findall(_TAG.sub(" ", text) if "<" in text else text)


_CODES = np.zeros(256, np.uint64)
_R = np.uint64(0x9FB21C651E98DF25)
_R_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_R, _R_INVERSE)):
            x = np.full(n, base)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    both = _POWERS[0][:n], _POWERS[1][:n]
    if n > 4_000_000:  # a very long text's table isn't kept
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return both


def ascii_runs(texts: list[str | None], n: int, least: int) -> tuple[np.ndarray, np.ndarray, list[int], list[bytes]]:
    """Hashes of the runs of n words, as ascii_words() has them, of all texts of at least max(n, least) words.

    Result: the runs of these texts end to end, where each text's begin, the texts' positions, and a
    digest of each one's words. All letters of all texts are hashed at once, a word as a polynomial.
    """
    bare = [(t or "").lower() for t in texts]
    bare = [_TAG.sub(" ", t) if "<" in t else t for t in bare]
    at = np.cumsum([0, *(len(t) + 1 for t in bare)])
    codes = _CODES[np.frombuffer(" ".join([*bare, ""]).encode("ascii", "replace"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, codes != 0, False]))
    begin, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(codes * power[: len(codes)], dtype=np.uint64)]
    words = mixed((sums[end] - sums[begin]) * inverse[begin])
    first = np.searchsorted(begin, at)
    size = np.diff(first)
    enough = size >= max(n, least)
    known = np.flatnonzero(enough).tolist()
    runs = run_hashes(words, n)
    left = np.repeat(first[1:], size) - np.arange(len(words))  # words from here to the text's end
    inside = (left >= n) & np.repeat(enough, size)
    starts = np.cumsum(size[enough] - n + 1) - (size[enough] - n + 1)
    return runs[inside[: len(runs)]], starts, known, [xxhash.xxh3_128_digest(words[first[i] : first[i + 1]].tobytes()) for i in known]


class WordHash(dict):
    """word -> 64-bit hash, computed once a word; emptied when it grows beyond a bound."""

    BOUND = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out = mixed(out) + words[j : len(words) - n + 1 + j]
    return mixed(out)


_CODES[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = mixed(np.arange(1, 37, dtype=np.uint64))
