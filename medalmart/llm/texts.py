"""Texts as numpy arrays: code points, words and their 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

_TABLES: dict[str, np.ndarray] = {}
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNICODE = 0x110000
#: Characters worked on at once, which bounds memory at about 60 bytes each.
PIECE = 1 << 20


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (itself where that is longer), and whether it is a letter or digit."""
    if not _TABLES:
        _TABLES["lower"] = np.fromiter((ord(y) if len(y := x.lower()) == 1 else ord(x) for x in map(chr, range(_UNICODE))), np.uint32, _UNICODE)
        _TABLES["alnum"] = np.fromiter(map(str.isalnum, map(chr, range(_UNICODE))), np.bool_, _UNICODE)
    return _TABLES["lower"], _TABLES["alnum"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit hashes: every bit of the input reaches every bit of the output."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edge = np.concatenate(([0], edge))
    if len(flags) and flags[-1]:
        edge = np.concatenate((edge, [len(flags)]))
    return edge[::2], edge[1::2]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_TABLES.get("power", ())) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("power", _BASE), ("inverse", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["power"], _TABLES["inverse"]


def pieces(text: str, size: int = PIECE):
    """Parts of a text that end between words, of about ``size`` characters; a longer word stays whole."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of one piece."""
    lower, alnum = tables()
    points = code_points(text)
    starts, ends = bounds(alnum[points])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = powers(len(points))
    terms = lower[points].astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(points)]
    both = np.empty(2 * len(starts), np.int64)
    both[::2], both[1::2] = starts, ends
    if both[-1] == len(points):
        both = both[:-1]
    sums = np.add.reduceat(terms, both)[::2]
    return mixed(sums * inverse[starts]), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower case), and where each text's begin.

    The second array has one more entry than there are texts.
    """
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    held: list[int] = []

    def flush() -> None:
        if held:
            joined = "\x00".join(texts[i] for i in held)
            own, starts = _hashed(joined)
            ends = np.cumsum([len(texts[i]) + 1 for i in held])
            counts[np.array(held) + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
            hashes.append(own)
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        if size + len(text) > PIECE:
            flush()
            size = 0
        if len(text) > PIECE:
            own = [_hashed(p)[0] for p in pieces(text)]
            counts[i + 1] = sum(map(len, own))
            hashes += own
        else:
            held.append(i)
            size += len(text) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words; a shorter text with a word is one shingle."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(counts)))
    place = np.repeat(first[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    length = np.repeat(np.minimum(n, width), counts)
    h = np.full(starts[-1], 0x2545F4914F6CDD1D, np.uint64)
    for k in range(width):
        has = length > k
        h[has] = mixed(h[has] * np.uint64(0xD6E8FEB86659FD93) + words[place[has] + k])
    return h, starts
