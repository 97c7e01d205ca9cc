"""Words of many texts at once as numpy arrays: boundaries and 64-bit hashes of words and of word windows.

A word's hash is a polynomial over its bytes modulo 2**64, then mixed; a window's is one over its words'
hashes. Windows that differ share a hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLANKS = b"\t\n\x0b\x0c\r "
#: Bytes of text worked on at once, unless one text is longer.
CHUNK = 1 << 20
#: How far past its place a cut waits for a blank where words may be cut.
WAIT = 4096
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_VALUE[list(BLANKS)] = 0
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _STEP | np.uint64(1))]).astype(np.uint64), dtype=np.uint64)
    return _POWERS


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, the place of each word's first byte, for every byte its distance from the word start before
    it, and the number of each word's text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IS_WORD[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    since = np.zeros(len(raw), np.int64)
    since[starts] = starts
    np.maximum.accumulate(since, out=since)
    np.subtract(np.arange(len(raw)), since, out=since)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return raw, starts, since, np.searchsorted(ends, starts, side="right")


def pieces(raw: bytes, limit: int = CHUNK, whole_words: bool = True) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end before a blank. Without ``whole_words`` a part ends at the latest ``WAIT`` bytes after its
    place, so that a word longer than that may be cut."""
    begin = 0
    while len(raw) - begin > limit:
        cut = _BLANK.search(raw, begin + limit, len(raw) if whole_words else min(len(raw), begin + limit + WAIT))
        end = cut.start() if cut else len(raw) if whole_words else min(len(raw), begin + limit + WAIT)
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and the number of its text. Worked on in parts, so that a long text takes
    little more memory than what is returned."""
    found, owner = [], []
    for begin, end in chunks([len(t) for t in texts]):
        parts = [texts[begin:end]] if end - begin > 1 else [[p] for p in pieces(texts[begin])]
        for part in parts:
            raw, starts, since, of = bounds(part)
            found.append(hashed(raw, starts, since))
            owner.append(of + begin)
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def hashed(raw: np.ndarray, starts: np.ndarray, since: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    return mixed(np.add.reduceat(_VALUE[raw] * _powers(int(since.max()) + 1)[since], starts))


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """The hash of every window of ``width`` words (windows across texts included). Each salt gives hashes of their own."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = mixed(np.arange(1 + 1000 * salt, width + 1 + 1000 * salt, dtype=np.uint64) * _B) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : n + k] * factor[k]
    return mixed(out)
