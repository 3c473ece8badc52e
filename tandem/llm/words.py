"""Words of whole texts and their hashes, for all texts of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Random odd multiplier and its inverse modulo 2**64, and the mixing constants of a public 64-bit finaliser.
MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 2**64)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
VALUE[ord("A") : ord("Z") + 1] = VALUE[ord("a") : ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, MULT, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def runs(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Stretches of texts of at most so many bytes, or of one text, so that arrays over them stay small."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and where each text's words begin (one more at the end)."""
    found = [_hashed(texts[a:b]) for a, b in runs(texts)]
    counts = np.concatenate([np.zeros(1, np.int64), *(np.diff(at) for _, at in found)])
    return np.concatenate([*(h for h, _ in found), np.zeros(0, np.uint64)]), np.cumsum(counts)


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    size = 1 << 16
    while size <= len(data):
        size *= 2
    up, down = _powers(size)
    wordy = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], wordy, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUE[data] * up[: len(data)], dtype=np.uint64)))
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of k-word shingles of each text; the whole sequence is one where there are fewer words, none without words."""
    return [s for a, b in runs(texts) for s in _shingles(*_hashed(texts[a:b]), k)]


def _shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    n = max(len(hashes) - k + 1, 0)
    rows = np.zeros(n, np.uint64)
    for j in range(k):
        rows = mix(rows * np.uint64(MULT) + hashes[j : j + n])
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(rows[a : b - k + 1])
        else:
            whole = np.uint64([b - a])
            for h in hashes[a:b]:
                whole = mix(whole * np.uint64(MULT) + h)
            yield whole[: int(b > a)]
