"""Hashes of word shingles, computed from whole texts with array arithmetic."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Odd factor of the rolling sum and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(FACTOR, -1, 1 << 64)
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR**i and INVERSE**i for i up to ``n``."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((FACTOR, INVERSE)):
            p = np.ones(1, np.uint64)
            while len(p) <= size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(data: np.ndarray) -> np.ndarray:
    """Running sums; the hash of bytes a to b is (sums[b] - sums[a]) * INVERSE**a."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte stretches from ``starts`` to ``ends``."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(sums: np.ndarray, low: int, high: int, width: int) -> np.ndarray:
    """Hashes of the stretches of ``width`` bytes that start from ``low`` on, up to but not at ``high``."""
    _, down = powers(len(sums))
    return mixed((sums[low + width : high + width] - sums[low:high]) * down[low:high])


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle, without words none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    n = max(1, len(parts) - words + 1)
    return np.unique(stretches(rolled(data), starts[:n], ends[len(parts) - n :]))
