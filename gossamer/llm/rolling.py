"""Rolling hashes of word windows, vectorised; modular arithmetic is that of 64-bit words."""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import xxhash

from gossamer.llm.common import kept_for_task

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = kept_for_task({})


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        base = _SEEDS[which] | 1
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def window_hashes(words: np.ndarray, length: int, starts: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` word hashes, or of those at ``starts``; equal windows are equal wherever they stand."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1, which)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)))
    if starts is None:
        out = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    else:
        out = (sums[starts + length] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: Collection[bytes] | Collection[str]) -> np.ndarray:
    """Hashing anew is faster than any cache."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words: windows over both are equal by chance once in 2**128."""
    h = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
