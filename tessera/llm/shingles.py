"""Five-word shingle sets as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, b in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; fewer words: one shingle; no words: none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64, out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(raw))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    return np.unique(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))


def set_digest(s: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; the empty set has none."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(s: np.ndarray, n: int) -> np.ndarray:
    """n MinHash symbols of 16 bits of a non-empty set; each permutation is an odd multiplier of the hashes' upper half."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(high), 128):
        np.minimum(low, (high[a : a + 128, None] * _MULTIPLIERS[None, :n]).min(0), out=low)
    return (mix(low.astype(np.uint64) + (np.arange(n, dtype=np.uint64) << np.uint64(32))) >> np.uint64(48)).astype(np.uint16)
