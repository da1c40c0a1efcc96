"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE_WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _reach(size: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to `size` of them."""
    global _powers, _inverse
    if len(_powers) < size:
        size = max(size, 2 * len(_powers), 1 << 16)
        _powers, _inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers), np.cumprod(_inverse)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_hashes(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of every run of `width` words in order; of all words together where there are fewer; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    _reach(len(joined) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers[: len(joined)])])
    gaps = np.flatnonzero(joined == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    if len(starts) > width:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return mixed((sums[ends] - sums[starts]) * _inverse[starts])


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), width))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class MinHasher:
    """The smallest values of `size` independent hash functions over a set, their upper 32 bits or all 64."""

    def __init__(self, size: int, seed: int = 1, bits: int = 32):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, size, dtype=np.uint64)
        self.bits = bits

    def __call__(self, hashes: np.ndarray, count: int | None = None) -> np.ndarray:
        """Of the first `count` functions; the largest value where the set is empty."""
        a, b = self.a[:count], self.b[:count]
        best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(hashes), 2048):
            best = np.minimum(best, (hashes[lo : lo + 2048, None] * a + b).min(axis=0))
        return best if self.bits == 64 else (best >> np.uint64(32)).astype(np.uint32).view(np.int32)
