"""Word shingles as 64-bit hashes.

A shingle is five consecutive words. Words are maximal runs of characters other
than ASCII white space, with A-Z lower-cased; a text of fewer words is one
shingle. Two different shingles share a hash with a probability of about
2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import power_of_two

WIDTH = 5
LONG_WORD = 512
BLOCK_WORDS = 50_000

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = power_of_two(n)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; a very long word becomes its digest."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if max(map(len, words), default=0) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else hashlib.blake2b(w).hexdigest().encode() for w in words]
    return words


def _block(words: list[bytes], width: int) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1]
    ends = np.concatenate((gaps, [len(joined)]))[width - 1 :]
    power, inverse = _tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * power[: len(joined)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + lengths)


def positions(words: list[bytes]) -> np.ndarray:
    """The hash of the shingle that starts at each word, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(WIDTH, len(words))
    if len(words) <= BLOCK_WORDS:
        return _block(words, width)
    parts = range(0, len(words) - width + 1, BLOCK_WORDS)
    return np.concatenate([_block(words[i : i + BLOCK_WORDS + width - 1], width) for i in parts])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(positions(words_of(text)))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
