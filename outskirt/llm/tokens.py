"""Words of a text and rolling hashes over them, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * _BYTE_BASE)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            made = []
            for base in (self.base, self.inverse):
                steps = np.full(n, base, dtype=U)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=U))
            self.up, self.down = made
        return self.up, self.down


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def _sums(values: np.ndarray, powers: _Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers.upto(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    step = np.diff(space)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def hashes_between(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    sums = _sums(_BYTES[np.frombuffer(data, dtype=np.uint8)], _byte_powers)
    down = _byte_powers.upto(len(data) + 1)[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    return hashes_between(data, starts, ends)


class Spans:
    """Hashes of any ranges of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = _sums(words, _word_powers)
        self.down = _word_powers.upto(self.n + 1)[1]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def grams(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, dtype=U)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1] + U(k))
