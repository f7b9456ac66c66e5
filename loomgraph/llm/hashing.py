"""Vectorised polynomial hashing of bytes, words and windows modulo the prime 2**61 - 1, with a mixing step on top.

Modulo a prime two different strings of length n agree for at most n of the 2**61 bases, so no structure of the
texts makes them collide; the base is fixed, but chosen at random."""

from __future__ import annotations

import numpy as np

U = np.uint64
PRIME = U((1 << 61) - 1)
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)
#: Values that are multiplied at once.
CHUNK = 1 << 13
_rng = np.random.default_rng(20240601)
#: One random value below PRIME for each byte, and random bases.
BYTE_VALUES = _rng.integers(1, int(PRIME), 256, dtype=np.uint64)
BYTE_BASE, WORD_BASE, OTHER_BASE = (int(x) for x in _rng.integers(1 << 32, int(PRIME), 3, dtype=np.uint64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[tuple[int, bool], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x below 2**64."""
    x = (x & PRIME) + (x >> U(61))
    return np.minimum(x, x - PRIME)  # below PRIME the difference wraps around and is larger


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, both below PRIME; long arrays in chunks that stay in the processor's cache."""
    n = np.size(a)
    if n <= 2 * CHUNK:
        return _times(a, b)
    out = np.empty(n, np.uint64)
    for k in range(0, n, CHUNK):
        out[k : k + CHUNK] = _times(a[k : k + CHUNK], b[k : k + CHUNK] if np.ndim(b) else b)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & _LOW30) << U(31)) + a0 * b0)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, or the inverses of these."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        p = int(PRIME)
        step = pow(base, -1, p) if inverse else base
        have = np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, times(have, U(pow(step, len(have), p)))])
        _powers[base, inverse] = have
    return have[:n]


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**31 + low modulo PRIME, of sums of upper and lower halves."""
    return _reduced((high >> U(30)) + ((high & _LOW30) << U(31)) + low)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on all input bits."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, one more than values; of a value its lower 61 bits count."""
    terms = times(np.minimum(values & PRIME, PRIME - U(1)), powers(base, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    out[1:] = _joined(np.cumsum(terms >> U(31), dtype=np.uint64), np.cumsum(terms & _LOW31, dtype=np.uint64))
    return out


def fingerprints(sums: np.ndarray, base: int, length: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints below PRIME of the runs of `length` values that start at the places `at`."""
    return times(_reduced(sums[at + length] + (PRIME - sums[at])), powers(base, len(sums), True)[at])


def grams(sums: np.ndarray, base: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of `length` values that start at each place, or at the places `at`."""
    if at is None:
        n = max(len(sums) - length, 0)
        return mix(times(_reduced(sums[length : length + n] + (PRIME - sums[:n])), powers(base, n, True)))
    return mix(fingerprints(sums, base, length, at))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows (runs of bytes marked in `inside`), and for each row the
    number of words before it (one more than rows). No word crosses rows."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    before = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(before, lens)
    terms = times(BYTE_VALUES[data[place + np.repeat(starts, lens)]], powers(BYTE_BASE, int(lens.max()))[place])
    sums = _joined(np.add.reduceat(terms >> U(31), before), np.add.reduceat(terms & _LOW31, before))
    return mix(sums ^ (lens.astype(np.uint64) << U(61)))


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone."""
    out, start, rows = [], 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), rows)
        out.append((start, end))
        start = end
    return out
