"""Hashes of spans of bytes by prefix sums, without loops over bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: A power of k is that of the lower bits of k, of which a small table is kept, times that of the others.
_LOW_BITS = 11


def _table(base: np.uint64, n: int) -> np.ndarray:
    """base**k modulo 2**64 for k < n."""
    x = np.full(n, base)
    x[:1] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _table(BASE, (1 << _LOW_BITS) + 1), _table(_INVERSE, (1 << _LOW_BITS) + 1)


def _high(low: np.ndarray, n: int) -> np.ndarray:
    """The powers of 0, 2**_LOW_BITS, 2 * 2**_LOW_BITS, ... below n."""
    return _table(low[-1], (n >> _LOW_BITS) + 1)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    up = np.multiply.outer(_high(_UP, len(data)), _UP[:-1]).ravel()[: len(data)]
    up *= _VALUE[data]
    np.cumsum(up, out=out[1:])
    return out


def spans_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[begin:end] that depends on these bytes alone."""
    down = _high(_DOWN, len(sums))[begin >> _LOW_BITS] * _DOWN[begin & ((1 << _LOW_BITS) - 1)]
    return mix((sums[end] - sums[begin]) * down + (end - begin).astype(np.uint64))
