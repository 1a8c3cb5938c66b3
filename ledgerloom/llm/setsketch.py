"""SetSketch registers: exponentially spaced, truncated minima of a set's hash values.

Register i of a set is floor(1 - log_b(x)) for the smallest exponential value x that
hash i gives its elements, cut to 16 bits. The registers of a union are the larger
of both sets' registers, and two sets agree in a register about as often as their
Jaccard similarity says.
"""

from __future__ import annotations

import numpy as np

from ledgerloom.llm.hashing import mixed, numbers

REGISTERS = 128
BANDS = 32
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 1

_XOR = (numbers(REGISTERS, 11) >> np.uint64(32)).astype(np.uint32)
_TIMES = (numbers(REGISTERS, 12) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BAND = numbers(BANDS, 13)


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of 64-bit elements; all 0 for the empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, dtype=np.uint16)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(high), 256):  # stays in the cache
        np.minimum(least, ((high[at : at + 256, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A number for each band of each sketch (rows); equal registers of a band give equal numbers."""
    packed = np.ascontiguousarray(sketches).view(np.uint64).reshape(len(sketches), BANDS)
    return mixed(packed + _BAND).view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity(larger: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Jaccard similarity of largest joint likelihood.

    ``larger`` and ``smaller`` count the registers in which the first sketch is above
    and below the second; n_u and n_v are the sizes of the sets.
    """
    u = n_u / np.maximum(n_u + n_v, 1)
    v = 1 - u
    equal = REGISTERS - larger - smaller
    low, high = np.zeros(u.shape), np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))
    high = np.minimum(high, 1.0)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.maximum(_p(u - v * j), 1e-9), np.maximum(_p(v - u * j), 1e-9)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    for _ in range(25):  # concave: thirds
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2
