"""Words and shingles of many texts as 64-bit numbers, computed over byte arrays.

The same bytes have the same number in every process. Used inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; longer texts are cut at white space.
PIECE = 1 << 20
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = numbers(256, 1)[_LOWER]
_BASE = int(numbers(1, 2)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = numbers(SHINGLE, 3) | np.uint64(1)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def word_spans(data: np.ndarray, cuts: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of every word, a run of bytes that are no gap; a word does not go beyond a cut."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(n)
    word = ~gap[data]
    inner = cuts[(cuts > 0) & (cuts < n)]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[inner] = word[inner]
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=running[1:])
    return starts, stops, mixed((running[stops] - running[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))


def _long_text(data: np.ndarray) -> np.ndarray:
    found, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
                break
            stop = min(stop + PIECE, len(data))
        found.append(word_spans(data[at:stop], np.zeros(0, dtype=np.int64))[2])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word numbers, offsets of the rows' words), A-Z lower-cased; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1, first + 1)
        piece, cuts = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if last == first + 1 and len(piece) > PIECE:
            words = _long_text(piece)
            yield first, last, words, np.array([0, len(words)])
        else:
            starts, _, words = word_spans(piece, cuts)
            yield first, last, words, np.searchsorted(starts, cuts)
        first = last


def shingles(words: np.ndarray) -> np.ndarray:
    """The number at i stands for the five words from i on; the last four places are not there."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += words[k : n + k] * _PLACE[k]
    return mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; with fewer than five words all words as one."""
    for first, last, words, offsets in hashed_words(texts):
        every = shingles(words)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(every[a : b - SHINGLE + 1])
            elif b > a:
                short = words[a:b] * _PLACE[: b - a]
                yield mixed(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(int(b - a)))
            else:
                yield np.zeros(0, dtype=np.uint64)
