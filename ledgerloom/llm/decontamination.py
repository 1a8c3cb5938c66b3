"""Benchmark decontamination by the q-gram lemma.

The pieces of a benchmark item are its runs of n bytes at every offset. A text within
e edits of a piece shares at least n + 1 - q (e + 1) of its q-grams, all on diagonals that
differ by e at most. So the q-grams shared with the whole item are counted in overlapping
bands of diagonals, the pieces whose places reach the bound in a band are kept, and a
banded alignment decides.

Texts are compared as UTF-8 bytes, lower-cased and with white space runs as one blank. Any one piece within its edits makes the document a leak of the item:
any passage of PIECE bytes within 8 % of edits, or of 89 bytes verbatim, wherever it begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import staged, table
from ledgerloom.llm.registry import query

Q = 8
#: Bytes of a piece. Shorter items are one piece.
PIECE = 96
#: Edits allowed in a piece: this share of its length.
EDITS = 0.08
#: Most bytes of benchmark text held by a task at once (its index takes less than 60 times
#: as much); more items are taken in turns, between which the documents are staged.
SLICE = 1 << 20
#: Bytes of document text worked on at once.
CHUNK = 1 << 20
#: Pieces aligned at once.
ALIGNED = 128

_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 11, 12, 13]] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one blank for each run of white space, and which bytes were kept."""
    data = _BLANKS[data]
    blank = data == 32
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return data[keep], keep


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram (8 bytes as one number) at every place."""
    if len(data) < Q:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((len(data) - Q + 1,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()


@dataclass
class Index:
    """Items and where their q-grams stand."""

    texts: list[bytes]
    item: np.ndarray  # id of each text
    size: np.ndarray  # of a piece
    budget: np.ndarray  # edits of a piece
    least: np.ndarray  # shared q-grams of a region within the edits
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # postings of key i: first[i] to first[i + 1]
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray  # a byte for each hash value: may a q-gram be among the keys
    shift: np.uint64

    @property
    def pieces(self) -> list[bytes]:
        return [t[k : k + n] for t, n in zip(self.texts, self.size, strict=True) for k in range(len(t) - n + 1)]

    @property
    def edits(self) -> np.ndarray:
        """Of each piece."""
        return np.repeat(self.budget, [len(t) - n + 1 for t, n in zip(self.texts, self.size, strict=True)])


def index(items: list[tuple[int, str | None]]) -> Index:
    """Null items and items of fewer than q bytes cannot be told from chance and are left out."""
    texts: list[bytes] = []
    ids: list[int] = []
    for item, text in items:
        data = normal(np.frombuffer(pc.utf8_lower(pa.scalar((text or "").strip())).as_py().encode(), np.uint8))[0].tobytes()
        if item is None or len(data) < Q:
            continue
        texts.append(data)
        ids.append(item)
    n = np.array([min(len(t), PIECE) for t in texts], dtype=np.int64)
    edits = np.minimum((n * EDITS).astype(np.int64), np.maximum(n // Q - 1, 0))
    all_grams = [grams(np.frombuffer(t, np.uint8)) for t in texts]
    flat = np.concatenate(all_grams) if texts else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in all_grams]) if texts else np.zeros(0, dtype=np.int64)
    place = np.concatenate([np.arange(len(g)) for g in all_grams]) if texts else np.zeros(0, dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    bits = max(16, int(len(keys) * 32).bit_length())
    shift = np.uint64(64 - bits)
    known = np.zeros(1 << bits, dtype=bool)
    known[(keys * _MIX) >> shift] = True
    return Index(
        texts, np.array(ids, dtype=np.int64), n, edits, n + 1 - Q * (edits + 1), keys, np.append(first, len(flat)),
        owner[order], place[order], known, shift,
    )


def _regions(data: np.ndarray, ix: Index) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place in ix.texts, lowest diagonal, starts of the pieces that reach their bound) of every band with such pieces."""
    every = grams(data)
    maybe = ix.table[(every * _MIX) >> ix.shift]
    at = np.flatnonzero(maybe)
    # A region has so many shared places within the length of a piece and its edits.
    reach, fewest = PIECE + int(ix.budget.max(initial=0)), int(ix.least.min(initial=PIECE))
    upto = np.cumsum(maybe, dtype=np.int32)
    end = upto[np.minimum(at + reach, len(every) - 1)] if len(at) else np.zeros(0, dtype=np.int32)
    begin = np.flatnonzero(end - np.arange(len(at)) >= fewest)
    cover = np.bincount(begin, minlength=len(at) + 1) - np.bincount(end[begin], minlength=len(at) + 1)
    at = at[np.cumsum(cover[:-1]) > 0]
    key = np.searchsorted(ix.keys, every[at])
    real = ix.keys[np.minimum(key, len(ix.keys) - 1)] == every[at]
    at, key = at[real], key[real]
    count = ix.first[key + 1] - ix.first[key]
    post = np.repeat(ix.first[key] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    owner, place = ix.owner[post], ix.place[post]
    longest = max(len(t) for t in ix.texts)
    diagonal = np.repeat(at, count) - place + longest  # not negative
    band = diagonal // (ix.budget[owner] + 1)
    # a diagonal belongs to the band that begins with its step and to the one before
    span = len(data) + longest + 2
    code = np.concatenate((owner * span + band, (owner * span + band - 1)[band > 0]))
    code = np.unique(code * longest + np.concatenate((place, place[band > 0])))
    code, place = code // longest, code % longest
    # the pieces from the first to the last of so many places that follow each other in a band
    least = ix.least[code // span]
    last = np.minimum(np.arange(len(code)) + least - 1, max(len(code) - 1, 0))
    near = (last == np.arange(len(code)) + least - 1) & (code[last] == code) & (place[last] - place <= ix.size[code // span] - Q)
    code, begin, end = code[near], place[near], place[last[near]]
    for these in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1):
        if not len(these):
            continue
        text, low = int(code[these[0]] // span), int(code[these[0]] % span)
        n, size = int(ix.size[text]), len(ix.texts[text])
        lows, highs = np.maximum(end[these] + Q - n, 0), np.minimum(begin[these], size - n)
        some = lows <= highs
        ends = np.bincount(lows[some], minlength=size + 1) - np.bincount(highs[some] + 1, minlength=size + 1)
        yield text, low * (int(ix.budget[text]) + 1) - longest, np.flatnonzero(np.cumsum(ends) > 0)


def aligned(item: bytes, starts: np.ndarray, size: int, text: bytes, lowest: int, edits: int) -> np.ndarray:
    """Fewest edits that turn each piece of ``item`` into a run of ``text`` around the diagonals
    lowest to lowest + 2 edits + 1: a banded alignment with free ends in the text.
    """
    steps = np.arange(4 * edits + 2)  # the band, and the edits to both sides
    columns = (starts + lowest - edits)[:, None] + steps  # what row 0 has read; column j stands for the first j bytes
    # bytes that match nothing around the text: to change one costs what it costs to drop a byte of the piece
    before = max(0, -int(columns.min()))
    p, t = np.frombuffer(item, np.uint8), np.full(before + max(len(text), int(columns.max()) + size) + 1, 256, dtype=np.int16)
    t[before + 1 : before + 1 + len(text)] = np.frombuffer(text, np.uint8)
    columns += before
    row = np.repeat(-steps[None, :].astype(np.int16), len(starts), axis=0)  # edits less the cell's number
    for i in range(size):
        # cell k stands for column columns[k] + i + 1 after reading byte i of the piece
        best = row + (t[columns + (i + 1)] != p[starts + i][:, None])
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 2)
        row = np.minimum.accumulate(best, axis=1)
    return (row + steps).min(axis=1)


def _leaked(item: bytes, starts: np.ndarray, size: int, text: bytes, lowest: int, edits: int) -> bool:
    """Whether any of the pieces is in the text within its edits; those in the middle are tried first."""
    starts = starts[np.argsort(np.abs(2 * np.arange(len(starts)) - len(starts)), kind="stable")]
    if item[starts[0] : starts[0] + size] in text:
        return True
    return any(
        (aligned(item, starts[k : k + ALIGNED], size, text, lowest, edits) <= edits).any() for k in range(0, len(starts), ALIGNED)
    )


def leaks(texts: pa.Array, ix: Index) -> list[list[int]]:
    """The items that each text leaks, ascending."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    out: list[list[int]] = [[] for _ in range(len(texts))]
    if not len(ix.keys):
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1, first + 1)
        found: dict[int, set[int]] = {}
        # a long text is cut into parts that overlap by more than a region
        begin = int(offsets[first])
        while begin < offsets[last]:
            stop = min(int(offsets[last]), begin + 2 * CHUNK)
            part, kept = normal(data[begin:stop])
            rows_at = np.searchsorted(offsets[first : last + 1], begin + np.flatnonzero(kept), side="right") - 1 + first
            for k, lowest, starts in _regions(part, ix):
                n, e, item = int(ix.size[k]), int(ix.budget[k]), int(ix.item[k])
                rows = rows_at[np.clip(starts + lowest + n // 2, 0, len(part) - 1)]
                for row in np.unique(rows):
                    if item in found.get(int(row), ()):
                        continue
                    mine = starts[rows == row]  # a region does not leave its text
                    lo = max(int(np.searchsorted(rows_at, row)), int(mine[0]) + lowest - e)
                    hi = min(int(np.searchsorted(rows_at, row, side="right")), int(mine[-1]) + lowest + n + 3 * e + 2)
                    if _leaked(ix.texts[k], mine, n, part[lo:hi].tobytes(), lowest - lo, e):
                        found.setdefault(int(row), set()).add(item)
            if stop == offsets[last]:
                break
            begin = stop - 4096
        for row, items in found.items():
            out[row] = sorted(items)
        first = last
    return out


def leaked_items(docs_text: Column, items: list[tuple[int, str | None]]) -> Column:
    """The items that a text leaks, as an array; for at most SLICE bytes of items."""
    ix = index(items)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(leaks(batch, ix), pa.list_(pa.int64()))

    return run(docs_text)


def slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in turns of about SLICE bytes each, so that neither the driver nor a task holds more."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    turns = size // SLICE + 1
    for turn in range(turns):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn)
        yield [(r.item_id, r.text) for r in mine.select("item_id", "text").distinct().collect()]


def mark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaks`` added (replacing such a column): the ids of the items in each text, ascending.

    Null and empty texts leak nothing. Items without id or of fewer than q bytes are
    not looked for; repeated items count once. No row is shuffled: the benchmark's index
    goes to the documents, a bounded part of it at a time.
    """
    keep = [f"`{c}`" for c in docs.columns if c.lower() != "leaks"]
    found = docs.select(*keep, F.array().cast("array<bigint>").alias("leaks"))
    for turn, items in enumerate(slices(benchmark)):
        new = leaked_items(F.col("text"), items)
        found = staged(found, "leaks") if turn else found
        found = found.select(*keep, new.alias("leaks") if not turn else F.array_sort(F.array_union("leaks", new)).alias("leaks"))
    return found


@query()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document leaks benchmark items, and which."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = mark_leaks(docs, table(spark, folder, "benchmark"))
    return marked.select("doc_id", "leaks").withColumn("leaked", F.size("leaks") > 0)
