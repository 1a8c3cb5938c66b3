"""Nearest neighbours by a block matrix join of quantised vectors.

Every vector is scaled to length 1 and coded in int8 with a scale of its own; the
length of what the code leaves out is kept. Queries and candidates meet in cells,
there in tiles: the product of two int8 tiles gives all cosines up to a known error.
With u = s c + e and v = t d + f (code, remainder) the cosine u v differs from
s t c d by at most |s c||f| + |e||t d| + |e||f|. Pairs whose upper bound reaches the
k-th best known lower bound or score are recomputed in doubles on the original
vectors; a heap per query keeps the k best of a cell, and the heaps of all cells are
merged by a ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import cells
from ledgerloom.llm.common import table
from ledgerloom.llm.registry import query
from ledgerloom.llm.topk import usable

K = 5
#: Rows of a tile: queries, candidates.
TILE = 512, 2048
#: Pairs recomputed at once.
PAIRS = 1 << 15
LEVELS = 127

CODED = "vec_id long, asked boolean, dims int, code binary, scale double, coded double, rest double, exact binary"
FOUND = "query_id long, vec_id long, score double"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the int8 code of each vector, its scale, the length of the code and that of the remainder."""
    for batch in batches:
        made = {name: [] for name in ("vec_id", "asked", "dims", "code", "scale", "coded", "rest", "exact")}
        for vec_id, asked, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            v = np.array(values, dtype=np.float64)
            v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))  # a power of two: cosines stay the same to the last bit
            unit = v / np.sqrt((v * v).sum())
            scale = np.abs(unit).max() / LEVELS
            code = np.rint(unit / scale).astype(np.int8)
            near = code * scale
            row = (vec_id, asked, len(v), code.tobytes(), scale, np.sqrt((near * near).sum()), np.sqrt(((unit - near) ** 2).sum()), cells.pack(v))
            for name, value in zip(made, row, strict=True):
                made[name].append(value)
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True)], names=list(made))


def _cosines(q: np.ndarray, c: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines of pairs in doubles, summed from left to right, so that padding and company change nothing."""
    out = np.empty(len(row))
    total = lambda m: np.cumsum(m, axis=1)[:, -1]
    for lo in range(0, len(row), PAIRS):
        a, b = q[row[lo : lo + PAIRS]], c[at[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
    return out


class _Side:
    """One side of a cell as arrays."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.ids = cells.number_column(rows, "vec_id")
        # Sums of products of codes are whole numbers that this type holds exactly.
        small = width * LEVELS * LEVELS < 1 << 24
        self.code = cells.vectors(rows, "code", width, "i1").astype(np.float32 if small else np.float64)
        self.scale, self.coded, self.rest = (cells.number_column(rows, x, np.float64) for x in ("scale", "coded", "rest"))
        self.exact = cells.vectors(rows, "exact", width)


def survivors(q: _Side, c: _Side, a: slice, b: slice, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the pairs of a tile that can be among the k best; ``level`` is each query's k-th best score so far."""
    product = (q.code[a] @ c.code[b].T).astype(np.float64) * q.scale[a, None] * c.scale[b]
    error = q.coded[a, None] * c.rest[b] + q.rest[a, None] * (c.coded[b] + c.rest[b]) + 1e-12
    own = q.ids[a, None] == c.ids[b]
    low = np.where(own, -np.inf, product - error)
    if low.shape[1] > k:
        level = np.maximum(level, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    return np.nonzero((product + error >= level[:, None]) & ~own)


def _search(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        width = max(cells.width_of(asked), cells.width_of(held), 1)
        q, c = _Side(asked, width), _Side(held, width)
        heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
        level = np.full(len(q.ids), -np.inf)
        for hi in range(0, len(c.ids), TILE[1]):
            b = slice(hi, hi + TILE[1])
            for lo in range(0, len(q.ids), TILE[0]):
                a = slice(lo, lo + TILE[0])
                row, at = survivors(q, c, a, b, level[a], k)
                row, at = row + lo, at + hi
                score = _cosines(q.exact, c.exact, row, at)
                for i in cells.by_row(row, score, c.ids[at], k):
                    heap, entry = heaps[row[i]], (float(score[i]), -int(c.ids[at[i]]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == k:
                        level[row[i]] = heap[0][0]
        found = [(int(i), -n, s) for i, heap in zip(q.ids, heaps, strict=True) for s, n in heap]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """Each query's k candidates of largest cosine: query_id, rank, vec_id, score. Exact.

    Both sides have vec_id and embedding; other columns are ignored. A query is no
    candidate of its own (rows with its id). Ties go to the smaller vec_id; repeated
    rows are candidates each; a query id repeated in the input is answered once, with
    any one of its rows. Vectors that are null, empty, all zero or have null or
    non-finite components, and rows without id, take no part; empty tables give no
    rows. With fewer than k candidates all are returned. Vectors of different lengths
    meet as if padded with zeros.
    """
    def side(rows: DataFrame, asked: bool) -> DataFrame:
        some = usable(rows).where(F.exists("_v", lambda x: x != 0))
        return some.select("vec_id", F.lit(asked).alias("asked"), "_v")

    both = side(queries, True).dropDuplicates(["vec_id"]).unionByName(side(candidates, False))
    rows = cells.numbered(both.mapInArrow(_coded, CODED), "coded")
    counts = {r.asked: r["count"] for r in rows.groupBy("asked").count().collect()}
    asked, held = rows.where("asked"), rows.where("NOT asked")
    found = cells.meet(asked, held, _search(k), FOUND, counts.get(True, 0), counts.get(False, 0))
    ranked = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


_ORACLE = f"""
    WITH v AS (
        SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN embedding IF x <> 0]) > 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) AS t WHERE r <= {K}"""


@query(_ORACLE)
def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest rows, by cosine, of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 50 = 0"), vectors)
