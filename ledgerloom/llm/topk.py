"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt to a few parts; a part's list ranks candidates by their share
of a query's inner product, and a cell (a group of queries, a group of candidates) has
its local lists. Phase 1 gathers the heads of all lists, completes their scores and
takes each query's k-th best as cutoff. A candidate below cutoff / parts in every list
cannot reach the cutoff, so phase 2, to which the cutoffs travel with their queries,
collects only entries at or above that uniform threshold. Phase 3 looks up what is
missing of these entries in the other lists, and of no others, and keeps the k best.

The lists are products of matrices and are made in both passes, as keeping them would
keep all pairs; no score but those of heads and collected entries is put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import cells
from ledgerloom.llm.common import staged, table
from ledgerloom.llm.registry import query

K = 20
#: Lists of a query. With more of them the threshold falls and more entries are collected.
PARTS = 2
#: Queries and candidates of a tile, for which the lists are in memory at once.
TILE = (512, 8192)
SCALE = 64

CODED = "vec_id long, asked boolean, dims int, data binary"
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector, and every component of it, is there and finite; as doubles in ``_v``."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.withColumn("_v", doubles).where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & fine)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(64 x) of every component, in the smallest type that holds the vector."""
    for batch in batches:
        rows = [cells.pack(np.floor(np.array(v, dtype=np.float64) * SCALE)) for v in batch.column("_v").to_pylist()]
        dims = pa.compute.list_value_length(batch.column("_v")).cast(pa.int32())
        columns = [batch.column("vec_id"), batch.column("asked"), dims, pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "asked", "dims", "data"])


def _lists(q: np.ndarray, c: np.ndarray, parts: int) -> list[np.ndarray]:
    """Each part's share of all inner products, exact: in floating point while that holds
    the integers, else in Python integers, which must fit in a long at the end."""
    cuts = np.linspace(0, q.shape[1], parts + 1).astype(int)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2.0**53:
        q, c = (m.astype(np.float32 if bound < 2.0**24 else np.float64, copy=False) for m in (q, c))
        return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    q, c = (np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (q, c))
    zero = np.zeros((len(q), len(c)), dtype=object)
    return [(q[:, a:b] @ c[:, a:b].T if b > a else zero).astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def heads(lists: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is among the k first of any list of its row, once each."""
    rows, n = lists[0].shape
    if n <= k:
        return tuple(x.ravel() for x in np.indices((rows, n)))
    tops = [np.argpartition(x, n - k, axis=1)[:, n - k :] for x in lists]
    places = np.unique(np.concatenate([(np.arange(rows)[:, None] * n + t).ravel() for t in tops]))
    return places // n, places % n


def collected(lists: list[np.ndarray], level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that reach the uniform threshold in any list of their row."""
    each = -(-level // len(lists))  # shares are integers: one reaches level / parts if it reaches this
    if lists[0].dtype.kind == "f":
        # Beyond all shares the comparison is decided either way, so it may be cut to what the type holds.
        edge = 2.0**24 if lists[0].dtype == np.float32 else 2.0**53
        each = np.clip(each, -edge, edge).astype(lists[0].dtype)
    return np.nonzero(np.logical_or.reduce([x >= each[:, None] for x in lists]))


def completed(lists: list[np.ndarray], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the given entries from their shares in all lists."""
    return sum(x[row, at].astype(np.int64) for x in lists)


def _search(parts: int, k: int, resolve: bool):
    """Work on a cell: phase 1, or with the cutoffs phases 2 and 3; at most k entries of each query."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        width = max(cells.width_of(asked), cells.width_of(held), 1)
        q = cells.vectors(asked, "data", width)
        q_ids, c_ids = (cells.number_column(x, "vec_id") for x in (asked, held))
        level = cells.number_column(asked, "cutoff") if resolve else None
        best = [np.empty(0, np.int64)] * 3
        for hi in range(0, held.num_rows, TILE[1]):
            c, ids = cells.vectors(held.slice(hi, TILE[1]), "data", width), c_ids[hi : hi + TILE[1]]
            found = [best]
            for lo in range(0, len(q), TILE[0]):
                a = slice(lo, lo + TILE[0])
                lists = _lists(q[a], c, parts)
                # One more head than k, as the query's own row tends to be the first of all.
                row, at = collected(lists, level[a]) if resolve else heads(lists, k + 1)
                score, row = completed(lists, row, at), row + lo
                fine = q_ids[row] != ids[at]
                if resolve:
                    fine &= score >= level[row]
                row, at, score = row[fine], at[fine], score[fine]
                own = cells.by_row(row, score, ids[at], k)
                found.append([row[own], ids[at[own]], score[own]])
            row, vec_id, score = (np.concatenate(x) for x in zip(*found, strict=True))
            own = cells.by_row(row, score, vec_id, k)
            best = [row[own], vec_id[own], score[own]]
        row, vec_id, score = best
        return pa.table([pa.array(x, pa.int64()) for x in (q_ids[row], vec_id, score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, parts: int = PARTS) -> DataFrame:
    """Each query's k best candidates: query_id, rank, vec_id, score.

    Both sides have vec_id and embedding. A query is no candidate of its own (rows
    with its id). Ties go to the smaller vec_id; repeated rows are candidates each.
    A query id repeated in the input is answered once, with any one of its rows.
    Vectors that are null or have null or non-finite components, and rows without
    id, take no part; empty tables give no rows. With fewer than k candidates all
    are returned. Vectors of different lengths meet as if padded with zeros.
    """
    def side(rows: DataFrame, asked: bool) -> DataFrame:
        return usable(rows).select("vec_id", F.lit(asked).alias("asked"), "_v")

    both = side(queries, True).dropDuplicates(["vec_id"]).unionByName(side(candidates, False))
    rows = cells.numbered(both.mapInArrow(_coded, CODED), "coded")
    counts = {r.asked: r["count"] for r in rows.groupBy("asked").count().collect()}
    asked, held = rows.where("asked"), rows.where("NOT asked")
    sizes = counts.get(True, 0), counts.get(False, 0)
    ranked = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    first = cells.meet(asked, held, _search(parts, k, resolve=False), FOUND, *sizes)
    kth = first.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k).where(F.col("_n") == k)
    kth = staged(kth.select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")), "cutoffs")
    # Without a cutoff too few heads are known, and every score counts.
    with_cut = asked.join(kth, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(1 - (1 << 63))))
    best = cells.meet(with_cut, held, _search(parts, k, resolve=True), FOUND, *sizes)
    rank = F.row_number().over(ranked).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


_ORACLE = f"""
    WITH v AS (
        SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS (SELECT vec_id, e, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
        FROM p AS q JOIN p AS c ON q.d = c.d WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) AS t WHERE r <= {K}"""


@query(_ORACLE)
def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best candidates of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)
