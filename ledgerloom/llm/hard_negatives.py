"""Hard negatives by length buckets and ranges of focus coordinates.

In a cell the rows lie in buckets of similar length, longest first, each with a sorted
list of values per coordinate (of the rows scaled to length 1). To reach a score t
with an anchor of length q, a row of a bucket with greatest length l needs a cosine of
theta = t / (q l) at least: a bucket with theta > 1 is skipped, and in the others
every focus coordinate (those where the anchor is largest) must lie in a range
around theta times the anchor's value. The rows of all ranges of an anchor are
intersected, and only those are verified, by exact integer inner products.

The score t is each anchor's k-th best score so far. It begins with what a bounded
sample of rows gives, so that it is high before the first bucket; the sample decides
no result. Two searches are made: the positives of each anchor, and for each of
these the best rows of other labels in its window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import cells
from ledgerloom.llm.common import staged, table
from ledgerloom.llm.registry import query
from ledgerloom.llm.topk import usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these hundredths of its positive's score.
WINDOW = 50, 95
#: Rows of a length bucket, coordinates in focus, anchors worked on at once, rows of the sample (about).
BUCKET, FOCUS, ANCHORS, SAMPLE = 4096, 5, 256, 4096

#: Below all scores; what no score can be.
_NONE = np.iinfo(np.int64).min
FOUND = "anchor_id long, place int, vec_id long, score long"


def _whole(table: pa.Table, width: int) -> np.ndarray:
    """The integer vectors: in doubles while all inner products of the cell are exact there, else Python integers."""
    return cells.vectors(table, "data", width)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; those beyond a long become its limits."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2.0**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    q, c = (np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (q, c))
    limits = np.iinfo(np.int64)
    return np.array([[min(max(int(sum(x * y)), limits.min + 1), limits.max) for y in c] for x in q], dtype=np.int64).reshape(len(q), len(c))


class Bucket:
    """Rows of similar length with their sorted coordinate lists."""

    def __init__(self, data: np.ndarray, length: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.data, self.ids, self.labels = data, ids, labels
        self.longest = float(length.max())
        unit = data / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T
        self.values = np.take_along_axis(unit, self.order.T, axis=0).T

    def feasible(self, unit: np.ndarray, theta: float) -> np.ndarray | None:
        """Places of the rows whose focus coordinates all allow a cosine of ``theta``; None for all rows."""
        n = len(self.ids)
        if theta <= 0:
            return None
        if theta > 1 + 1e-9:
            return np.zeros(0, dtype=np.int64)
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            x = unit[f]
            half = np.sqrt(max(1 - theta * theta, 0.0) * max(1 - x * x, 0.0)) + 1e-9
            low = -1.0 if -x > theta else x * theta - half
            high = 1.0 if x > theta else x * theta + half
            a, b = np.searchsorted(self.values[f], low, "left"), np.searchsorted(self.values[f], high, "right")
            ranges.append((b - a, f, a, b))
        ranges.sort(key=lambda r: r[0])
        if ranges[0][0] > n // 2:
            return None  # no list is selective here: cheaper to verify the whole bucket
        hits = np.zeros(n, dtype=np.int8)
        for _, f, a, b in ranges:
            hits[self.order[f, a:b]] += 1
        return np.flatnonzero(hits == len(ranges))


def buckets(rows: pa.Table, width: int) -> list[Bucket]:
    """The rows of a cell, longest first, in buckets of at most BUCKET rows."""
    data, ids, labels = cells.vectors(rows, "data", width), cells.number_column(rows, "vec_id"), cells.number_column(rows, "label")
    # Lengths are safe from overflow: by the largest component first.
    most = np.abs(data).max(axis=1, initial=0)
    length = most * np.sqrt(((data / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    return [Bucket(data[p], length[p], ids[p], labels[p]) for p in (order[i : i + BUCKET] for i in range(0, len(order), BUCKET))]


class Asked:
    """Anchors of a cell: vector, label and the windows of scores that are searched for each."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.ids, self.labels = cells.number_column(rows, "vec_id"), cells.number_column(rows, "label")
        self.data = cells.vectors(rows, "data", width)
        most = np.abs(self.data).max(axis=1, initial=0)
        self.length = most * np.sqrt(((self.data / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
        self.unit = self.data / np.where(self.length > 0, self.length, 1)[:, None]
        windows = rows.column("windows").to_pylist()
        places = max((len(w) for w in windows), default=0)
        shape = (len(windows), places)
        # An absent window holds no score: its low end is above its high end.
        self.low, self.high, self.level = np.full(shape, 1), np.full(shape, 0), np.full(shape, np.iinfo(np.int64).max)
        for i, w in enumerate(windows):
            for j, x in enumerate(w):
                self.low[i, j], self.high[i, j], self.level[i, j] = x["low"], x["high"], x["level"]


def _threshold(asked: Asked) -> np.ndarray:
    """Scores below this can be in no window's best of an anchor."""
    return np.maximum(asked.low, asked.level).min(axis=1, initial=np.iinfo(np.int64).max)


def verified(asked: Asked, part: slice, bucket: Bucket, same: bool) -> tuple[np.ndarray, int]:
    """Scores of the anchors of a part with the rows of a bucket, and how many were computed; others hold _NONE."""
    n = len(bucket.ids)
    scores = np.full((part.stop - part.start, n), _NONE)
    needed = _threshold(asked)[part]
    whole, done = [], 0
    for i, t in enumerate(needed):
        at = part.start + i
        reach = asked.length[at] * bucket.longest
        # A window above all scores is never met; with t <= 0 nothing can be left out.
        theta = 0.0 if t <= 0 else (float(t) / reach if reach > 0 else 2.0)
        found = bucket.feasible(asked.unit[at], theta)
        if found is None:
            whole.append(i)
        elif len(found):
            scores[i, found] = _products(asked.data[at : at + 1], bucket.data[found])[0]
            done += len(found)
    if whole:
        scores[whole] = _products(asked.data[part][whole], bucket.data)
        done += len(whole) * n
    fits = (asked.labels[part, None] == bucket.labels) == same
    scores[~fits | (asked.ids[part, None] == bucket.ids)] = _NONE
    return scores, done


def _search(k: int, same: bool):
    """In a cell, the k best scores of every window of every anchor, among rows of the same label or of others."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = max(cells.width_of(anchors), cells.width_of(rows), 1)
        asked, found = Asked(anchors, width), []
        for bucket in buckets(rows, width) if len(asked.ids) else ():
            for lo in range(0, len(asked.ids), ANCHORS):
                part = slice(lo, min(lo + ANCHORS, len(asked.ids)))
                scores, _ = verified(asked, part, bucket, same)
                for j in range(asked.low.shape[1]):
                    least = np.maximum(asked.low[part, j], asked.level[part, j])
                    fits = (scores >= least[:, None]) & (scores <= asked.high[part, j, None]) & (scores > _NONE)
                    if scores.shape[1] > k:
                        best = np.partition(np.where(fits, scores, _NONE), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                        fits &= scores >= best[:, None]
                        asked.level[part, j] = np.maximum(asked.level[part, j], best)
                    row, at = np.nonzero(fits)
                    keep = cells.by_row(row, scores[row, at], bucket.ids[at], k)
                    row, at = row[keep], at[keep]
                    found.append((asked.ids[row + lo], np.full(len(row), j), bucket.ids[at], scores[row, at]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, dtype=np.int64)] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor_id", "place", "vec_id", "score"])

    return run


def _packed(batches):
    """Vectors as bytes of their integers, floor(SCALE x)."""
    for batch in batches:
        lists = batch.column(4).to_pylist()
        data = [cells.pack(np.floor(np.array(v, dtype=np.float64) * SCALE)) for v in lists]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(data, pa.binary())], names=["vec_id", "label", "asked", "dims", "data"]
        )


def _best(anchors: DataFrame, rows: DataFrame, k: int, same: bool, counts: tuple[int, int]) -> DataFrame:
    """anchor_id, place of the window, rank, vec_id, score."""
    found = cells.meet(anchors, rows, _search(k, same), FOUND, *counts)
    ranked = W.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _levels(found: DataFrame, k: int) -> DataFrame:
    """The k-th best score of a window, where there are so many."""
    return found.where(F.col("rank") == k).select("anchor_id", "place", F.col("score").alias("level"))


def _windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Give the anchors their windows (anchor_id, place, low, high, level), a few for each."""
    listed = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high", "level"))).alias("windows"))
    return anchors.drop("windows").join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id")


def hard_negatives(
    vectors: DataFrame, is_anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Exact.

    ``vectors`` has vec_id, embedding and a whole-number label; other columns are
    ignored. The score is the inner product of floor(256 x). An anchor's positives are
    its best other rows (rows of another id) of the same label; a positive's negatives
    are the best rows of other labels whose score lies in the window, in hundredths of
    the positive's score (none for a negative one). Ties go to the smaller vec_id;
    repeated rows count each, as positives too; an anchor id repeated in the input is
    answered once, with any one of its rows. Rows without id or label, and vectors that
    are null or have null or non-finite components, take no part; vectors of different
    lengths meet as if padded with zeros, empty ones score 0. Empty tables give no
    rows. Scores beyond a long count as its limits.
    """
    rows = usable(vectors.where(F.col("label").isNotNull()).withColumn("_is_anchor", is_anchor))
    fields = ["vec_id", F.col("label").cast("long").alias("label"), "asked", F.size("_v").alias("dims"), "_v"]
    asked = rows.where("_is_anchor").dropDuplicates(["vec_id"]).withColumn("asked", F.lit(True))
    both = asked.select(*fields).unionByName(rows.withColumn("asked", F.lit(False)).select(*fields))
    both = cells.numbered(both.mapInArrow(_packed, "vec_id long, label long, asked boolean, dims int, data binary"), "labelled")
    by = {r.asked: r["count"] for r in both.groupBy("asked").count().collect()}
    counts = by.get(True, 0), by.get(False, 0)
    held = both.where("NOT asked")
    shares = max(1, counts[1] // SAMPLE)
    sample = held.where(F.pmod(F.xxhash64("_n", F.lit(3)), F.lit(shares)) == 0)
    sampled = counts[0], min(counts[1], 2 * SAMPLE)

    # One open window for each anchor; its level comes from the sample.
    limits = np.iinfo(np.int64)
    any_score = F.struct(F.lit(0).alias("place"), *(F.lit(int(x)).cast("long").alias(n) for x, n in ((limits.min + 1, "low"), (limits.max, "high"), (limits.min + 1, "level"))))
    anchors = both.where("asked").withColumn("windows", F.array(any_score))
    seen = _levels(_best(anchors, sample, positives, True, sampled), positives)
    open_ = anchors.select(F.col("vec_id").alias("anchor_id"), F.inline("windows"))
    raised = open_.drop("level").join(seen, ["anchor_id", "place"], "left").fillna(int(limits.min + 1), ["level"])
    found = staged(_best(_windows(anchors, raised), held, positives, True, counts), "positives")

    # One window for each positive; those that hold no score are left out.
    least, most = (F.lit(x).cast("decimal(38,0)") * F.col("score") for x in window)
    bounds = found.select(
        "anchor_id", F.col("rank").alias("place"), F.ceil(least / 100).cast("long").alias("low"), F.floor(most / 100).cast("long").alias("high"),
        F.lit(int(limits.min + 1)).cast("long").alias("level"),
    ).where("low <= high")
    ordered = W.partitionBy("anchor_id").orderBy("place")
    bounds = bounds.withColumn("nth", F.col("place")).withColumn("place", F.row_number().over(ordered) - 1)
    bounds = staged(bounds, "windows")
    seen = _levels(_best(_windows(anchors, bounds), sample, negatives, False, sampled), negatives)
    raised = bounds.drop("level").join(seen, ["anchor_id", "place"], "left").fillna(int(limits.min + 1), ["level"])
    best = _best(_windows(anchors, raised), held, negatives, False, counts)
    named = best.join(bounds.select("anchor_id", "place", "nth"), ["anchor_id", "place"])
    pairs = found.select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(pairs, ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


_ORACLE = f"""
    WITH v AS (
        SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
               [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
    s AS (
        SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(sum(q.x * c.x) AS BIGINT) AS score
        FROM p AS q JOIN p AS c ON q.d = c.d WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        GROUP BY q.vec_id, c.vec_id, q.label, c.label),
    pos AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) AS t
        WHERE r <= {POSITIVES}),
    neg AS (
        SELECT pos.anchor_id, pos.vec_id AS positive_id, s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY pos.anchor_id, pos.r ORDER BY s.score DESC, s.vec_id) AS n
        FROM pos JOIN s ON s.anchor_id = pos.anchor_id AND NOT s.same
             AND {WINDOW[0]} * pos.score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * pos.score)
    SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM neg WHERE n <= {NEGATIVES}"""


@query(_ORACLE)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)
