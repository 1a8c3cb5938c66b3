"""Queries against all rows in cells: bounded groups of either side meet in one task each.

Rows are dealt to groups by a number of their own, never by a key of the data, so no
key can make a group large. A side is repeated once for each group of the other side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

#: Most rows of either side in a cell, and the fewest to which the larger side is dealt for parallel work.
ASKED, HELD, FEWEST = 8192, 65536, 1024

Work = Callable[[pa.Table, pa.Table], pa.Table]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Stage rows with a number ``_n`` of their own, which stays the same in every later read."""
    return staged(rows.withColumn("_n", F.monotonically_increasing_id()), name)


def _group(groups: int, salt: int) -> F.Column:
    return F.pmod(F.xxhash64("_n", F.lit(salt)), F.lit(groups)).cast("int")


def meet(asked: DataFrame, held: DataFrame, work: Work, schema: str, n_asked: int, n_held: int) -> DataFrame:
    """Apply ``work`` to every pair of a group of ``asked`` and a group of ``held``, both with ``_n``.

    The counts set the number of groups; a cell holds about ASKED and HELD rows at most.
    """
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    size = min(HELD, max(FEWEST, math.ceil(n_held / (2 * tasks))))
    a, c = max(1, math.ceil(n_asked / ASKED)), max(1, math.ceil(n_held / size))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_a", _group(a, 1)).withColumn("_c", every(c))
    # Both sides may come from one table: columns of their own keep them apart.
    held = held.select(*[F.col(x).alias(x) for x in held.columns])
    right = held.withColumn("_c", _group(c, 2)).withColumn("_a", every(a))
    return left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInArrow(work, schema)


def number_column(table: pa.Table, name: str, dtype: type = np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(dtype, copy=False)


def vectors(table: pa.Table, name: str, width: int, dtype: str | None = None) -> np.ndarray:
    """Vectors kept as bytes, one row each, padded with zeros to ``width``.

    Without ``dtype`` the first byte of each row names it (see ``pack``).
    """
    out = np.zeros((table.num_rows, width), dtype=dtype or np.float64)
    for i, data in enumerate(table.column(name).to_pylist()):
        row = np.frombuffer(data, dtype) if dtype else np.frombuffer(data, chr(data[0]) + chr(data[1]), offset=2)
        out[i, : len(row)] = row
    return out


def pack(row: np.ndarray) -> bytes:
    """A vector of doubles as bytes of the smallest type that holds it exactly, named by two letters."""
    if (row == np.floor(row)).all():
        most = np.abs(row).max(initial=0)
        for kind in ("i1", "i2", "i4"):
            if most <= np.iinfo(kind).max:
                return kind.encode() + row.astype(kind).tobytes()
    small = row.astype(np.float32, copy=False) if np.abs(row).max(initial=0) < 3e38 else row
    kind = "f4" if small.dtype == np.float32 and (small == row).all() else "f8"
    return kind.encode() + row.astype(kind).tobytes()


def width_of(table: pa.Table) -> int:
    return int(pa.compute.max(table.column("dims")).as_py() or 0) if table.num_rows else 0


def by_row(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of every row: larger scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, row))
    ordered = row[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]
