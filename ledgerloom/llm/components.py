"""Connected components of links as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by one link from each node to the smallest node it reaches here."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int, root: dict[int, int] = root) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node it reaches.

    A node without links has no row. Repeated and reversed links change nothing. Each
    round takes the smallest label among the neighbours and then the label of the
    label, so the rounds grow with the logarithm of the longest path.
    """
    trees = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_forest, "a long, b long")
    both = trees.union(trees.select("b", "a")).distinct()
    edges = staged(both, "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = step.join(jump, F.col("next") == F.col("at")).select("node", "component", F.least("next", "far").alias("next"))
        step = staged(step, "labels")
        if step.where("next <> component").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", F.col("next").alias("component"))
