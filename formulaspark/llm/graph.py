"""Connected components of an edge table by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _forest(batches):
    """Edges of a task contracted: an edge from each node to the least of its tree."""
    parent: dict[int, int] = {}

    def find(n: int) -> int:
        root = n
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[n] != root:
            parent[n], n = root, parent[n]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(n) for n in list(parent)), np.int64, len(parent))
    for at in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000]), pa.array(roots[at : at + 50_000])], ["a", "b"])


def components(edges: DataFrame, task_edges: int = 1_000_000) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b`` long): the label is shared by
    exactly the nodes that paths connect.

    Up to ``task_edges`` edges one task unites them.  More are dealt to tasks of that size,
    each of which keeps only a forest; then, round by round, every node goes to the least of
    itself and its neighbours and the nodes merge.  Node ids should be hashes, so that in
    expectation a fixed share of the nodes goes per round.  Loops and repeated edges do no
    harm; null ends are left out.
    """
    edges = edges.select("a", "b").where("a <> b")
    n = edges.count()
    if n <= task_edges:
        return stored(edges.coalesce(1).mapInArrow(_forest, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label")), "components")
    edges = stored(edges.repartition(-(-n // task_edges)).mapInArrow(_forest, "a long, b long").where("a <> b").distinct(), "components-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        least = stored(least.select(F.col("a").alias("node"), "m"), "components-least")
        if labels is None:
            labels = least.select("node", F.col("m").alias("label"))
        else:
            step = least.select(F.col("node").alias("label"), "m")
            labels = labels.join(step, "label", "left").select("node", F.coalesce("m", "label").alias("label"))
            labels = stored(labels, "components-labels")
        from_a = least.select(F.col("node").alias("a"), F.col("m").alias("x"))
        from_b = least.select(F.col("node").alias("b"), F.col("m").alias("y"))
        merged = edges.join(from_a, "a").join(from_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(merged.where("a <> b").distinct(), "components-edges")
    return labels
