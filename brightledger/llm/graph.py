"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.tables import settled


#: Edges that a task unites at a time.
HELD_EDGES = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of edges, one edge from the least node of every component to
    each of its other nodes."""

    def close(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        at = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[at[0]], label[at[1]])
            new = label.copy()
            for side in at:
                np.minimum.at(new, side, least)
            # Also the labels of labels, so long chains halve.
            np.minimum.at(new, label, new.copy())
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
        size += batch.num_rows
        if size >= HELD_EDGES:
            yield close(held)
            held, size = [], 0
    if size:
        yield close(held)


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of the given ones, about one for each
    node: those of a task are united first, then those that reach a node from
    several tasks, which meet in one. A hot node costs one edge a task."""
    once = edges.select("a", "b").where("a <> b").mapInArrow(_united, "a long, b long")
    return once.repartition("b").mapInArrow(_united, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b), the label being the
    least node reachable. Edges may repeat, in either direction.

    Each round every node takes the least label among its neighbours, and then
    the label of its label, so long chains halve. Hot nodes are summed before
    they are shuffled, and what they are joined with is a table of its own, so
    skewed joins are split. Rounds end when no label changes; each leaves its
    table in the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settled(both, "edges")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        step = settled(step, "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = settled(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels
