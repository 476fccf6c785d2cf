"""Graph operators on edge tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def _cut(df: DataFrame) -> DataFrame:
    """checkpoint() into spark.checkpoint.dir; a folder of this machine only where none is set in a local session."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="cellweave-"))
    return df.checkpoint()


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges a-b connect it with."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if np.array_equal(low, high):
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, up := label[label]):
            label = up


#: Edges that a task contracts at a time.
AT_ONCE = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each task replaces its own, AT_ONCE at a time, by stars around the smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            names, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
            root = merged(len(names), at[: len(t)], at[len(t) :])
            leaf = np.flatnonzero(root != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[leaf]), pa.array(names[root[leaf]])], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                yield flush()
                held = []
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node) with component, its smallest reachable node. Each round takes the smallest label among a node's
    neighbours, hands it to the node that its old label names, and then takes that label's own label, so that whole trees merge
    and chains shorten by jumps: a number of rounds that grows with the logarithm of the longest path. Integer nodes are contracted in the tasks first."""
    if edges.schema["a"].dataType == edges.schema["b"].dataType == LongType():
        edges = contracted(edges)
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    if both.isEmpty():
        return labels
    labels = _cut(labels)
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = labels.join(seen, "node", "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        hook = step.groupBy(F.col("component").alias("node")).agg(F.min("low").alias("hook"))
        step = step.join(hook, "node", "left").select("node", "component", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = step.join(jump, "low", "left").select("node", "component", F.least("low", F.coalesce("far", "low")).alias("new"))
        step = _cut(step)
        changed = not step.filter("new <> component").isEmpty()
        labels = step.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
