"""Connected components: edges are contracted to stars where they lie, then large-star and small-star steps shuffle what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import Scratch

#: Edges that a task contracts at a time, whatever the size of its partition.
CHUNK = 500_000
EDGES = "a long, b long"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least one of its component, that one's own left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[i] != root[j]).any():
        x, y = root[i], root[j]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    child = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[child], nodes[root[child]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b that connect the same nodes as edges(a, b): each task's are stars. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            a, b = (table.column(k).to_numpy() for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(a, b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield out()
                held = []
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, EDGES)


def _least(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with the least of u and its neighbours as m. The least ones are written, so that a join can split a node with very many neighbours."""
    least = scratch.written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that can be reached.

    Self-edges and repeated edges don't matter. Nodes are longs without nulls. Each step is written to the shared
    folder, so that a lost executor costs one step at most, and deleted after the next; the last one stays, as one of
    scratch if given. The graph never leaves the executors.
    """
    spark = edges.sparkSession
    done = Scratch(spark)
    now = done.written(contracted(edges.where("a <> b")), "edges")
    while True:
        # stars everywhere: no node has two roots, and no root has a root itself
        two = now.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y")
        if two.isEmpty() and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            if scratch:
                scratch.paths += done.paths
            break
        step = Scratch(spark)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = step.written(_least(step, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        # of each node's smaller neighbours, all and the node itself go to the least
        small = _least(step, large)
        after = Scratch(spark)
        now = after.written(contracted(small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")), "edges")
        step.drop()
        done.drop()
        done = after
    now = now.distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
