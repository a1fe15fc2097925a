"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import forget, written

#: Edges that a task joins to stars at a time.
EDGES = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node that they reach from it, nodes that are the smallest themselves left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's own edges as stars, EDGES or so at a time."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        size += batch.num_rows
        if size >= EDGES:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars around their smallest node: no node points to two, and none that is pointed to points on."""
    ends = edges.select(F.col("a").alias("node"), "b").union(edges.select("b", F.lit(None).cast("bigint")))
    seen = ends.groupBy("node").agg(F.count("*").alias("all"), F.count("b").alias("out"), F.min("b").alias("least"), F.max("b").alias("most"))
    return seen.where((F.col("least") != F.col("most")) | ((F.col("out") > 0) & (F.col("out") < F.col("all")))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node that links reach.

    Tasks join their own edges to stars first, so that rounds are left only for what spans tasks. Each round is a few
    exchanges of the edges, with minima combined before them; a node with many links is one
    row of the table of minima. Rounds grow with the logarithm of the longest chain. Every round is a written
    table, and so is the last, which ``forget`` takes. Nodes that link only to themselves are left out.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct()
    edges = written(pairs.mapInArrow(_joined, "a bigint, b bigint"), "edges")
    while not _settled(edges):
        before, edges = edges, written(_small_star(_large_star(edges).where("a != b").distinct()).where("a != b").distinct(), "edges")
        forget(before)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out.written_to = edges.written_to
    return out
