"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.session import cut_lineage

#: Edges that a task holds at once (17 bytes each, and some arrays of that length); no more are left to the last task.
EDGES = 200_000

_EDGES = "a long, b long, open boolean"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The edges, up to ``EDGES`` of them at once."""
    held: list[pa.RecordBatch] = []
    for whole in batches:
        for start in range(0, len(whole), EDGES):
            batch = whole.slice(start, EDGES)
            if held and sum(map(len, held)) + len(batch) > EDGES:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as stars: each of its nodes with the smallest one that it reaches in the batch."""
    for batch in _gathered(batches):
        ends = np.concatenate([batch.column(k).to_numpy() for k in ("a", "b")])
        nodes, place = np.unique(ends, return_inverse=True)
        left, right = place[: len(batch)], place[len(batch) :]
        label, last = np.arange(len(nodes)), None
        while last is None or not np.array_equal(label, last):
            last = label
            low = np.minimum(last[left], last[right])
            label = last.copy()
            np.minimum.at(label, last[left], low)
            np.minimum.at(label, last[right], low)
            label = label[label]
        far = np.flatnonzero(label != np.arange(len(nodes)))
        still = bool(len(batch)) and bool(batch.column("open").to_numpy().any())
        columns = [pa.array(nodes[far], pa.int64()), pa.array(nodes[label[far]], pa.int64()), pa.array(np.full(len(far), still))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "open"])


def _written(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.mapInArrow(_stars, _EDGES))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of (a, b), both long, the smallest node that it reaches.

    The large star links every larger neighbour to a node's smallest one, the small star every
    smaller neighbour; both keep the components and never add edges. The steps grow with the
    logarithm of the longest path. Each step is one aggregate and one join: minima are taken
    map-side, so a node with many neighbours is no hot task, and adaptive execution splits the
    join. What a task writes it first shrinks to stars, batch by batch; an edge may so be
    written by several tasks, which minima do not mind. ``open`` marks what a node with a smaller
    neighbour and yet another one gave; without such nodes, the edges were stars already.
    As soon as ``EDGES`` or fewer are left, one task makes them stars, without shuffles: a step over few edges
    takes as many tasks as one over many.
    """
    current = _written(edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.lit(True).alias("open")))
    while current.count() > EDGES:
        for larger in (True, False):
            ways = F.array(F.struct(F.col("a").alias("of"), F.col("b")), F.struct(F.col("b").alias("of"), F.col("a").alias("b")))
            near = current.select(F.inline(ways)).groupBy("of").agg(F.min("b").alias("low"), F.max("b").alias("high"))
            if larger:
                joined = current.join(near, F.col("b") == F.col("of"))
                step = joined.select("a", F.least("of", "low").alias("b"), F.lit(True).alias("open"))
            else:
                joined = current.join(near, F.col("a") == F.col("of"))
                pairs = F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
                step = joined.select(F.inline(pairs), (F.col("low") != F.col("high")).alias("open"))
            current = _written(step)
        if current.where("open").isEmpty():
            break
    else:
        current = _written(current.coalesce(1))
    members = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    return current.select(F.inline(members)).distinct()
