"""Connected components of a distributed graph, and links inside buckets of any size.

Components come from alternating large-star and small-star steps over an edge table. Each step is a
grouped minimum and a join, combined on the map side, written to the shared folder and read back; no
node's neighbours are collected. Buckets of candidates are compared in cells: a bucket with more than
``BLOCK`` rows is dealt into blocks, each pair of blocks is a cell of its own, and a cell returns links that
span its groups, not all its pairs. So no task holds a whole bucket and none emits its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.session import staged

BLOCK = 4096
SAMPLE = 16  # one node in so many is counted to find large buckets
LINKS = "a bigint, b bigint"


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a link (a, b).

    Rounds go on until the edges are separate stars. Links may repeat or join a node to itself.
    """
    edges = staged(_large_star(links.select("a", "b")), "links")
    while not _are_stars(edges):
        edges = staged(_large_star(_small_star(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"),
                                         F.lit(1).alias("down")))
    tangled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        F.col("up") + F.col("down") > 1)
    return tangled.isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to its smallest neighbour; rows are (larger, smaller)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node's smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


class Labels:
    """Smallest connected position for positions 0..n-1, merged in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.root[at]


def cells(members: DataFrame, sample: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members`` (bucket, node) with the ``cell`` in which they are compared.

    ``sample`` has all rows of about one node in ``SAMPLE``, by which large buckets are found. One
    that it misses is compared in a single cell, so the result does not depend on it.
    """
    counted = (sample.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") * SAMPLE > block)
               .select(F.col("bucket").alias("large"),
                       F.ceil(F.col("n") * SAMPLE / block).cast("int").alias("blocks")))
    large = staged(counted, "large")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(
        "bucket", F.least(j, own), F.greatest(j, own)))
    return (members.join(large, F.col("bucket") == F.col("large"), "left")
            .withColumn("cell", F.explode(F.when(F.col("large").isNull(), F.array("bucket"))
                                          .otherwise(others)))
            .select("cell", "node"))


def sorted_cells(batches: Iterator[pa.RecordBatch]
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A partition's rows (cell, node) by cell, without those that have a cell to themselves: the nodes,
    and per row its cell, the position of its node and the last row of its cell. The same node twice in
    a cell counts once."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return None
    cell, node = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(cell)  # most rows are alone, and only the others are worth a second sort
    cell, node = cell[order], node[order]
    shared = np.zeros(len(cell), bool)
    shared[1:] = cell[1:] == cell[:-1]
    shared[:-1] |= shared[1:]
    cell, node = cell[shared], node[shared]
    values, at = np.unique(node, return_inverse=True)
    order = np.lexsort((at, cell))
    cell, at = cell[order], at[order]
    once = np.ones(len(cell), bool)
    once[1:] = (cell[1:] != cell[:-1]) | (at[1:] != at[:-1])
    cell, at = cell[once], at[once]
    return values, cell, at, np.searchsorted(cell, cell, side="right") - 1


def linked_in_cells(compared: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray]
                    ) -> DataFrame:
    """Links (a, b) that join all nodes which are near in some cell; ``near`` compares arrays.

    A partition's rows (cell, node) are sorted by cell and compared at growing distance, as arrays;
    pairs that are already joined are skipped.
    """
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted_cells(batches)
        if rows is None:
            return
        values, cell, at, last = rows
        labels = Labels(len(values))
        first = np.flatnonzero(last > np.arange(len(cell)))
        step = 1
        while len(first):
            a, b = at[first], at[first + step]
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
            joined = near(values[a], values[b])
            labels.merge(a[joined], b[joined])
            step += 1
            first = first[first + step <= last[first]]
        moved = np.flatnonzero(labels.root != np.arange(len(values)))
        yield pa.record_batch([pa.array(values[moved]), pa.array(values[labels.root[moved]])],
                              names=["a", "b"])

    return compared.select("cell", "node").repartition("cell").mapInArrow(link, LINKS)
