"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import cut

#: Edges that a task holds at once, and that a task reads at least, where the edges are few for the number of partitions.
HELD = 1 << 20

#: Fewest edges of a hub, and most hubs: a node is one from ``max(HUB, 2 * edges / HUBS)`` edges on, so that their list is short at every size.
HUB, HUBS = 256, 1 << 16


def parts(n_edges: int) -> Column:
    """Over how many tasks the edges of one group are dealt."""
    return F.ceil(F.count(F.lit(1)) / max(HUB, 2 * n_edges // HUBS)).cast("int").alias("parts")


def dealt(edges: DataFrame, named: DataFrame) -> DataFrame:
    """``edges`` (``u``, ``v``) with the ``m`` that ``named`` (``u``, ``m``, ``parts``) has for ``u``.

    A hub's edges are dealt over several tasks by their other end, and its ``m`` is sent to each; at most ``HUBS`` numbers are broadcast.
    """
    hubs = F.broadcast(named.where("parts > 1").select("u", "parts"))
    some = edges.join(hubs, "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), "parts").cast("int"), F.lit(0))).select("u", "v", "part")
    return some.join(named.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["u", "part"]).select("u", "v", "m")


def both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def hung(edges: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` (``u``, ``v``) with ``m``, the smallest of each ``u`` and its ``v``."""
    return dealt(edges, edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), parts(n_edges)))


class Union:
    """Disjoint sets of array positions; a set's root is its smallest position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, up[up]):
            up = up[up]
        self.up = up
        return up[x]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u``, ``v`` as stars: some ``HELD`` at a time, each node of theirs on the smallest node that they link it to. Edges of one ``u`` in a row stay together."""

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        sets = Union(len(nodes))
        sets.link(place[: len(u)], place[len(u) :])
        root = sets.roots(np.arange(len(nodes)))
        hung = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        size += batch.num_rows
        if size > HELD:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            other = np.flatnonzero(u != u[-1])
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield star(u[:end], v[:end])
            held, size = [[u[end:], v[end:]]], len(u) - end
    if size:
        yield star(*(np.concatenate(x) for x in zip(*held, strict=True)))


def stars(edges: DataFrame) -> DataFrame:
    """A graph of the same components as ``edges`` (``u``, ``v``), all smaller neighbours of a node among those on one star; materialised.

    Before the shuffle a task has each node once, so that no node brings more rows to one task than there are tasks.
    """
    schema = "u long, v long"
    return cut(edges.mapInArrow(_stars, schema).repartition("u").sortWithinPartitions("u").mapInArrow(_stars, schema))


def leaves(edges: DataFrame) -> DataFrame:
    """The different ``edges`` (``u``, ``v``) with ``leaf``: ``v``, a smaller node, is all that ``u`` is linked to."""
    ends = both(edges).groupBy("u").agg(((F.min("v") == F.max("v")) & (F.max("v") < F.col("u"))).alias("leaf"))
    return edges.repartition("u").dropDuplicates(["u", "v"]).join(ends, "u").select("u", "v", "leaf")


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node that has an edge; nodes are numbers.

    Rounds of alternating stars: every node's neighbours are hung on the smallest of them, first the larger neighbours, then the
    smaller ones, these with all edges of a task at once. A round halves distances at least roughly, so that long chains take logarithmically many rounds; the smallest
    neighbour is a partial aggregate and the edges of a hub are dealt over tasks, so that a hub with millions of edges is never
    gathered. Nodes that are linked to one smaller node alone leave the graph, and with them every component that is one star: a round works on the
    edges that are still open, not on all. Rounds end when there are none; nodes that have left then get the root of the node they were linked to, the last first.
    Each round is cut off in the checkpoint folder, for recovery, and read by as many tasks as its edges are worth: each task of a shuffle leaves files, however few its rows.
    """
    e = stars(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v"))
    cores = e.sparkSession.sparkContext.defaultParallelism

    def few(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(max(cores, -(-n // HELD)))

    n, left = e.coalesce(cores).count(), []
    while True:
        marked = few(cut(few(leaves(few(e, n)), n)), n)
        left.append((marked.where("leaf").select("u", "v"), n))
        e = marked.where("not leaf").select("u", "v")
        n = e.count()
        if not n:
            break
        e = stars(hung(both(e), n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    roots = left.pop()[0].select(F.col("u").alias("node"), F.col("v").alias("root"))
    for gone, n in reversed(left):
        held = gone.select(F.col("v").alias("u"), F.col("u").alias("v"))
        named = held.groupBy("u").agg(parts(n)).join(roots, F.col("u") == F.col("node"), "left").select("u", F.coalesce("root", "u").alias("m"), "parts")
        roots = few(cut(few(roots.unionByName(dealt(held, named).select(F.col("v").alias("node"), F.col("m").alias("root"))), n)), n)
    return roots.unionByName(roots.select("root", "root").distinct().toDF("node", "root"))
