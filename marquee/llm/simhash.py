"""SimHash near-duplicates by BK-trees.

Each text gets a 64-bit fingerprint of its word shingles. Two fingerprints within the radius agree on at least one of
radius + 1 bands of bits, so distinct fingerprints are sharded by (band, bits). Every shard is a BK-tree (a child's edge is its
integer Hamming distance to the parent), and a search follows only edges within the radius of the distance to the node.

A tree is sent to those who may need it, no further: the shards of a task are built and searched together as one forest, level
by level in arrays. A shard of more than ``SHARD`` fingerprints is cut into trees of at most so many, and each is sent
to every slice of the band's fingerprints, so that no task holds a hot band and what is sent at once stays bounded. A broadcast of all
trees to all tasks would grow with the corpus. Searches give links, of which each task keeps a spanning forest (never all
pairs of a group); connected components join the forests. Copies of a text are one fingerprint before any of this.

Defined cases: a null text is the empty one; a text without words has fingerprint zero; rows with a null id take part and do not name
a component unless it has no other ids; repeated rows come back as often as they were given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, rows_of, table, texts
from marquee.llm.components import Union, components
from marquee.session import cut

BITS = 64
#: Most fingerprints of a tree.
SHARD = 1024
#: Pairs of (query, node) worked on at once.
FRONTIER = 1_000_000
#: Shingles hashed at once.
HASHED = 200_000
SEED = 42


def fingerprint(text: str, words: int) -> int:
    """Bits set in over half of the XXH64 of the word shingles, repeats included; the ASCII words of the lower-cased text."""
    tokens = text.encode().lower().split()  # bytes: exactly A-Z, exactly the six white-space signs of ASCII
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    n = max(1, len(tokens) - words + 1)
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, HASHED):
        to = min(n, at + HASHED)
        h = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + min(words, len(tokens)) - 1 :], strict=False)], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (as a signed number) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(((i, signed(fingerprint(t, words))) for i, t in rows_of(batches)), schema)

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def fingerprint_udf(words: int = 3) -> Column:
    @F.pandas_udf("long")
    def fp(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: signed(fingerprint(t or "", words)))

    return fp


class Forest:
    """BK-trees of many shards. ``root``: the tree of each shard number; ``child[node, d]``: the child at distance d."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.child = np.full((n, BITS + 1), -1, np.int32)
        todo = np.arange(n)
        shards, first, group = np.unique(shard, return_index=True, return_inverse=True)
        self.shards, self.root = shards, first
        parent = first[group]
        todo = todo[parent != todo]
        parent = parent[todo]  # unique() gives the first of each shard
        while len(todo):
            far = np.bitwise_count(fp[todo] ^ fp[parent]).astype(np.int64)
            slot = parent.astype(np.int64) * (BITS + 1) + far
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            self.child.ravel()[slot[first]] = todo[first]
            parent, rest = todo[first][group], np.ones(len(todo), bool)
            rest[first] = False
            todo, parent = todo[rest], parent[rest]

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) within the radius, in pieces."""
        at = np.searchsorted(self.shards, shard)
        at = np.minimum(at, max(0, len(self.shards) - 1))
        query = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.empty(0, np.int64)
        stack = [(query, self.root[at[query]])]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            far = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield q[near], node[near]
            for step in range(-radius, radius + 1):
                edge = far + step
                ok = (edge >= 0) & (edge <= BITS)
                below = self.child[node[ok], edge[ok]]
                found = below >= 0
                if found.any():
                    stack.append((q[ok][found], below[found]))


def forest_links(rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in each group of shards. Rows: shard, fingerprint, role (1 tree, 2 query, 3 both)."""
    for shard, fp, role in rows:
        fp = fp.view(np.uint64)
        tree = np.flatnonzero(role & 1)
        ask = np.flatnonzero(role & 2)
        forest = Forest(shard[tree], fp[tree])
        values, place = np.unique(fp, return_inverse=True)
        sets = Union(len(values))
        for at in range(0, len(ask), size):
            part = ask[at : at + size]
            for q, node in forest.search(shard[part], fp[part], radius):
                sets.link(place[part[q]], place[tree[node]])
        root = sets.roots(np.arange(len(values)))
        linked = root != np.arange(len(values))
        yield values[linked].view(np.int64), values[root[linked]].view(np.int64)


def links(distinct: DataFrame, radius: int = 3, bands: int | None = None, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` that span all those within the radius."""
    bands = bands or radius + 1
    cuts = [BITS * i // bands for i in range(bands + 1)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftright(F.shiftleft("fp", BITS - hi), BITS - hi + lo).alias("bits")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
    ])).alias("k")).select("fp", "k.*")
    hot = keyed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("slices", F.ceil(F.col("n") / shard).cast("int"))
    keyed = keyed.join(hot.select("band", "bits", "slices"), ["band", "bits"])  # a fingerprint alone in a band links to none there
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    # a slice is tree for the slices after it and itself, and asks the trees before it
    dealt = keyed.withColumn("own", own).select("band", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("band", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp",
                         F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole shards, as many as make up some tens of thousands of rows; the rows come sorted by shard."""
        held: list[tuple] = []
        size = 0
        for b in batches:
            cols = [np.asarray(c) for c in b.columns]
            held.append(cols)
            size += b.num_rows
            if size > 40_000:
                s, f, r = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(s, s[-1]))
                if end:
                    yield s[:end], f[:end], r[:end]
                held, size = [[s[end:], f[end:], r[end:]]], len(s) - end
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in forest_links(groups(batches), radius, 4096):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def roots(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``fp``, ``root`` for distinct fingerprints of ``fps`` that link to another one."""
    distinct = fps.select("fp").distinct()
    return components(links(distinct, radius)).select(F.col("node").alias("fp"), "root")


def near_groups(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` (the smallest id reachable) of each row."""
    fps = cut(fingerprints(docs, words))
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))  # copies become one row before anything is joined
    tied = ids.join(roots(ids, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = tied.groupBy("root").agg(F.min("least").alias("component_id")).join(tied.select("fp", "root"), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """The row of the smallest id of each group of near copies, with all columns of ``docs``.

    Of rows with that id in the group, repeated ones or not, one stays; where no row of a group has an id, one stays.
    """
    fp, cid = fresh(docs, "_fp"), fresh(docs, "_component")
    ids = cut(fingerprints(docs, words).groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = ids.join(roots(ids, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # one fingerprint of each group holds its smallest id: only its rows are looked at
    kept = tied.groupBy("root").agg(F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp")).alias(fp), F.min("least").alias(cid))
    keep = docs.withColumn(fp, fingerprint_udf(words)(F.col("text").cast("string"))).join(kept.select(fp, cid), fp)
    return keep.where(F.col("doc_id").cast("long").eqNullSafe(F.col(cid))).dropDuplicates([fp]).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
