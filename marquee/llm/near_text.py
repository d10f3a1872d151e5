"""Near copies by SimHash and BK-trees, checked by whole texts: sets of five-word shingles that share 0.8 or more.

Each text gets a 64-bit SimHash fingerprint of its set of shingles. Candidates are the pairs that a BK-tree search finds within ``RADIUS`` bits; each
is checked by its whole sets of shingles. Links are the pairs of likeness 0.8 or more, groups the connected components of the links. Two
texts of likeness 0.8 differ in some 10 of the bits; the search misses them with a probability below 0.000001 (0.000013 for the
smallest, 4 of 5 shingles), while of unlike texts it leaves out nine in ten.

No bands of the fingerprint shard such a radius. Trees are sharded by MinHash keys instead: ``BANDS`` keys of ``ROWS`` minima each, of which two texts of
likeness 0.8 share none with a probability of (1 - 0.8^5)^25 = 0.00005, more alike ones with less. Texts that share a key, directly or over
others, make a coarse component, found on the graph of texts and keys, so that no pairs are made of a key's texts. A component of more than
``SHARD`` texts or ``SHINGLES`` shingles is cut into slices, and each pair of slices is one shard; a task builds and searches the
trees of many shards at once and gives a spanning forest of the links. Copies of a text (same words) are one node before any of this.

Defined cases: a null text is the empty one; texts without words are copies of each other; a text of fewer words than a shingle is one shingle; rows
with a null id take part; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, rows_of, texts
from marquee.llm.components import Union, components
from marquee.llm.simhash import BITS, HASHED, SEED, Forest, signed
from marquee.session import cut

WORDS, LIKE = 5, 0.8
#: Bits by which the fingerprints of a candidate pair may differ.
RADIUS = 26
BANDS, ROWS = 25, 5
#: Most texts and shingles of a slice.
SHARD, SHINGLES = 1024, 400_000
#: Texts and shingles of the shards that a task searches at once (at least one shard), and queries at once.
HELD, HELD_SHINGLES, ASKED = 2048, 800_000, 256
#: Shingles whose minima are taken at once.
BLOCK = 2048
_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def tokens_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # as for the fingerprints: exactly A-Z, exactly the six white-space signs of ASCII


def node(text: str) -> int:
    """Number of a text: the XXH3 of its words."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(tokens_of(text)), SEED))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of a text's word shingles."""
    tokens = tokens_of(text)
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[:-1]]
    n = max(1, len(tokens) - words + 1)
    digest, parts = xxhash.xxh3_64_intdigest, []
    for at in range(0, n, HASHED):
        to = min(n, at + HASHED)
        parts.append(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + min(words, len(tokens)) - 1 :], strict=False)], np.uint64))
    return np.unique(np.concatenate(parts))


def keys(found: np.ndarray) -> list[int]:
    """A number for each band of minima."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), BLOCK):
        h = found[at : at + BLOCK, None] * _TIMES + _PLUS
        h ^= h >> np.uint64(32)  # the low bits of a product depend on low bits alone
        least = np.minimum(least, (h * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return [signed(xxhash.xxh3_64_intdigest(b.tobytes(), i)) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(found: np.ndarray) -> int:
    """Bits set in over half of the shingles' hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(found), BLOCK):
        count += np.unpackbits(found[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return signed(int(np.packbits(2 * count > len(found), bitorder="little").view("<u8")[0]))


def node_udf() -> Column:
    @F.pandas_udf("long")
    def number(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: node(t or ""))

    return number


def sketches(docs: DataFrame) -> DataFrame:
    """``node``, ``least`` (the smallest id), ``n`` (shingles), ``fp`` (fingerprint), ``keys`` of each different text."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                found = shingles(text)
                yield doc_id, node(text), len(found), fingerprint(found), keys(found)

        yield from in_batches(rows(), schema)

    made = texts(docs).mapInArrow(run, "doc_id long, node long, n int, fp long, keys array<long>")
    return cut(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))


def like_pairs(sets: list[np.ndarray], ask: np.ndarray, tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a text of ``ask``, one of ``tree``) of likeness ``LIKE`` or more, of all pairs."""
    checked = Checked(sets, tree)
    for a in ask:
        near = checked.like(a, tree[tree != a])
        if len(near):
            yield np.full(len(near), a), near


class Checked:
    """Whole sets of shingles of the texts ``tree``, to be compared with those of a text."""

    def __init__(self, sets: list[np.ndarray], tree: np.ndarray):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.zeros(len(sets), np.int64)
        self.start[tree] = np.concatenate([[0], np.cumsum(self.size[tree])])[:-1]
        self.names, flat = np.unique(np.concatenate([np.empty(0, np.uint64), *(sets[t] for t in tree)]), return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.mine = np.zeros(len(self.names), bool)

    def like(self, a: int, near: np.ndarray) -> np.ndarray:
        """Those of the texts ``near`` (of the tree) whose likeness to the text ``a`` is ``LIKE`` or more."""
        n = self.size[a]
        near = near[(5 * self.size[near] >= 4 * n) & (4 * self.size[near] <= 5 * n) & (self.size[near] > 0)]
        if not len(near):
            return near
        at = np.minimum(np.searchsorted(self.names, self.sets[a]), len(self.names) - 1)
        at = at[self.names[at] == self.sets[a]]
        self.mine[at] = True
        size = self.size[near]
        first = np.cumsum(size) - size
        places = np.repeat(self.start[near] - first, size) + np.arange(size.sum())
        shared = np.add.reduceat(self.mine[self.flat[places]], first, dtype=np.int64)
        self.mine[at] = False
        # shared / (all) >= 4/5, in whole numbers
        return near[5 * shared >= 4 * (n + size - shared)]


class Wide(Forest):
    """BK-trees whose search follows all of a node's edges within the radius at once, since a wide radius has many."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        super().__init__(shard, fp)
        child = self.child.ravel()
        self.kids = child[child >= 0]  # by node, then by edge
        self.before = np.concatenate([[0], np.cumsum(child >= 0)])

    def search(self, shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.minimum(np.searchsorted(self.shards, shard), max(0, len(self.shards) - 1))
        q = np.flatnonzero(self.shards[at] == shard) if len(self.shards) else np.empty(0, np.int64)
        node = self.root[at[q]] if len(q) else q
        while len(q):
            far = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = far <= radius
            yield q[near], node[near]
            edge = node.astype(np.int64) * (BITS + 1)
            lo = self.before[edge + np.maximum(0, far - radius)]
            n = self.before[edge + np.minimum(BITS, far + radius) + 1] - lo
            node = self.kids[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            q = np.repeat(q, n)


def shard_links(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in each of some shards. Rows: shard, node, role (1 tree, 2 query, 3 both), fingerprint, shingles."""
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    shard, role, fp = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))
    fp = fp.view(np.uint64)
    ask, tree = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    forest, checked, joined = Wide(shard[tree], fp[tree]), Checked(sets, tree), Union(len(rows))
    for at in range(0, len(ask), ASKED):
        part = ask[at : at + ASKED]
        found = list(forest.search(shard[part], fp[part], RADIUS))
        if not found:
            continue
        q, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(q, kind="stable")
        q, near = q[order], tree[place[order]]
        which, begin = np.unique(q, return_index=True)
        for a, lo, hi in zip(part[which], begin, [*begin[1:], len(q)], strict=True):
            some = near[lo:hi]
            up = joined.roots(np.append(some, a))
            some = checked.like(a, some[up[:-1] != up[-1]])  # what is linked already needs no further link
            joined.link(np.full(len(some), a), some)
    root = joined.roots(np.arange(len(rows)))
    for i in np.flatnonzero(root != np.arange(len(rows))):
        yield rows[i][1], rows[root[i]][1]


def links(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between different texts that span all candidate pairs of likeness ``LIKE`` or more."""
    edges = ids.select("node", F.explode("keys").alias("key"))
    shared = edges.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    coarse = components(edges.join(shared, "key").select(F.col("node").alias("a"), F.col("key").alias("b")))
    coarse = cut(ids.select("node", "least", "n", "fp").join(coarse.select("node", "root"), "node"))
    sizes = coarse.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / SHARD, F.sum("n") / SHINGLES)).cast("int").alias("slices"))
    asked = coarse.join(sizes, "root").select("node", "least", "fp", "root", "slices")
    x = texts(docs).withColumn("node", node_udf()("text")).alias("x")
    a = asked.alias("a")
    # by number and id, so that the copies of one text are not gathered
    some = (x.join(a, (F.col("x.node") == F.col("a.node")) & F.col("x.doc_id").eqNullSafe(F.col("a.least")))
            .select("a.node", "a.fp", "a.root", "a.slices", "x.text").dropDuplicates(["node"]))

    @F.pandas_udf("binary")
    def packed(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: shingles(t).tobytes())

    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # a slice is tree for the slices after it and itself, and asks the trees before it
    dealt = some.select("node", "fp", "root", own.alias("own"), "slices", packed("text").alias("set")).select(
        "node", "fp", "root", "own", "set", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "node",
                         F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"), "fp", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            held: list[tuple] = []
            size = 0
            for row in rows_of(batches):
                if held and held[-1][0] != row[0] and (len(held) >= HELD or size >= 8 * HELD_SHINGLES):
                    yield from shard_links(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
            if held:
                yield from shard_links(held)

        yield from in_batches(found(), schema)

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def drop_near_texts(docs: DataFrame) -> DataFrame:
    """The row of the smallest id of each group of near copies, with all columns of ``docs``.

    Of rows with that id in the group, repeated ones or not, one stays; where no row of a group has an id, one stays.
    """
    number, cid = fresh(docs, "_node"), fresh(docs, "_least")
    ids = sketches(docs)
    tied = ids.select("node", "least").join(components(links(docs, ids)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = tied.groupBy("root").agg(F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("n"), F.min("least").alias("i"))
    x = docs.withColumn(number, node_udf()(F.col("text").cast("string"))).withColumn(cid, F.col("doc_id").cast("long"))
    k = kept.select(F.col("n").alias(fresh(docs, "_kept_node")), F.col("i").alias(fresh(docs, "_kept_least")))
    keep = x.join(k, (x[number] == k[k.columns[0]]) & x[cid].eqNullSafe(k[k.columns[1]]))
    return keep.dropDuplicates([number]).select(*docs.columns)
