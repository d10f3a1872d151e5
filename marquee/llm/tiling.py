"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item that share a run of ``seed`` words are compared: again and again the longest run of words unmarked
in both is marked as a tile, found by Karp-Rabin hashes of growing window length, until no run of ``seed`` words is left. The share
of the item's words under tiles is its coverage; as tiles may lie anywhere in the text, reordered passages count in full.
Every word under a tile is under a shared seed, so an item whose shared seeds hold too few of its words is not tiled: a seed that
many items share costs a count, not a comparison with each of them.

The benchmark is broadcast in blocks of at most ``BLOCK_WORDS`` words, each block run against all texts, so that neither its size nor
the number of texts is bounded. A text is one row and never shuffled; it is looked at only where it shares a seed.

Words are runs of letters and digits, lower-cased. Defined cases: null and empty texts and items match nothing; an item shorter than a
seed is matched as a whole; of equally long runs the first in the item, then the first in the text is marked; repeated rows of
either table give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, rows_of, table, texts
from marquee.session import cut

SEED_WORDS = 4
COVERAGE = 0.6
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``k`` ids, by doubling: a window's hash joins those of its halves."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, power = (ids + 2).astype(np.uint64), 1, BASE
        out, done = np.zeros(n, np.uint64), 0
        while True:
            if k & width:
                out = out * power + h[done : done + n]
                done += width
            if done == k:
                return out
            h = h[: len(h) - width] * power + h[width:]
            width, power = 2 * width, power * power


def free_windows(free: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of ``k`` free places."""
    c = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(c[k:] - c[:-k] == k) if len(free) >= k else np.empty(0, np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of each ``lengths[i]``, joined."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def common(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, k: int) -> tuple[int, int] | None:
    """The first pair of equal free windows of ``k``."""
    at_a, at_b = free_windows(free_a, k), free_windows(free_b, k)
    if not len(at_a) or not len(at_b):
        return None
    ha, hb = window_hashes(a, k)[at_a], window_hashes(b, k)[at_b]
    shared = np.isin(ha, hb)
    for i, h in zip(at_a[shared], ha[shared], strict=True):
        for j in at_b[hb == h]:
            if np.array_equal(a[i : i + k], b[j : j + k]):
                return int(i), int(j)
    return None


def tile(a: np.ndarray, b: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length), longest first. Negative ids match nothing."""
    free_a, free_b = a >= 0, b >= 0
    tiles, most = [], min(len(a), len(b))
    while most >= seed:
        least, best = seed, common(a, b, free_a, free_b, seed)
        if best is None:
            break
        step = least
        while least < most:  # a common run of k words has one of k - 1: grow, then halve the gap
            k = min(most, least + step)
            found = common(a, b, free_a, free_b, k)
            if found is not None:
                least, best, step = k, found, step * 2
            elif step == 1 or k == least + 1:
                break
            else:
                most, step = k - 1, max(1, (k - least) // 2)
        i, j = best
        free_a[i : i + least] = free_b[j : j + least] = False
        tiles.append((i, j, least))
        most = least  # later tiles are no longer than this one
    return tiles


class Benchmark:
    """Items as word ids, and their seeds as sorted hashes for each seed length."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(ids):
                k = min(seed, len(ids))
                seeds.setdefault(k, []).append((*np.unique(window_hashes(ids, k), return_counts=True), len(self.items)))
                self.items.append((item_id, ids))
        self.n_words = np.array([len(ids) for _, ids in self.items], np.int64)
        self.seeds = {}
        for k, parts in seeds.items():
            h = np.concatenate([p for p, _, _ in parts])
            times = np.concatenate([c for _, c, _ in parts])
            item = np.concatenate([np.full(len(p), i) for p, _, i in parts])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = h[order], item[order], times[order]

    def compare(self, text: str, coverage: float = 0.0) -> Iterator[tuple[int, int, int, int]]:
        """(item number, words, tiles, words under tiles) of every item that shares a seed and may have ``coverage``.

        Items left out cannot have it: their shared seeds, each as often as the item holds it, have fewer words than that together.
        """
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        for k, (hashes, items, times) in self.seeds.items():
            starts = free_windows(ids >= 0, k)  # a window with a word of no item is no seed
            if not len(starts):
                continue
            h = window_hashes(ids, k)[starts]
            values, of = np.unique(h, return_inverse=True)
            lo, hi = np.searchsorted(hashes, values), np.searchsorted(hashes, values, side="right")
            entry = ranges(lo, hi - lo)
            if not len(entry):
                continue
            found, of_entry = np.unique(items[entry], return_inverse=True)
            may = k * np.bincount(of_entry, times[entry]) >= coverage * self.n_words[found]
            entry = np.sort(entry[may[of_entry]])
            if not len(entry):
                continue
            # only the seeds of items left are looked up at their places
            left_items = items[entry]
            lo, hi = (np.searchsorted(hashes[entry], values, side=side)[of] for side in ("left", "right"))
            place = np.repeat(starts, hi - lo)
            item = left_items[ranges(lo, hi - lo)]
            order = np.argsort(item, kind="stable")
            item, place = item[order], place[order]
            cuts = np.flatnonzero(np.diff(item)) + 1
            for number, at in zip(item[np.r_[0, cuts]], np.split(place, cuts), strict=True):
                a = self.items[number][1]
                tiles = tile(a, self.near(ids, at, k), k)
                yield int(number), len(a), len(tiles), sum(t[2] for t in tiles)

    @staticmethod
    def near(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The words under seed windows, with a gap between separate runs: all that can be under a tile."""
        under = np.zeros(len(ids) + 1, np.int8)
        under[(at[:, None] + np.arange(k)).ravel()] = 1
        begins = np.flatnonzero(np.diff(under, prepend=0) == 1)
        ends = np.flatnonzero(np.diff(under) == -1) + 1
        return np.concatenate([np.append(ids[i:j], -1) for i, j in zip(begins, ends, strict=True)])


def blocks(benchmark: DataFrame, seed: int, block_words: int) -> Iterator[Benchmark]:
    """The benchmark in parts of bounded size."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(words(r.text))
        if size >= block_words:
            yield Benchmark(held, seed)
            held, size = [], 0
    if held:
        yield Benchmark(held, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_words`` of the item, ``n_tiles``, ``n_covered``, ``coverage`` where that is at least ``coverage``."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("n_tiles", pa.int32()), ("n_covered", pa.int32()), ("coverage", pa.float64())])
    ddl = "doc_id long, item_id long, n_words int, n_tiles int, n_covered int, coverage double"

    def against(block: Benchmark) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most block_words words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            rows = ((doc_id, b.items[i][0], n, tiles, under, under / n) for doc_id, text in rows_of(batches) for i, n, tiles, under in b.compare(text, coverage) if under >= coverage * n)
            yield from in_batches(rows, schema)

        return texts(docs).mapInArrow(run, ddl)

    parts: list[DataFrame] = []
    for block in blocks(benchmark, seed, block_words):
        parts[-1:] = [cut(p) for p in parts[-1:]]  # of several blocks, each is finished before the next is held
        parts.append(against(block))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts cover no item."""
    spark, flag = docs.sparkSession, fresh(docs, "_covered")
    out = docs
    for block in blocks(benchmark, seed, block_words):
        shared = spark.sparkContext.broadcast(block)  # at most block_words words

        @F.pandas_udf("boolean")
        def covers(s, shared=shared):  # noqa: ANN001, ANN202
            return s.map(lambda t: any(under >= coverage * n for _, n, _, under in shared.value.compare(t or "", coverage)))

        out = out.withColumn(flag, covers(F.col("text").cast("string"))).where(~F.col(flag)).drop(flag)
    return out


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
