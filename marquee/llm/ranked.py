"""Ranked lexical search of many queries at once: shared parts of the queries are summed once for each document.

Queries are sets of terms. Terms that the same queries hold are one class. A query is then a sequence of classes, those of most queries first, and neighbours that
two sequences or more share become a node, round by round, until nothing is shared: a graph whose leaves are classes and whose ends are the
queries. For a block of documents the weights of a class's terms are added up once, each node once from its two parts, and each query from the few
nodes that are left of it. Scores are whole numbers, so the order of adding does not matter.

Documents are read once into rows of their length and their counts of query terms (a few bytes for each), written to the checkpoint folder;
number of documents, total length and document frequencies are sums over those. A task keeps the ``k`` best documents of each query that it has seen, and the best of all
tasks are ranked by a window that drops rows before it shuffles. No document list of a term and no list of matches is ever built.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms, so that what is broadcast stays bounded (by that, or by one query); each further block reads the documents
once more. Defined cases: a null text has no terms; a query without terms, or whose terms no document holds, has no rows; rows of one
``item_id`` (also the null one) are one query of all their terms; repeated documents are ranked each; a null ``doc_id`` comes last among equal scores.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import in_batches, rows_of, table
from marquee.session import cut

BEST = 50
BLOCK_TERMS = 100_000
CELLS = 2_000_000
LONG_TEXT = 4_000_000
#: Bytes of terms (A-Z lower-cased; all of signs beyond ASCII), and spaces for all others.
FOLD = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256)).lower()
FOUND = "doc_id long, size long, terms binary, times binary"
TOP = "item int, doc_id long, score long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length."""
    folded = text.encode().translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + LONG_TEXT) if len(folded) - at > LONG_TEXT else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Queries:
    """Queries as sets of term numbers, and the graph over them."""

    def __init__(self, items: list[tuple[int | None, set[bytes]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        held: list[list[int]] = []
        for number, (_, terms) in enumerate(items):
            for t in sorted(terms):
                at = self.vocabulary.setdefault(t, len(held))
                if at == len(held):
                    held.append([])
                held[at].append(number)
        classes: dict[tuple[int, ...], int] = {}
        for holders in sorted(map(tuple, held), key=lambda h: (-len(h), h)):
            classes.setdefault(holders, len(classes))
        self.class_of = np.array([classes[tuple(h)] for h in held], np.int64)
        self.leaves = len(classes)
        sequences: list[list[int]] = [[] for _ in items]
        for holders, c in classes.items():
            for q in holders:
                sequences[q].append(c)
        self.nodes, self.sequences = share(sequences, self.leaves)


def share(sequences: list[list[int]], leaves: int) -> tuple[list[list[tuple[int, int, int]]], list[list[int]]]:
    """Levels of nodes (number, left, right), and the sequences with shared neighbours replaced by nodes until none are shared."""
    levels: list[list[tuple[int, int, int]]] = []
    number = leaves
    while True:
        counts = Counter(p for s in sequences for p in set(itertools.pairwise(s)))
        made: dict[tuple[int, int], int] = {}
        out = []
        for s in sequences:
            row, i = [], 0
            while i < len(s):
                pair = (s[i], s[i + 1]) if i + 1 < len(s) else None
                ahead = counts[s[i + 1], s[i + 2]] if i + 2 < len(s) else 0
                if pair and counts[pair] > 1 and counts[pair] >= ahead:
                    if pair not in made:
                        made[pair] = number
                        number += 1
                    row.append(made[pair])
                    i += 2
                else:
                    row.append(s[i])
                    i += 1
            out.append(row)
        if not made:
            return levels, sequences
        sequences = out
        levels.append([(n, a, b) for (a, b), n in made.items()])


class Evaluation:
    """Scores of blocks of documents along the graph."""

    def __init__(self, queries: Queries, weight: np.ndarray, number: int, total: int):
        self.queries, self.weight, self.number, self.total = queries, weight, number, total
        self.size = queries.leaves + sum(map(len, queries.nodes))
        self.levels = [np.array(level, np.int64).T for level in queries.nodes]
        lengths = [len(s) for s in queries.sequences]
        self.some = np.flatnonzero(lengths)
        self.flat = np.fromiter(itertools.chain.from_iterable(queries.sequences), np.int64, sum(lengths))
        self.begin = (np.cumsum(lengths) - lengths)[self.some]

    def scores(self, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Query by document; ``doc`` (a place among ``sizes``), ``term`` and ``times`` are the documents' counts."""
        m = 50 + (50 * sizes * self.number) // self.total
        part = self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
        sums = np.zeros((self.size, len(sizes)), np.int64)
        np.add.at(sums, (self.queries.class_of[term], doc), part)
        for node, left, right in self.levels:
            sums[node] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.flat], self.begin, axis=0)


class Best:
    """The best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.least = np.ones(queries, np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        q, d = np.nonzero(scores >= self.least[:, None])
        self.item, self.score = np.append(self.item, q), np.append(self.score, scores[q, d])
        self.doc, self.null = np.append(self.doc, doc[d]), np.append(self.null, null[d])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.item, self.score, self.doc, self.null = self.item[keep], self.score[keep], self.doc[keep], self.null[keep]
        full = np.searchsorted(self.item, np.arange(len(self.least)), side="right") - 1  # each query's worst, if it has k
        held = np.bincount(self.item, minlength=len(self.least)) >= self.k
        self.least[held] = self.score[full[held]]

    def rows(self) -> Iterator[tuple]:
        for q, s, d, n in zip(self.item.tolist(), self.score.tolist(), self.doc.tolist(), self.null.tolist(), strict=True):
            yield q, None if n else d, s


def blocks(items: DataFrame, block_terms: int) -> Iterator[Queries]:
    """The queries in parts of bounded size; rows of one id are one query."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id")
    held, size = [], 0
    for item_id, group in itertools.groupby(rows.toLocalIterator(), lambda r: r["item_id"]):
        terms = {t for r in group for part in terms_of(r["text"]) for t in part}
        if terms:
            held.append((item_id, terms))
            size += len(terms)
        if size >= block_terms:
            yield Queries(held)
            held, size = [], 0
    if held:
        yield Queries(held)


def found(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``FOUND``: each document's number of terms, and which query terms it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # about BLOCK_TERMS terms
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("terms", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                size, counts = 0, Counter()
                for part in terms_of(text):
                    size += len(part)
                    counts.update(map(get, part))
                counts.pop(None, None)
                if size:
                    yield doc_id, size, np.fromiter(counts.keys(), "<i4", len(counts)).tobytes(), np.fromiter(counts.values(), "<i4", len(counts)).tobytes()

        yield from in_batches(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, FOUND)


def holders(counted: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; summed in tasks, then over them."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            for held in batch.column("terms").to_pylist():
                n[np.frombuffer(held, "<i4")] += 1
        yield from in_batches(((int(t), int(n[t])) for t in np.flatnonzero(n)), schema)

    out = np.zeros(terms, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a block's terms
        out[r["term"]] = r["n"]
    return out


def search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` for one block of queries."""
    spark = docs.sparkSession
    counted = cut(found(docs, queries.vocabulary))
    sums = counted.agg(F.count(F.lit(1)).alias("number"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    df = holders(counted, len(queries.vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * sums["number"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(Evaluation(queries, weight, sums["number"], sums["total"]))
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ev = shared.value
        best, step = Best(len(ev.some), k), max(1, CELLS // max(1, ev.size, len(ev.flat)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                doc, sizes, terms, times = batch.slice(at, step).columns
                held = [np.frombuffer(t, "<i4") for t in terms.to_pylist()]
                place = np.repeat(np.arange(len(held)), [len(h) for h in held])
                often = np.concatenate([np.frombuffer(t, "<i4") for t in times.to_pylist()]).astype(np.int64)
                scores = ev.scores(sizes.to_numpy(), place, np.concatenate(held).astype(np.int64), often)
                best.add(scores, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        yield from in_batches(((int(ev.some[q]), d, s) for q, d, s in best.rows()), schema)

    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = queries.ids
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    top = counted.mapInArrow(run, TOP).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row for each query of the block


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each query with a score above 0."""
    parts: list[DataFrame] = []
    for block in blocks(items, block_terms):
        parts[-1:] = [cut(p) for p in parts[-1:]]  # of several blocks, each is finished before the next is held
        parts.append(search_block(docs, block, k))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, text from documents where text is not null),
t as (select r, {_TERMS} from d),
c as (select r, term, count(*) as tf from t group by r, term),
s as (select r, sum(tf)::bigint as n from c group by r),
a as (select count(*)::bigint as nn, sum(n)::bigint as ll from s),
q as (select distinct item_id, {_TERMS} from benchmark where text is not null),
w as (select term, cast(floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from c, a where term in (select term from q) group by term),
x as (select q.item_id, c.r, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * a.nn) // a.ll))))::bigint as score
      from q join w using (term) join c using (term) join s on s.r = c.r, a group by q.item_id, c.r),
o as (select x.item_id, d.doc_id, x.score, row_number() over (partition by x.item_id order by x.score desc, d.doc_id nulls last) as rank
      from x join d on d.r = x.r where x.score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= 50
"""
