"""Spelling variants of words: pairs one edit apart by pivotal grams, and the frequent form that each word is a variant of.

Words are counted over all texts. Their bigrams are ordered by how often the words hold them, rarest first. A word's gram prefix is its three rarest bigrams,
with further occurrences of the third: one edit destroys at most two. Its pivots are two bigrams of the prefix that do not overlap, so that an edit
leaves one of them as it is. If a word's last prefix bigram is not after the other's, the pivot that the edit left is in the other word's prefix.
The first pivot finds edits behind it: it stands at the same place in both words. The second one finds all others: it stands at the same
distance from the end. These are the position limits. A key is the pivot with all that lies on its untouched side and one half of the other side, as the edit is not in both
halves: a pivot alone, or with one side, is held by too many words of a large table. Dynamic programming over the places chooses the pair of pivots
whose beginnings and ends the fewest words should share, by the frequencies of the bigrams in them. What shares a key is verified. Each pair is found once:
under the first key that it shares, and where both words' last prefix bigrams are the same, from the smaller word.

A word is counted in its task before it is shuffled; so no word is hot. Keys are hashes with a word and a few numbers beside them; pairs are verified as
the join streams, and a word's pairs are aggregated partially. Bigrams of the alphabet are at most 8,100 and the only thing that is collected.
Links from word to form are followed by doubling: a form is ten times as frequent, so that 64-bit counts allow 18 links.

Defined cases: a null text has no words; a null id counts as the empty text in the hash; repeated rows count as often as they occur; words as long as a
text are words; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import in_batches, rows_of, table
from marquee.session import cut

SIGNS = "[A-Za-zÀ-ÿ]"
DROP = 31
SHORTEST = 7
FEWEST = 2
TIMES = 10
HELD = 300_000
INLINE = 64
PREFIX = 3  # one edit destroys two bigrams
PROBES = "key long, kind int, a string, len_a int, last_a int, head int, tail int"
ENTRIES = "key long, b string, len_b int, last_b int"


def kept_form(doc_id: int | None, run: str) -> str:
    """A lower-cased run of a document, without the code point that its hash names, if any."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word``, ``n`` of the words of at least ``shortest`` code points that occur ``fewest`` times or more in all texts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{SIGNS}{{{shortest},}}")  # a shorter run gives no word that counts
        held: Counter[str] = Counter()

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                found = (m.group() for m in find.finditer(text.encode().lower().decode()))  # of bytes, lower() changes A-Z alone
                while part := Counter(itertools.islice(found, 200_000)):
                    for w, n in part.items():
                        w = kept_form(doc_id, w)
                        if len(w) >= shortest:
                            held[w] += n
                    if len(held) > HELD:
                        yield from held.items()
                        held.clear()
            yield from held.items()

        yield from in_batches(rows(), schema, 8192)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class Grams:
    """The order of bigrams, and the logarithmic frequencies that stand for how many words share a beginning or an end."""

    def __init__(self, counts: dict[str, int]):
        self.rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
        first, second = Counter(), Counter()
        for g, n in counts.items():
            first[g[0]] += n
            second[g[1]] += n
        self.alone = {g: math.log(n) for g, n in counts.items()}
        self.after = {g: math.log(n / first[g[0]]) for g, n in counts.items()}
        self.before = {g: math.log(n / second[g[1]]) for g, n in counts.items()}

    def pivots(self, word: str) -> tuple[list[int], int, int, int]:
        """Places of the prefix, the rank of its last bigram, and the places of the two pivots."""
        grams = [word[i : i + 2] for i in range(len(word) - 1)]
        ranks = [self.rank[g] for g in grams]
        last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
        prefix = [i for i, r in enumerate(ranks) if r <= last]
        heads = list(itertools.accumulate(self.after[g] if i else self.alone[g] for i, g in enumerate(grams)))
        tails = list(itertools.accumulate(self.before[g] if i else self.alone[g] for i, g in enumerate(reversed(grams))))[::-1]
        best, chosen, head, at = math.inf, (0, 0), -1, 0
        for i in prefix:  # head: the cheapest first pivot that ends before place i
            while prefix[at] + 2 <= i:
                if head < 0 or heads[prefix[at]] < heads[head]:
                    head = prefix[at]
                at += 1
            if head >= 0 and (cost := math.exp(heads[head]) + math.exp(tails[i])) < best:
                best, chosen = cost, (head, i)
        return prefix, last, *chosen


def rolling(signs: Iterable[int]) -> list[int]:
    """Hashes of all beginnings, the empty one too."""
    return list(itertools.accumulate(signs, lambda h, c: (h * 1_000_003 + c + 1) % ((1 << 61) - 1), initial=0))


def _key(kind: int, part: int, other: int, place: int) -> int:
    return ((part * 2_147_483_647 + other) * 1_000_003 + place * 4 + kind) % ((1 << 61) - 1)


def probes(grams: Grams, word: str, ref: str) -> Iterator[tuple]:
    """Rows of ``PROBES``: under each of the two pivots, with the near and with the far half of what lies on its other side."""
    _, last, head, tail = grams.pivots(word)
    m = len(word)
    signs = list(map(ord, word))
    begins, ends = rolling(signs), rolling(reversed(signs))
    behind, far = (m - head - 2) // 2, tail // 2
    keys = (_key(0, begins[head + 2 + behind], 0, head), _key(1, begins[head + 2], ends[m - head - 2 - behind], m - head - 2 - behind),
            _key(2, ends[m - tail + far], 0, m - tail), _key(3, ends[m - tail], begins[tail - far], tail - far))
    for kind, key in enumerate(keys):
        yield key, kind, ref, m, last, head, tail


def halves(m: int) -> tuple[set[int], set[int]]:
    """Lengths of the near and the far half of a side that has ``m`` signs here and one less, as many or one more in the other word."""
    return {x // 2 for x in range(max(m - 1, 0), m + 2)}, {e for x in range(max(m - 1, 0), m + 2) if (e := x - x // 2) <= m}


def entries(grams: Grams, word: str, ref: str) -> Iterator[tuple]:
    """Rows of ``ENTRIES``: what a probe of a word one edit away can ask for, for each bigram of the prefix."""
    prefix, last, _, _ = grams.pivots(word)
    m = len(word)
    signs = list(map(ord, word))
    begins, ends = rolling(signs), rolling(reversed(signs))
    for i in prefix:
        near, far = halves(m - i - 2)
        yield from ((_key(0, begins[i + 2 + h], 0, i), ref, m, last) for h in near)
        yield from ((_key(1, begins[i + 2], ends[e], e), ref, m, last) for e in far)
        near, far = halves(i)
        yield from ((_key(2, ends[m - i + h], 0, m - i), ref, m, last) for h in near)
        yield from ((_key(3, ends[m - i], begins[e], e), ref, m, last) for e in far)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``b``: each pair of ``words.word`` (all different, four code points at least) that is one edit apart, once.

    Words of more than ``INLINE`` code points, of which one can have as many entries as signs, are named by a digest in the join and looked up
    for the verification.
    """
    words = words.select("word", F.when(F.length("word") <= INLINE, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2("word", 256))).alias("ref"))
    counts = (words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))).alias("g"))
              .groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    shared = words.sparkSession.sparkContext.broadcast(Grams({r["g"]: r["n"] for r in counts.collect()}))  # two signs of an alphabet of 90
    ints = {x: pa.int32() for x in ("kind", "len_a", "len_b", "last_a", "last_b", "head", "tail")} | {"key": pa.int64(), "a": pa.string(), "b": pa.string()}

    def rows(some: DataFrame, make: Callable[[Grams, str, str], Iterator[tuple]], ddl: str) -> DataFrame:
        schema = pa.schema([(x, ints[x]) for x in (c.split()[0] for c in ddl.split(", "))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from in_batches((x for word, ref in rows_of(batches) for x in make(shared.value, word, ref)), schema, 8192)

        return some.mapInArrow(run, ddl)

    def shared_key(some: DataFrame) -> DataFrame:
        return rows(some, probes, PROBES).join(rows(some, entries, ENTRIES), "key").where(
            (F.abs(F.col("len_a") - F.col("len_b")) <= 1)
            & ((F.col("last_a") < F.col("last_b")) | ((F.col("last_a") == F.col("last_b")) & (F.col("a") < F.col("b")))))

    longer = words.where(F.length("word") >= INLINE)  # and those that a longer one can be near to
    long = shared_key(longer).where(F.greatest("len_a", "len_b") > INLINE)
    for side in ("a", "b"):
        long = long.join(longer.select(F.col("ref").alias(side), F.col("word").alias(f"word_{side}")), side)
    both = shared_key(words.where(F.length("word") <= INLINE)).select("a", "b", "kind", "head", "tail").unionByName(
        long.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "kind", "head", "tail"))
    at_kind = [F.expr(x) for x in ("startswith(b, left(a, head + 2 + (length(a) - head - 2) div 2))",
                                   "startswith(b, left(a, head + 2)) and endswith(b, substring(a, head + 3 + (length(a) - head - 2) div 2))",
                                   "endswith(b, substring(a, tail + 1 - tail div 2))",
                                   "endswith(b, substring(a, tail + 1)) and startswith(b, left(a, tail - tail div 2))")]
    first = F.lit(-1)  # of several keys that a pair shares the first one counts
    for kind, holds in reversed(list(enumerate(at_kind))):
        first = F.when(holds, kind).otherwise(first)
    return both.where((F.col("kind") == first) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each word."""
    words = cut(word_counts(docs, shortest, fewest))
    both = near_pairs(words).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    others = words.select(F.col("word").alias("b"), F.col("n").alias("other_n"))
    near = (both.join(others, "b").groupBy(F.col("a").alias("word"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus_n"), F.col("b").alias("form"))).alias("best")))
    fits = -F.col("best.minus_n") >= F.col("n") * times
    found = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.minus_n")).alias("form_n")))
    return found.join(roots(found.where("form is not null").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``form`` from each word ends. A round doubles how far every word has followed."""
    at = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while at.where("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return at.select("word", "root")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
