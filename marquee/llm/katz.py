"""Language model scores by Katz backoff over bigrams.

Tokens are the ASCII-lower-cased words of a text and one end; each has the token before it as history, the first one the start. Counts of
training texts are discounted by Good-Turing for counts up to ``TOP``. A token seen after its history gets its discounted share; else the mass
that the history's discounts freed is shared among the tokens not seen there in proportion to their unigram probability, which backs off in turn: known
tokens by their discounted share, all unknown ones by the mass left. Each history's weights are normalised exactly: over the known tokens
and the unknown one its probabilities sum to 1. A history without discounted counts counts one more, which it leaves to the unseen.

Texts are read once into chunks of some millions of tokens, with each word as a number. Counts live in tables that are partitioned by ranges of the
hashed key: a chunk asks each partition for its distinct keys (its own counts beside them), the partition sums over the chunks and answers in the same order.
There are three such tables: words, bigrams, and histories (the mass freed and the unigram mass of what was seen, each bigram handed in by the
one chunk that its partition named). So a key is one entry of a chunk however often it occurs, no key can be hot, and nothing the size of the corpus
is in one place. What moves grows with the distinct keys of the chunks. It is one plan of shuffles without state of its own, which
Spark repeats where an executor is lost; the chunks and the asked tables are exchanges that the plan reuses.

Keys are 64-bit hashes (XXH64 of words; mixed pairs of them): with V distinct keys the odds that any two are the same are about V * V / 2^65.

Defined cases: a null text is the empty one: its end is its only token; without training texts every token is unknown and has
probability 1; rows with a null id are training ones or not by the empty text's crc32; repeated rows count as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import in_batches, remainder, rows_of, table, texts

FOLDS, HELD_OUT = 7, 2
TOP = 5
CHUNK_TOKENS = 2_500_000
END, START = (xxhash.xxh64_intdigest(x, 7) for x in (b"end", b"start"))
CHUNK = "chunk long, doc_id array<long>, held array<boolean>, size array<int>, words binary, tokens binary"
ASKED = "bucket int, chunk long, kind int, keys binary, vals binary"
ANSWER = "chunk long, bucket int, kind int, vals binary, stats array<double>"


# ---- packed columns ----

def pack_small(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, mostly small: byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_small(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_keys(x: np.ndarray, low: int) -> bytes:
    """Sorted unsigned numbers from ``low`` on: differences, cut to the bytes that they need."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=np.uint64(low))
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([k]) + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k]).tobytes()


def unpack_keys(b: bytes, low: int) -> np.ndarray:
    if not b:
        return np.empty(0, np.uint64)
    d = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(d), 8), np.uint8)
    out[:, : b[0]] = d
    out = out.view("<u8").ravel()
    out[0] += np.uint64(low)
    return np.cumsum(out, dtype=np.uint64)


def lows(buckets: int) -> list[int]:
    """Where the key ranges begin."""
    return [-(-(b << 64) // buckets) for b in range(buckets)] + [1 << 64]


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places where the ranges begin among sorted keys."""
    return np.append(np.searchsorted(keys, np.array(lows(buckets)[:-1], np.uint64)), len(keys))


# ---- chunks ----

def pairs_of(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of bigrams."""
    with np.errstate(over="ignore"):
        x = (history * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0xD1B54A32D192ED03))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Texts of a task as rows of ``CHUNK``; the words are sorted hashes, the tokens their places by falling frequency."""
    part, number = TaskContext.get().partitionId(), 0
    known: dict[bytes, int] = {}
    held: list[list] = [[], [], [], []]
    total = 0

    def row() -> tuple:
        nonlocal known, held, total, number
        doc_id, out, size, tokens = held
        ids = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
        order = np.argsort(-np.bincount(ids, minlength=len(known) + 1), kind="stable")
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known))
        hashes = np.append(hashes, np.uint64(END))[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        got = (part << 32 | number, doc_id, out, size, hashes.tobytes(), pack_small(place[ids]))
        known, held, total, number = {}, [[], [], [], []], 0, number + 1
        return got

    for doc_id, out, text in rows_of(batches):
        words = text.encode().lower().split()
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
        held[0].append(doc_id)
        held[1].append(out)
        held[2].append(len(words) + 1)
        held[3] += [ids, np.array([-1], np.int32)]
        total += len(words) + 1
        if total >= most:
            held[3] = [np.where(x < 0, len(known), x) for x in held[3]]
            yield row()
    if total:
        held[3] = [np.where(x < 0, len(known), x) for x in held[3]]
        yield row()


class Chunk:
    """A row of ``CHUNK`` taken apart."""

    def __init__(self, doc_id, held, size, words, tokens):  # noqa: ANN001
        self.doc_id, self.held, self.size = list(doc_id), np.array(held, bool), np.array(size, np.int64)
        self.words = np.append(np.frombuffer(words, "<u8"), np.uint64(START))
        self.token = unpack_small(tokens)
        self.first = np.cumsum(self.size) - self.size
        self.history = np.roll(self.token, 1)
        self.history[self.first] = len(self.words) - 1
        self.trained = np.repeat(~self.held, self.size)
        self.sorted = np.argsort(self.words, kind="stable")  # the order in which words are asked for

    def word_counts(self) -> np.ndarray:
        """Training counts of the words, as sorted; the start counts training texts."""
        n = np.bincount(self.token[self.trained], minlength=len(self.words))
        n[-1] = int((~self.held).sum())
        return n[self.sorted]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the first token of each, and each token's place among them."""
        return np.unique(pairs_of(self.words[self.history], self.words[self.token]), return_index=True, return_inverse=True)


def ask(kind: int, chunk: int, keys: np.ndarray, vals: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    at, low = cuts(keys, buckets), lows(buckets)
    for b in range(buckets):
        i, j = at[b], at[b + 1]
        if j > i:
            yield b, chunk, kind, pack_keys(keys[i:j], low[b]), b"".join(_sized(v[i:j]) for v in vals)


def _sized(v: np.ndarray) -> bytes:
    raw = b"d" + zlib.compress(np.ascontiguousarray(v.astype("<f8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1) if v.dtype == float else b"i" + pack_small(v)
    return len(raw).to_bytes(4, "little") + raw


def _vals(b: bytes) -> list[np.ndarray]:
    out = []
    while b:
        n = int.from_bytes(b[:4], "little")
        raw, b = b[4 : 4 + n], b[4 + n :]
        out.append(unpack_small(raw[1:]) if raw[:1] == b"i" else np.ascontiguousarray(np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(8, -1).T).view("<f8").ravel())
    return out


# ---- model ----

def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to ``TOP``, from how many keys have each count 1 to ``TOP`` + 1.

    The largest range of counts for which the estimate is sound is used; where there is none, half of each count of one is freed.
    """
    for k in range(TOP, 0, -1):
        if (n[: k + 1] > 0).all():
            r = np.arange(1, k + 1)
            beyond = (k + 1) * n[k] / n[0]
            d = ((r + 1) * n[1 : k + 1] / (r * n[:k]) - beyond) / (1 - beyond) if beyond < 1 else np.zeros(k)
            if ((d > 0) & (d <= 1)).all() and d[0] < 1:
                return np.concatenate([[1.0], d, np.ones(TOP - k)])
    return np.concatenate([[1.0, 0.5], np.ones(TOP - 1)])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.where(c <= TOP, c, 0)]


class Unigrams:
    """Probabilities of known tokens by count, and of all unknown ones together."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v, of = stats[0], stats[1], stats[2:]
        self.d = discounts(of)
        freed = float(((1 - self.d[1:]) * np.arange(1, TOP + 1) * of[:TOP]).sum())
        self.total = self.n if freed > 0 else self.n + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unknown)


def count_stats(total: np.ndarray) -> list[float]:
    """Sum, number of keys, and how many keys have each count 1 to ``TOP`` + 1."""
    return [float(total.sum()), float((total > 0).sum()), *(float((total == r).sum()) for r in range(1, TOP + 2))]


def answer(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """What a partition of a table says to each chunk that asked, in the order of its keys."""
    group = group.sort_values("chunk", kind="stable")
    bucket, kind = int(group["bucket"].iloc[0]), int(group["kind"].iloc[0])
    low = lows(buckets)[bucket]
    keys = [unpack_keys(b, low) for b in group["keys"]]
    vals = [_vals(b) for b in group["vals"]]
    ends = np.cumsum([len(k) for k in keys])
    distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    stats = [0.0] * (TOP + 3)
    if kind < 2:
        given = np.concatenate([v[0] for v in vals])
        total = np.bincount(place, given, len(distinct)).astype(np.int64)
        reply = total[place]
        stats = count_stats(total[distinct != np.uint64(START)]) if kind == 0 else count_stats(total)
        if kind == 1:  # twice the count, and one for the chunk that hands the bigram on
            reply *= 2
            reply[first] += total > 0
        said = [pack_small(x) for x in np.split(reply, ends[:-1])]
    else:
        freed, seen = (np.bincount(place, np.concatenate([v[i] for v in vals]), len(distinct)) for i in (0, 1))
        said = []
        for at, v in zip(np.split(place, ends[:-1]), vals, strict=True):
            need = at[v[2] > 0]
            said.append(_sized(freed[need]) + _sized(seen[need]))
    return pd.DataFrame({"chunk": group["chunk"].to_numpy(), "bucket": bucket, "kind": kind, "vals": said, "stats": [stats if i == 0 else [0.0] * len(stats) for i in range(len(said))]})


def gathered(right: pd.DataFrame, kind: int) -> list[bytes]:
    return right[right["kind"] == kind].sort_values("bucket")["vals"].tolist()


class Scored:
    """A chunk with the answers for its words and bigrams."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        r = left.iloc[0]
        self.c = c = Chunk(r["doc_id"], r["held"], r["size"], r["words"], r["tokens"])
        self.uni = Unigrams(np.array(r["stats0"]))
        self.d = discounts(np.array(r["stats1"])[2:])
        self.count = np.empty(len(c.words), np.int64)
        self.count[c.sorted] = np.concatenate([unpack_small(b) for b in gathered(right, 0)])
        said = np.concatenate([unpack_small(b) for b in gathered(right, 1)])
        self.of_pair, self.mine = said // 2, said % 2 > 0
        _, self.pair_first, self.pair = c.bigrams()

    def histories(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word places, sorted by hash, that the table of histories is asked about: mass freed and seen here, and whether the sums are needed."""
        c = self.c
        at = self.pair_first[self.mine]
        n = self.of_pair[self.mine]
        freed = np.bincount(c.history[at], n - discounted(n, self.d), len(c.words))
        seen = np.bincount(c.history[at], self.uni.p(self.count[c.token[at]]), len(c.words))
        used, unseen, marked = np.zeros((3, len(c.words)), bool)
        used[c.history] = True
        unseen[c.history[(self.of_pair == 0)[self.pair]]] = True
        marked[c.history[self.pair_first[discounted(self.of_pair, self.d) < self.of_pair]]] = True  # surely frees mass
        need = used & (self.count > 0) & (unseen | ~marked)
        took = np.zeros(len(c.words), bool)
        took[c.history[at]] = True
        pick = c.sorted[(took | need)[c.sorted]]
        return pick, freed[pick], seen[pick], need[pick]

    def rows(self, said: list[list[np.ndarray]]) -> pd.DataFrame:
        """Scores of the chunk's texts, from the answers about histories."""
        c, uni = self.c, self.uni
        pick, _, _, need = self.histories()
        freed, seen = np.ones(len(c.words)), np.zeros(len(c.words))
        freed[pick[need]] = np.concatenate([x[0] for x in said]) if said else []
        seen[pick[need]] = np.concatenate([x[1] for x in said]) if said else []
        total = self.count + (freed == 0)  # of a history; one more where nothing is discounted
        back = np.where(self.count > 0, np.where(freed > 0, freed, 1.0) / np.maximum(total, 1) / (1 - seen), 1.0)
        n, h, w = self.of_pair[self.pair], c.history, c.token
        p1 = uni.p(self.count)
        p = np.where(n > 0, discounted(n, self.d) / np.maximum(total[h], 1), back[h] * p1[w])
        base = np.log10((self.count[w] + 1) / (uni.n + 1 * (uni.v + 1)))
        def of_texts(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, c.first)

        return pd.DataFrame({"doc_id": pd.array(c.doc_id, "Int64"), "held_out": c.held, "n_tokens": c.size, "n_known": of_texts((self.count[w] > 0).astype(np.int64)),
                             "train_tokens": int(uni.n), "base_score": of_texts(base), "score": of_texts(np.log10(p))})


def score(docs: DataFrame, buckets: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row."""
    parts = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = texts(docs).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held"), "text")
    chunk_schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])
    ask_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(chunks(batches, chunk_tokens), chunk_schema, 1)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *row in rows_of(batches):
            c = Chunk(*row)
            yield from in_batches(ask(0, number, c.words[c.sorted], [c.word_counts()], parts), ask_schema, 64)

    def ask_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *row in rows_of(batches):
            c = Chunk(*row)
            keys, _, place = c.bigrams()
            yield from in_batches(ask(1, number, keys, [np.bincount(place[c.trained], minlength=len(keys))], parts), ask_schema, 64)

    def ask_histories(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = Scored(left, right)
        pick, freed, seen, need = s.histories()
        return pd.DataFrame(list(ask(2, int(key[0]), s.c.words[pick], [freed, seen, need.astype(np.int64)], parts)), columns=["bucket", "chunk", "kind", "keys", "vals"])

    def finish(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return Scored(left, right).rows([_vals(b) for b in gathered(right, 2)])

    def replies(group: pd.DataFrame) -> pd.DataFrame:
        return answer(group, parts)

    def summed(answers: DataFrame):  # noqa: ANN202
        return answers.agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(TOP + 3)]).alias("s")).scalar()

    cut = named.mapInArrow(cut_up, CHUNK).repartition("chunk")
    words = cut.mapInArrow(ask_words, ASKED).groupBy("bucket").applyInPandas(replies, ANSWER)
    bigrams = cut.mapInArrow(ask_bigrams, ASKED).groupBy("bucket").applyInPandas(replies, ANSWER)
    known = words.unionByName(bigrams).select("chunk", "bucket", "kind", "vals")
    left = cut.withColumn("stats0", summed(words)).withColumn("stats1", summed(bigrams))
    asked = left.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(ask_histories, ASKED)
    histories = asked.groupBy("bucket").applyInPandas(replies, ANSWER).select("chunk", "bucket", "kind", "vals")
    return left.groupBy("chunk").cogroup(known.unionByName(histories).groupBy("chunk")).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
