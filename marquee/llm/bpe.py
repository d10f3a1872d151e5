"""Byte-level BPE by rounds over length-bucketed matrices, and decoding.

A text is split by the pre-token pattern; every distinct pre-token of a batch that is no vocabulary entry itself becomes a
row of a padded matrix of its length class. Each round finds every row's leftmost pair of least rank, merges it and closes
the gap; finished rows leave the matrix. Pair ranks come from an open-addressing hash table over id pairs.

Nothing is shuffled: a row needs only the vocabulary, whose size is fixed and which is broadcast. Defined cases: a null text
is the empty one and has no ids; every byte is a token, so that any text can be encoded and decoding gives its bytes back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, rows_of, table, texts

NONE = np.int32(2**31 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Rows longer than this are merged by a heap over a linked list: the same merges, without a pass over the row for each.
LONG_PIECE = 256
#: Pre-tokens remembered by a task; beyond it the memory starts again, which costs time and changes nothing.
REMEMBERED = 150_000
#: Texts longer than this many code points are split lazily.
LONG_TEXT = 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Rank of the token that two adjacent ids make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for (a, b), rank in pairs.items():
            key = a << 32 | b
            at = ((key * int(MULTIPLIER)) & (2**64 - 1)) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs (``NONE``: no token); a negative id is padding."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo].astype(np.int64) << 32 | right.ravel()[todo].astype(np.int64)
        at = (keys.view(np.uint64) * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)
        flat = out.ravel()
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            flat[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (found >= 0)
            todo, keys, at = todo[more], keys[more], (at[more] + 1) & self.mask
        return flat.reshape(left.shape)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = dict((i, b) for b, i in ranks.items())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = PairTable(pairs)
        self.pair_rank = pairs

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length class, as little-endian 32-bit integers: rounds over a padded matrix."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = max(2, int(size.max()))
        column = np.arange(width)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[column < size[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out, out_size = np.empty_like(ids), size.copy()
        rows = np.arange(len(pieces))
        rank = self.pairs.look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)  # the first of equal ones: the leftmost
            least = rank[np.arange(len(rows)), at]
            go = least != NONE
            if not go.all():
                done = rows[~go]
                out[done, : ids.shape[1]], out_size[done] = ids[~go], size[~go]
                rows, size, at, least, ids, rank = rows[go], size[go], at[go], least[go], ids[go], rank[go]
                if not len(rows):
                    break
            every, wide = np.arange(len(rows)), ids.shape[1] - 1
            size = size - 1
            ids[every, at] = least
            keep = np.ones(ids.shape, bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(-1, wide)
            if wide == 1:
                rank = np.full((len(rows), 1), NONE, np.int32)
                continue
            keep = np.ones(rank.shape, bool)
            keep[every, at] = False
            rank = rank[keep].reshape(-1, wide - 1)
            inner = np.flatnonzero(at < wide - 1)  # the pair that begins with the new token
            rank[inner, at[inner]] = self.pairs.look_up(ids[inner, at[inner]], ids[inner, at[inner] + 1])
            inner = np.flatnonzero(at)  # the pair that ends with it
            rank[inner, at[inner] - 1] = self.pairs.look_up(ids[inner, at[inner] - 1], ids[inner, at[inner]])
        flat = out[column < out_size[:, None]].astype("<u4").tobytes()
        ends = np.cumsum(out_size * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.pair_rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or self.pair_rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := self.pair_rank.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := self.pair_rank.get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([t for t, a in zip(ids, alive, strict=True) if a], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers; a piece that is itself a token is not merged."""
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                out[i] = self.merge_long(p)
            else:
                classes.setdefault((len(p) - 1).bit_length(), []).append(i)
        for k, members in classes.items():
            step = max(1, 2_000_000 >> k)  # cells of a matrix
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts, remembering the pre-tokens met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.split, self.known = vocabulary, regex.compile(vocabulary.pattern), {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.split.findall(text)
        else:
            found = (m.group() for m in self.split.finditer(text))
            while part := list(itertools.islice(found, 500_000)):
                yield part

    def learn(self, words: Iterable[str]) -> None:
        new = list(set(words) - self.known.keys())
        self.known.update(zip(new, self.v.encode_pieces([w.encode() for w in new]), strict=True))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.pieces(text):
            self.learn(part)
            out.append(b"".join(map(self.known.__getitem__, part)))
            if len(self.known) > REMEMBERED:
                self.known.clear()
        return b"".join(out)

    def encode_many(self, many: list[str]) -> list[bytes]:
        """Short texts together, so that matrices are tall."""
        parts = [self.split.findall(t) for t in many]
        self.learn(itertools.chain.from_iterable(parts))
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


def encoded(rows: Iterable[tuple], encoder: Encoder) -> Iterator[tuple[tuple, bytes]]:
    """Each row (text last) without its text, and its ids."""
    held, size = [], 0
    for *rest, text in rows:
        if len(text) > LONG_TEXT:
            yield tuple(rest), encoder.encode(text)
            continue
        held.append((tuple(rest), text))
        size += len(text)
        if size > 1_000_000:
            yield from zip((r for r, _ in held), encoder.encode_many([t for _, t in held]), strict=True)
            held, size = [], 0
    yield from zip((r for r, _ in held), encoder.encode_many([t for _, t in held]), strict=True)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(spark: SparkSession, df: DataFrame, path: str | None = None, pattern: str | None = None, *, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` of each row, repeated rows included."""
    if path is None:
        path, pattern = _public()
    shared = spark.sparkContext.broadcast(vocabulary(path, pattern))  # bounded by the vocabulary file
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)

        def rows() -> Iterator[tuple]:
            for (doc_id,), raw in encoded(rows_of(batches), encoder):
                ids = np.frombuffer(raw, "<u4")
                row = (doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(encoder.v.decode(ids)).hexdigest())
                yield row + (ids.astype(np.int32),) * with_ids

        yield from in_batches(rows(), schema, 256 if with_ids else 2048)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return texts(df).mapInArrow(run, ddl)


def decode(spark: SparkSession, df: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids; a null list gives null."""
    if path is None:
        path, pattern = _public()
    words = spark.sparkContext.broadcast({i: b for b, i in read_ranks(path).items()})  # bounded by the vocabulary file

    @F.pandas_udf("binary")
    def join(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: None if x is None else b"".join(map(words.value.__getitem__, list(x))))

    return df.withColumn(fresh(df, "decoded"), join(F.col(ids)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents"), with_ids=False)
