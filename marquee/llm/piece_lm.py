"""Language of a text by unigram models over pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece. A word is a run of letters (and marks on them), lower-cased, after a word mark; its probability is the sum,
over every way to cut it into pieces, of the product of their probabilities, which a forward pass adds up position by position. A
text's score is the sum of its words' logarithms and of the language's logarithmic share of training texts; the best language is predicted,
and its posterior share is the score.

Pieces are the vocabulary's entries of letters alone, lower-cased, with and without the word mark, the mark itself, and one more that
stands for any single sign that is no entry, so that every word can be cut. Probabilities are learned by expectation maximisation on all training texts:
words are counted by language first, so that a round costs as much as there are different words; a forward and a backward pass
give each piece's expected count, and Spark adds these up. Every count gets ``SMOOTH`` more.

Work is laid out so that nothing grows in one place: words are counted in tasks and then by (language, word) keys, of which a task
holds at most ``HELD`` at once; the model has one number for each piece and language and is the only thing that is collected and broadcast. Scoring shuffles nothing.
Inside a task all words of one length go through the passes together, as matrices.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text where no training text has a language; a
language is learned from its texts even if they are all without letters; ties go to the first name; repeated rows count as often as they occur; a
null id is a training row or not by the empty text's crc32.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import in_batches, remainder, rows_of, table
from marquee.session import cut

FOLDS, HELD_OUT = 4, 2
ROUNDS = 3
SMOOTH = 0.1
HELD = 300_000
CELLS = 1_500_000
LONG_TEXT = 4_000_000
MARK = "▁"
WORD = r"\p{L}[\p{L}\p{M}]*"
COUNTS = "lang string, word string, n long"
PIECE_COUNTS = "lang string, piece int, c double"


def read_pieces(path: str) -> list[str]:
    """The vocabulary's entries of letters alone, lower-cased, and the word mark; sorted."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    letters, out = regex.compile(r"[\p{L}\p{M}]+"), {MARK}
    for i in range(p.get_piece_size()):
        if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)):
            piece = p.id_to_piece(i).lower()
            if letters.fullmatch(piece.removeprefix(MARK)):
                out.add(piece)
    return sorted(out)


class Lattice:
    """A trie of the pieces, as sorted arrays; ``other`` is the piece of a single sign without entry, ``absent`` stands for none."""

    def __init__(self, pieces: list[str]):
        tree: list[dict[int, int]] = [{}]
        final = [-1]
        for number, piece in enumerate(pieces):
            at = 0
            for sign in map(ord, piece):
                if sign not in tree[at]:
                    tree[at][sign] = len(tree)
                    tree.append({})
                    final.append(-1)
                at = tree[at][sign]
            final[at] = number
        edges = sorted((node << 21 | sign, to) for node, out in enumerate(tree) for sign, to in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int64)
        self.final = np.array(final, np.int64)
        self.pieces, self.other, self.absent = len(pieces), len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces))

    def starting(self, words: list[str]) -> np.ndarray:
        """For words of one length: the piece that starts at each place with each length, word by place by length."""
        signs = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.int64)
        n, m = signs.shape
        out = np.full((n, m, min(m, self.longest)), self.absent, np.int32)
        row, at = (x.ravel() for x in np.indices((n, m)))
        state = np.zeros(n * m, np.int64)
        for length in range(out.shape[2]):
            inside = at + length < m
            row, at, state = row[inside], at[inside], state[inside]
            key = state << 21 | signs[row, at + length]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live = self.keys[found] == key
            piece = np.full(len(key), -1, np.int64)
            piece[live] = self.final[self.to[found[live]]]
            if not length:
                piece[piece < 0] = self.other
            out[row, at, length] = np.where(piece < 0, self.absent, piece)
            row, at, state = row[live], at[live], self.to[found[live]]
            if not len(row):
                break
        return out


def ending(starting: np.ndarray, absent: int) -> np.ndarray:
    """The same pieces by the place after their end (less one)."""
    out = np.full_like(starting, absent)
    for length in range(starting.shape[2]):
        out[:, length:, length] = starting[:, : starting.shape[1] - length, length]
    return out


def forward(pieces: np.ndarray, p: np.ndarray, keep: bool = False) -> np.ndarray:
    """Logarithms of the probability of the whole words (or of each of their beginnings, with ``keep``), word by language.

    ``pieces`` are those that end at each place, by length; ``p`` has a row for each piece and a column for each language. Only the last
    places as far back as a piece reaches are held, and scaled now and then.
    """
    n, m, far = pieces.shape
    k = p.shape[1]
    back, off = np.zeros((n, far, k)), np.zeros((n, k))
    back[:, 0] = 1
    out = np.zeros((n, m + 1, k)) if keep else None
    for j in range(m):
        new = np.einsum("wlk,wlk->wk", back, p[pieces[:, j]])
        if keep:
            out[:, j + 1] = np.log(new) + off
        back[:, 1:] = back[:, :-1].copy()
        back[:, 0] = new
        if j % 8 == 7:
            most = back.max(axis=1)
            back /= most[:, None]
            off += np.log(most)
    return out if keep else np.log(new) + off


def of_one_length(words: Iterable[str], far: int, wide: int) -> Iterator[list[str]]:
    """Blocks of words of one length, of bounded size."""
    for m, group in itertools.groupby(sorted(words, key=len), len):
        most = max(1, CELLS // (m * min(m, far) * wide))
        while part := list(itertools.islice(group, most)):
            yield part


def word_scores(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Logarithm of each word's probability in each language."""
    out = np.empty((len(words), p.shape[1]))
    place = {w: i for i, w in enumerate(words)}
    for part in of_one_length(words, lattice.longest, p.shape[1]):
        marked = [MARK + w for w in part]
        out[[place[w] for w in part]] = forward(ending(lattice.starting(marked), lattice.absent), p)
    return out


def expected(lattice: Lattice, p: np.ndarray, counts: dict[str, int]) -> np.ndarray:
    """Expected number of each piece over all segmentations of counted words, under the probabilities of one language."""
    out = np.zeros(lattice.absent)
    column = p[:, None]
    with np.errstate(divide="ignore"):
        logp = np.log(p)
    for part in of_one_length(counts, lattice.longest, 1):
        starts = lattice.starting([MARK + w for w in part])
        ends = ending(starts, lattice.absent)
        before = forward(ends, column, True)[:, :, 0]
        after = forward(starts[:, ::-1], column, True)[:, ::-1, 0]  # the backward pass is the forward one from the other end
        w, j, length = np.nonzero(ends != lattice.absent)
        piece = ends[w, j, length]
        share = np.exp(before[w, j - length] + logp[piece] + after[w, j + 1] - before[w, -1])
        n = np.fromiter((counts[x] for x in part), np.float64, len(part))
        out += np.bincount(piece, share * n[w], len(out))
    return out


class Model:
    """Learned languages in order of name, their probabilities of pieces, and their logarithmic shares of training texts."""

    def __init__(self, lattice: Lattice, langs: list[str], prior: np.ndarray):
        self.lattice, self.langs, self.prior = lattice, langs, prior
        self.p = self.smoothed(np.zeros((lattice.absent, len(langs))))

    def smoothed(self, counts: np.ndarray) -> np.ndarray:
        c = counts + SMOOTH
        return np.vstack([c / c.sum(axis=0), np.zeros((1, c.shape[1]))])


def words_in(text: str, find: regex.Pattern) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded length."""
    low = text.lower()
    if len(low) <= LONG_TEXT:
        yield find.findall(low)
        return
    found = (m.group() for m in find.finditer(low))
    while part := list(itertools.islice(found, 200_000)):
        yield part


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` over all texts; docs have ``lang`` and ``text``."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = regex.compile(WORD), {}

        def rows() -> Iterator[tuple]:
            for lang, text in rows_of(batches):
                for part in words_in(text, find):
                    held.setdefault(lang, Counter()).update(part)
                    if sum(map(len, held.values())) > HELD:
                        yield from ((a, w, n) for a, c in held.items() for w, n in c.items())
                        held.clear()
            yield from ((a, w, n) for a, c in held.items() for w, n in c.items())

        yield from in_batches(rows(), schema, 8192)

    # as many partitions as the session names, whatever their bytes: what follows is work by word, so small partitions are not merged
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.mapInArrow(run, COUNTS).repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Learns from the texts of ``docs`` with a non-null ``lang``, all of them."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    given = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("lang is not null")
    shares = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    langs = sorted(shares)
    model = Model(Lattice(read_pieces(path)), langs, np.log(np.array([shares[x] for x in langs], float)) - np.log(max(1, sum(shares.values()))))
    if not langs:
        return model
    counted = cut(word_counts(given))
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("c", pa.float64())])
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each piece and language

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            m, totals = shared.value, {}
            for batch in batches:
                held: dict[str, dict[str, int]] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.setdefault(lang, {})[word] = n
                for lang, counts in held.items():
                    totals[lang] = totals.get(lang, 0) + expected(m.lattice, np.ascontiguousarray(m.p[:, m.langs.index(lang)]), counts)
            yield from in_batches(((lang, i, c[i]) for lang, c in totals.items() for i in np.flatnonzero(c).tolist()), schema, 8192)

        new = np.zeros((model.lattice.absent, len(langs)))
        for r in counted.mapInArrow(run, PIECE_COUNTS).groupBy("lang", "piece").agg(F.sum("c").alias("c")).toLocalIterator():
            new[r["piece"], langs.index(r["lang"])] = r["c"]
        model.p = model.smoothed(new)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of each row, from its text alone."""
    if not model.langs:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, find = shared.value, regex.compile(WORD)
        known: dict[str, int] = {}
        scores = np.empty((0, len(m.langs)))

        def logs(part: list[str]) -> np.ndarray:
            nonlocal scores
            if len(known) > HELD:
                known.clear()
                scores = scores[:0]
            new = [w for w in dict.fromkeys(part) if w not in known]
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                scores = np.vstack([scores, word_scores(m.lattice, m.p, new)])
            return scores[np.fromiter(map(known.__getitem__, part), np.int64, len(part))]

        def answer(total: np.ndarray | None) -> tuple[str, float]:
            if total is None:
                return "und", 0.0
            e = np.exp(total - total.max())
            best = int(e.argmax())
            return m.langs[best], float(e[best] / e.sum())

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []  # (doc_id, words) of short texts, scored together
            size = 0

            def flush() -> Iterator[tuple]:
                nonlocal held, size
                at = np.cumsum([0] + [len(w) for _, w in held])
                got = logs([x for _, w in held for x in w]) if size else None
                for k, (doc_id, w) in enumerate(held):
                    yield doc_id, *answer(m.prior + got[at[k] : at[k + 1]].sum(axis=0) if w else None)
                held, size = [], 0

            for doc_id, text in rows_of(batches):
                parts = words_in(text or "", find)
                first = next(parts, [])
                second = next(parts, None)
                if second is None:
                    held.append((doc_id, first))
                    size += len(first)
                    if size > 100_000 or len(held) >= 2048:
                        yield from flush()
                    continue
                yield from flush()
                total = m.prior.copy()
                for part in itertools.chain((first, second), parts):
                    total = total + logs(part).sum(axis=0)
                yield doc_id, *answer(total)
            yield from flush()

        yield from in_batches(rows(), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of each row; learned from the rows that are not held out."""
    learned = fit(docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT), path, rounds)
    return predict(docs, learned).select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
