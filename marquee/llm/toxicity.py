"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters (does it hold a word, or a word with a certain beginning) and pattern voters (shouting,
exclamation marks, second person, several lexicon hits, none at all). A generative model with a hidden class estimates how often each
voter, the given label among them, fires in either class, by expectation maximisation, and how voters are correlated inside the classes; a voter that mostly repeats others
counts for less. The posterior labels train a linear classifier over the voters, whose score is then set on the scale of the given
labels.

Labels are learned from only where crc32(doc_id as text) mod 3 is not 1, and from at most ``SAMPLE_ROWS`` rows, those of least hash. The lexicon
is mined from them: counts are taken in the tasks and summed before the shuffle, and the driver gets at most ``CANDIDATES`` terms and the
votes on the sample. Scoring is one pass over the texts with the small model in hand; nothing is shuffled.

Defined cases: null texts are empty ones and get the score of a text on which no voter fires; of several labels of an id the largest
holds; null labels count as none; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, in_batches, remainder, rows_of, table, texts

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SAMPLE_ROWS = 12_000
CANDIDATES = 4_000
TERMS = 400
PREFIXES = range(3, 8)
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")
SECOND_PERSON = {"you", "your", "du", "dich", "dein", "tu", "toi", "ton", "tú", "usted"}
PATTERNS = ("no term", "two terms", "three terms", "two words", "three words", "shouting", "exclamation", "second person", "short")


def terms_of(word: str) -> list[str]:
    """A whole word, marked by its end, and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    terms: dict[str, int]
    weights: np.ndarray
    bias: float

    def votes(self, text: str, known: dict[str, tuple[int, ...]]) -> list[int]:
        """The voters that fire."""
        found: set[int] = set()
        words_hit = 0
        words = set(WORD.findall(text.lower()))
        for w in words:
            if (hit := known.get(w)) is None:
                hit = known[w] = tuple(self.terms[t] for t in terms_of(w) if t in self.terms)
            if hit:
                found.update(hit)
                words_hit += 1
        if len(known) > REMEMBERED:
            known.clear()
        n, size = len(self.terms), max(1, len(text))
        upper = sum(map(str.isupper, text)) if found else 0  # only matters beside lexicon hits
        fired = (not found, len(found) >= 2, len(found) >= 3, words_hit >= 2, words_hit >= 3, bool(found) and upper > size // 2, bool(found) and text.count("!") * 50 > size,
                 bool(found) and not SECOND_PERSON.isdisjoint(words), len(words) < 5)
        return [*found, *(n + i for i, x in enumerate(fired) if x)]

    def score(self, votes: list[int]) -> float:
        x = self.bias + self.weights[votes].sum()
        return float(1 / (1 + np.exp(-min(x, 40.0)))) if x > -700 else 0.0


def label_model(v: np.ndarray, anchor: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row of the vote matrix, and the voters' weights for correlation.

    ``anchor`` is one more voter, the given label, of unknown accuracy as all of them; it keeps its weight and, nearly believed, is the start, so
    that the hidden class stays what the labels mean rather than what most copies of a voter say. Each round estimates the voters' rates in either class, then the posteriors. The
    correlations inside the classes are taken from the posteriors at the start, after a third and after two thirds of the rounds.
    """
    v = np.hstack([v, anchor[:, None]]).astype(np.float32)  # the largest thing on the driver: SAMPLE_ROWS x TERMS
    post, weight = 0.03 + 0.92 * anchor, np.ones(v.shape[1])
    for k in range(rounds):
        a, b = post.sum() + 2, (1 - post).sum() + 2
        r1, r0 = (post @ v + 0.5) / a, ((1 - post) @ v + 0.5) / b
        if k in (0, rounds // 3, 2 * rounds // 3):  # at once: copies would else become the hidden class
            total = np.zeros((v.shape[1], v.shape[1]))
            for p, r in ((post, r1), (1 - post, r0)):
                c = (v - r.astype(np.float32)) * np.sqrt(p).astype(np.float32)[:, None]
                cov = c.T @ c
                d = np.sqrt(np.maximum(cov.diagonal(), 1e-9))
                total = np.maximum(total, np.clip(cov / d / d[:, None], 0, 1))
            weight = 1 / np.maximum(1, total.sum(axis=1))
            weight[-1] = 1
        on, off = np.log(r1 / r0) * weight, np.log((1 - r1) / (1 - r0)) * weight
        x = v @ (on - off) + off.sum() + np.log(a / b)
        post = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    return post, weight[:-1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, int]:
    """Terms much likelier in toxic texts; of those with equal counts the longest word beginning stays."""
    best: dict[tuple, tuple] = {}
    for term, n1, n0 in rows:
        odds = np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))
        if odds >= 2.5:
            key = (n1, n0, term[:3])
            best[key] = max(best.get(key, (0, 0, "")), (len(term), n1 * odds, term))
    chosen = sorted(best.values(), key=lambda x: (-x[1], x[2]))[:TERMS]
    return {t: i for i, (_, _, t) in enumerate(chosen)}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text``, ``toxic`` of at most ``SAMPLE_ROWS`` labelled ids that may be learned from."""
    ids = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
           .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    return texts(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most SAMPLE_ROWS ids


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    empty = Model({}, np.zeros(len(PATTERNS)), -1e9)
    rows = sample(docs, labels)
    counted = pa.schema([("term", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for text, toxic in rows_of(batches):
            seen[toxic].update({t for w in set(WORD.findall(text.lower())) for t in terms_of(w)})
            seen[toxic][""] += 1
        yield from in_batches(((t, seen[1][t], seen[0][t]) for t in seen[0].keys() | seen[1].keys()), counted)

    sums = rows.mapInArrow(count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # enough rows, and not mainly clean ones; the row of all texts has the empty term
    top = sums.where((F.col("term") == "") | (F.col("n1") >= 5) & (F.col("n1") > 2 * F.col("n0"))).orderBy(F.col("term") != "", F.desc(F.col("n1") - 4 * F.col("n0")), "term").limit(CANDIDATES).collect()
    if not top or top[0].term != "" or not top[0].n1 or not top[0].n0:
        return empty
    terms = choose_terms([(r.term, r.n1, r.n0) for r in top[1:]], top[0].n1, top[0].n0)
    voter = Model(terms, np.zeros(len(terms) + len(PATTERNS)), 0.0)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        schema = pa.schema([("votes", pa.list_(pa.int32())), ("toxic", pa.int32())])
        yield from in_batches(((voter.votes(t, known), y) for t, y in rows_of(batches)), schema)

    got = sorted((tuple(sorted(r.votes)), r.toxic) for r in rows.mapInArrow(vote, "votes array<int>, toxic int").collect())
    v = np.zeros((len(got), len(voter.weights)), np.float32)
    for i, (fired, _) in enumerate(got):
        v[i, list(fired)] = 1
    y = np.array([t for _, t in got], float)
    post, _ = label_model(v, y)
    w, b = logistic(v, post, 1.0)
    scale, shift = logistic((v @ w + b)[:, None], y, 1e-3)  # on the scale of the labels
    return Model(terms, w * scale[0], b * scale[0] + shift)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        yield from in_batches(((i, model.score(model.votes(t, known))) for i, t in rows_of(batches)), schema)

    return (texts(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    flag = fresh(docs, "_toxic")

    @F.pandas_udf("double")
    def score(s):  # noqa: ANN001, ANN202
        known: dict = {}
        return s.map(lambda t: model.score(model.votes(t or "", known)))

    return docs.withColumn(flag, score(F.col("text").cast("string"))).where(F.col(flag) < threshold).drop(flag)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
