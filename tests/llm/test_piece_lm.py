import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import piece_lm
from marquee.llm.common import remainder
from tests.llm.conftest import SCHEMA

PIECES = sorted({"▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "c"})


def segmentations(word, lattice, index):
    """Every way to cut a marked word, as lists of piece numbers."""
    out = []
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        numbers = [index.get(p, lattice.other if len(p) == 1 else None) for p in parts]
        if None not in numbers:
            out.append(numbers)
    return out


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(1)
    lattice = piece_lm.Lattice(PIECES)
    p = rng.random((lattice.absent, 2))
    return lattice, np.vstack([p / p.sum(axis=0), np.zeros((1, 2))]), {x: i for i, x in enumerate(PIECES)}


def test_scores_sum_over_all_segmentations(small):
    lattice, p, index = small
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abcx", repeat=n)]
    got = piece_lm.word_scores(lattice, p, words)
    for w, row in list(zip(words, got, strict=True))[::7]:
        want = sum(np.prod(p[s], axis=0) for s in segmentations("▁" + w, lattice, index))
        assert np.allclose(np.exp(row), want)


def test_expected_counts(small):
    lattice, p, index = small
    counts = {"abab": 3, "c": 1, "baxa": 2, "aab": 5}
    want = np.zeros(lattice.absent)
    for w, n in counts.items():
        cuts = segmentations("▁" + w, lattice, index)
        weights = np.array([np.prod(p[s, 0]) for s in cuts])
        for s, share in zip(cuts, weights / weights.sum(), strict=True):
            np.add.at(want, s, n * share)
    assert np.allclose(piece_lm.expected(lattice, np.ascontiguousarray(p[:, 0]), counts), want)


def test_long_word_does_not_vanish(small):
    lattice, p, _ = small
    a, b = piece_lm.word_scores(lattice, p, ["ab" * 5000, "ab" * 10000])
    assert np.isfinite(a).all() and np.allclose(b / a, 2, rtol=1e-3)


def _texts(n, seed=0):
    rng = random.Random(seed)
    own = {"xx": ("the", "river", "stone", "walking", "and", "under"), "yy": ("der", "fluss", "stein", "gehen", "und", "unter")}
    return [(i, " ".join(rng.choice(own[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(n) for lang in [("xx", "yy")[rng.random() < 0.3]]]


def test_held_out_accuracy_and_inputs(spark):
    rows = _texts(300)
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA).repartition(4)
    out = piece_lm.identify(df).collect()
    lang = {i: x for i, _, x in rows}
    assert len(out) == 300 and any(r.held_out for r in out)
    assert all(r.lang_pred == lang[r.doc_id] and 0.5 <= r.score <= 1 for r in out)
    # the language of held-out rows is never looked at
    hidden = df.withColumn("lang", F.when(remainder(F.col("doc_id"), 4) == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in piece_lm.identify(hidden).collect()} == {(r.doc_id, r.lang_pred) for r in out}


def test_learned_mixture_beats_first_pieces(spark):
    """Rounds of expectation maximisation raise the likelihood of the training words."""
    df = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t, _ in _texts(60, 3)], SCHEMA)
    likelihood = []
    for rounds in (1, 2, 3):
        m = piece_lm.fit(df, rounds=rounds)
        likelihood.append(piece_lm.word_scores(m.lattice, m.p, ["river", "stein", "walking", "gehen"]).sum())
    assert likelihood == sorted(likelihood)


def test_edges(docs, edge_pairs):
    df = docs(edge_pairs, more=("word", "score", "lang_pred", "n"))
    out = piece_lm.identify(df).collect()
    assert len(out) == len(edge_pairs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, _ in edge_pairs)
    for r in out:
        if r.doc_id in (3, 4, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
    assert len({(r.lang_pred, r.score) for r in out if r.doc_id == 5}) == 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert piece_lm.identify(empty).collect() == []
    no_lang = spark.createDataFrame([(1, "some words", None, "s", 0), (2, "1234", None, "s", 0)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in piece_lm.identify(no_lang).collect()} == {("und", 0.0)}


def test_without_letters(spark):
    rows = [(i, t, lang, "s", 0) for i, t, lang in _texts(40)] + [(1000, "12 34 !!", "xx", "s", 0), (1001, "漢字 слово", "yy", "s", 0)]
    got = {r.doc_id: r for r in piece_lm.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000].lang_pred == "und" and got[1001].lang_pred in ("xx", "yy")
