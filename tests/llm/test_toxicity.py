import random

import numpy as np
import pytest

from marquee.llm import toxicity as tx

from .conftest import prose


def corpus(n=900):
    rng = random.Random(7)
    bad = ["fool", "rotten", "vile", "zork" ]
    pairs, labels = [], []
    for i in range(n):
        words = prose(rng.randint(20, 80), i).split()
        y = rng.random() < 0.25
        if y:
            for _ in range(rng.randint(1, 4)):
                w = rng.choice(bad)
                words.insert(rng.randrange(len(words)), w + (rng.choice(["ab", "en", "ix"]) if w == "zork" else ""))
        elif rng.random() < 0.03:
            words.insert(0, rng.choice(bad))
        pairs.append((i, " ".join(words)))
        labels.append((i, 0, int(y)))
    return pairs, labels


@pytest.fixture(scope="module")
def fitted(spark, docs):
    pairs, labels = corpus()
    df, lab = docs(pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return df, lab, tx.fit(df, lab)


def test_held_out_accuracy(fitted):
    df, lab, model = fitted
    truth = {r.doc_id: r.toxic for r in lab.collect()}
    rows = [r for r in tx.scores(df, model).collect() if r.held_out]
    # a single word of the lexicon is about as likely in a clean text as the threshold allows: ranks are surer than decisions
    pos, neg = (np.array([r.score for r in rows if truth[r.doc_id] == y]) for y in (1, 0))
    assert ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) > 0.97
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert any(t.startswith("zork") for t in model.terms)


def test_labels_of_the_held_out_fold_change_nothing(spark, docs, fitted):
    df, lab, model = fitted
    turned = [(r.doc_id, r.quality, 1 - r.toxic if h else r.toxic) for r in lab.collect() for h in [tx_held(r.doc_id)]]
    again = tx.fit(df, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert again.terms == model.terms and np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)


def tx_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_inputs_are_texts_alone(docs, fitted):
    pairs, _ = corpus(40)
    one = {r.doc_id: r.score for r in tx.scores(fitted[0], fitted[2]).collect()}
    moved = tx.scores(docs([(i + 5000, t) for i, t in pairs], more=("score", "toxic")), fitted[2])
    assert {r.doc_id - 5000: r.score for r in moved.collect()} == {i: one[i] for i, _ in pairs}


def test_label_model_weighs_copies_less():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = [np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(4)]
    weak = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.3)
    v = np.array([*good, weak, weak, weak], float).T
    given = np.where(rng.random(4000) < 0.1, ~y, y)
    post, weight = tx.label_model(v, given.astype(float))
    assert weight[4:].max() < 0.35 and weight[4:].max() < weight[:4].min()
    assert ((post > 0.5) == given).mean() > 0.95


def test_edges(spark, docs, fitted, edge_pairs):
    df, lab, model = fitted
    edge = docs(edge_pairs, more=("_toxic", "toxic"))
    got = tx.scores(edge, model).collect()
    empty = model.score(model.votes("", {}))
    assert len(got) == len(edge_pairs) and {r.score for r in got if r.doc_id in (3, 4)} == {empty}
    assert tx.drop_toxic(edge, model).columns == edge.columns and tx.drop_toxic(edge, model).count() == sum(r.score < 0.7 for r in got)
    none = spark.createDataFrame([(1, 0, None), (None, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in tx.scores(edge, tx.fit(edge, none)).collect()} == {0.0}
    assert tx.scores(edge.where("doc_id = 77"), model).collect() == []
