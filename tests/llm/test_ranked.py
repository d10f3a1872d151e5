import collections
import math
import random
import re

import numpy as np
import pytest

from marquee.llm import ranked
from tests.llm.conftest import SCHEMA, prose

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))


def plain(pairs, items, k=50):
    counts = [(i, collections.Counter(terms(t))) for i, t in pairs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = collections.Counter()
    for item, wanted in asked.items():
        rows = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(rows, key=lambda r: r[:3])[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def ran(df, items, spark, **how):
    rows = ranked.search(df, spark.createDataFrame(items, ITEMS), **how).collect()
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in rows)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(2)
    return [(i, prose(rng.choice((1, 5, 40, 200)), i % 70)) for i in range(300)]


@pytest.fixture(scope="module")
def items():
    """Items that share much: pieces of one another."""
    base = [prose(30, s).split() for s in range(5)]
    rng = random.Random(4)
    return [(k, " ".join(rng.sample(base[k % 5], 12) + rng.sample(base[(k + 1) % 5], 6))) for k in range(40)]


def test_against_plain_scores(docs, pairs, items, spark):
    assert ran(docs(pairs, parts=5), items, spark) == plain(pairs, items)


def test_small_blocks_and_small_k(docs, pairs, items, spark):
    assert ran(docs(pairs), items[:9], spark, k=3, block_terms=40) == plain(pairs, items[:9], 3)


def test_blocks_of_documents(docs, pairs, items, spark, monkeypatch):
    monkeypatch.setattr(ranked, "CELLS", 1)  # in this process only; the graph is evaluated in blocks of any size below
    q = ranked.Queries([(i, set(x.encode() for x in terms(t))) for i, t in items])
    ev = ranked.Evaluation(q, np.arange(1, len(q.vocabulary) + 1), 10, 100)
    rng = np.random.default_rng(1)
    doc, term = rng.integers(0, 8, 500), rng.integers(0, len(q.vocabulary), 500)
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    times, sizes = rng.integers(1, 9, len(doc)), rng.integers(1, 50, 8)
    whole = ev.scores(sizes, doc, term, times)
    alone = np.hstack([ev.scores(sizes[d : d + 1], doc[doc == d] * 0, term[doc == d], times[doc == d]) for d in range(8)])
    assert (whole == alone).all()


def test_graph_spells_out_each_query(items):
    q = ranked.Queries([(i, set(x.encode() for x in terms(t))) for i, t in items])
    of_class = collections.defaultdict(set)
    for t, number in q.vocabulary.items():
        of_class[q.class_of[number]].add(t)
    parts = {n: (a, b) for level in q.nodes for n, a, b in level}

    def spelled(n):
        return of_class[n] if n < q.leaves else spelled(parts[n][0]) | spelled(parts[n][1])

    assert parts
    for (_, text), s in zip(items, q.sequences, strict=True):
        got = [t for n in s for t in spelled(n)]
        assert sorted(got) == sorted({x.encode() for x in terms(text)})  # each term once
    additions = len(parts) + sum(len(s) for s in q.sequences)
    assert additions < sum(len(set(terms(t))) for _, t in items)


def test_edges(docs, edge_pairs, spark):
    items = [(1, "river stone Bridge"), (1, "quiet"), (2, None), (3, ""), (4, "none-of these_words99"), (None, "walked é 漢字"), (5, "zzz " + "z" * 30000), (6, "river")]
    df = docs(edge_pairs, more=("item_id", "score", "rank", "size", "terms"))
    assert ran(df, items, spark) == plain(edge_pairs, items)
    assert ran(docs([(k, "same words here") for k in (3, 1, 2, 2, None)] + [(9, "other"), (8, "more")]), [(1, "same here")], spark, k=4) == plain(
        [(k, "same words here") for k in (3, 1, 2, 2, None)] + [(9, "other"), (8, "more")], [(1, "same here")], 4)


def test_empty_tables(docs, spark, items):
    empty = spark.createDataFrame([], SCHEMA)
    assert ran(empty, items, spark) == {}
    assert ran(docs([(1, "a b")]), [], spark) == {}
    assert ran(docs([(1, None), (2, " .. ")]), items, spark) == {}


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(ranked, "LONG_TEXT", 7)
    text = "One two-three fOUR é漢 " * 20 + "x" * 50
    assert [t.decode() for part in ranked.terms_of(text) for t in part] == terms(text)
