import random

import public_tokenizers
import regex

from marquee.llm import wordpiece as wp


def greedy(word, pieces):
    rest, n = (*word, wp.END), 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not k:
            return 0
        rest, n = rest[k:], n + 1
    return n


def test_small_vocabularies():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {tuple(rng.choice([1, 2, 3, wp.END]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = wp.Automaton(pieces)
        for _ in range(200):
            word = [rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 9))]
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_rows(spark, docs, edge_pairs):
    pieces = set(wp.read_pieces(public_tokenizers.path("word_bpe_49k.json")))
    want = []
    for i, t in edge_pairs:
        words = regex.findall(wp.WORDS, (t or "").lower())
        known = {w: greedy(w.encode(), pieces) if len(w) < 1000 else None for w in set(words)}
        if None not in known.values():
            want.append((i, len(words), sum(known[w] or 1 for w in words), sum(known[w] == 0 for w in words)))
    got = [tuple(r) for r in wp.token_counts(spark, docs(edge_pairs, more=("n_words",))).collect()]
    assert sorted((g for g in got if g[0] != 12), key=str) == sorted(want, key=str)
    assert [g[1] for g in got if g[0] == 12] == [1]
    assert wp.token_counts(spark, docs([(1, "a")]).where("doc_id = 2")).collect() == []


def test_lazy_split_and_memory_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(wp, "REMEMBERED", 2)
    monkeypatch.setattr(wp, "LONG_TEXT", 5)
    r = wp.token_counts(spark, docs([(1, "The river walked, the river 42 é")])).first()
    assert r.n_words == 9
