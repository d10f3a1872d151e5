"""Near copies by whole texts against comparing every pair, in the pipeline's stage."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from marquee.llm import near_text

from .conftest import prose
from .test_simhash import classes, fingerprint


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def linked(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])]
    for x, y in pairs:
        up[root(x)] = root(y)
    return [root(x) for x in range(len(sets))], pairs


def edited(text, edits, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"w{rng.randint(0, 10**6)}"
    return " ".join(words)


def planted(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        base = prose(rng.randint(60, 300), 1000 * seed + k)
        out += [base] + [edited(base, rng.randint(1, len(base.split()) // 25), rng) for _ in range(3)]
    return out


@pytest.mark.parametrize("shard", [3, 1024])
def test_stage_keeps_one_of_each_group(spark, docs, edge_pairs, monkeypatch, shard):
    monkeypatch.setattr(near_text, "SHARD", shard)
    pairs = edge_pairs + list(enumerate(planted(40, 1), 1000)) + [(None, prose(40, 2).upper())]
    random.Random(2).shuffle(pairs)
    df = docs(pairs, more=("_node", "_least", "root"))
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    group, links = linked([shingles(t) for _, t in pairs])
    want = {}
    for (i, _), g in zip(pairs, group, strict=True):
        want[g] = min(want.get(g, (2, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want.values())
    # most of these are further apart than 3 bits of the fingerprint
    bits = [fingerprint(t) for _, t in pairs]
    three = classes(bits)
    assert sum(three[x] != three[y] for x, y in links) > 20


def test_pairs_of_a_shard_equal_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, rng.integers(0, 16)).astype(np.uint64)) for _ in range(150)]
    ask, tree = np.arange(0, 100), np.arange(50, 150)
    got = {(int(a), int(b)) for x, y in near_text.like_pairs(sets, ask, tree) for a, b in zip(x, y, strict=True)}
    plain = [set(s.tolist()) for s in sets]
    assert got == {(a, b) for a in ask.tolist() for b in tree.tolist() if a != b and plain[a] and 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}


def test_likeness_of_exactly_four_fifths_counts(spark, docs):
    words = [f"w{i}" for i in range(13)]
    a, b = " ".join(words[:12]), " ".join(words[:13])  # 8 and 9 shingles
    c, d = " ".join(f"v{i}" for i in range(8)), " ".join(f"v{i}" for i in range(9))  # 4 and 5: exactly 0.8
    assert likeness(shingles(c), shingles(d)) == 0.8
    keys = [set(near_text.keys(near_text.shingles(t))) for t in (a, b, c, d)]
    assert keys[0] & keys[1] and keys[2] & keys[3] and not keys[0] & keys[2]
    got = corpus_pipeline.near_copies(spark, docs([(1, a), (2, b), (3, c), (4, d), (5, "other words than those")]), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 5]


def test_empty_table(spark, docs):
    assert corpus_pipeline.near_copies(spark, docs([(1, "a")]).where("doc_id = 2"), "").collect() == []
