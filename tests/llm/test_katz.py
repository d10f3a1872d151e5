import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marquee.llm import katz

from .conftest import prose


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Brute:
    def __init__(self, pairs):
        self.c1, self.c2, self.ch, self.after = Counter(), Counter(), Counter(), defaultdict(set)
        for i, t in pairs:
            if not held_out(i):
                h = "\0start"
                for w in tokens(t):
                    self.c1[w] += 1
                    self.c2[h, w] += 1
                    self.ch[h] += 1
                    self.after[h].add(w)
                    h = w
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = (katz.discounts(np.array([sum(x == r for x in c.values()) for r in range(1, 7)], float)) for c in (self.c1, self.c2))
        freed = sum(c - self.cut(c, self.d1) for c in self.c1.values())
        self.total = self.n + (freed == 0)
        self.unknown = (freed or 1) / self.total

    @staticmethod
    def cut(c, d):
        return c * (d[c] if c <= 5 else 1)

    def p1(self, w):
        return self.cut(self.c1[w], self.d1) / self.total if w in self.c1 else self.unknown

    def p(self, h, w):
        if not self.ch[h]:
            return self.p1(w)
        freed = sum(self.c2[h, x] - self.cut(self.c2[h, x], self.d2) for x in self.after[h])
        total = self.ch[h] + (freed == 0)
        if (h, w) in self.c2:
            return self.cut(self.c2[h, w], self.d2) / total
        return (freed or 1) / total / (1 - sum(map(self.p1, self.after[h]))) * self.p1(w)

    def row(self, i, t):
        h, score, base = "\0start", 0.0, 0.0
        for w in tokens(t):
            score, base, h = score + math.log10(self.p(h, w)), base + math.log10((self.c1[w] + 1) / (self.n + self.v + 1)), w
        return i, held_out(i), len(tokens(t)), sum(w in self.c1 for w in tokens(t)), self.n, base, score


def compare(got, pairs):
    brute = Brute(pairs)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted((brute.row(i, t) for i, t in pairs), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk_tokens", [1, 500, 10**6])
def test_rows_equal_brute_force(docs, edge_pairs, chunk_tokens):
    pairs = [(i, t if t is None or len(t) < 9000 else t[:6000]) for i, t in edge_pairs] + [(i, prose(90, i)) for i in range(100, 130)]
    compare(katz.score(docs(pairs, more=("score", "words", "chunk")), buckets=5, chunk_tokens=chunk_tokens), pairs)


def test_probabilities_sum_to_one():
    pairs = [(i, prose(90, i)) for i in range(100, 130)] + [(200, "same same same same same same same same same same same same same")]
    brute = Brute(pairs)
    for h in ["\0start", "same", *sorted(brute.c1)[:40]]:
        rest = brute.p(h, "never seen")
        assert sum(brute.p(h, w) for w in brute.c1) + rest == pytest.approx(1)


def test_no_training_texts(docs):
    pairs = [(i, "a b") for i in range(40) if held_out(i)]
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in katz.score(docs(pairs)).collect())
    assert katz.score(docs(pairs).where("doc_id = -1")).collect() == []


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        small = rng.integers(0, 2**20, n)
        assert katz.unpack_small(katz.pack_small(small)).tolist() == small.tolist()
        keys = np.sort(rng.integers(0, 2**64, n, np.uint64))
        at, low = katz.cuts(keys, 7), katz.lows(7)
        assert np.array_equal(np.concatenate([katz.unpack_keys(katz.pack_keys(keys[at[b] : at[b + 1]], low[b]), low[b]) for b in range(7)]), keys)


def test_better_than_base_on_held_out_texts(docs):
    pairs = [(i, " ".join(["the river runs under the old bridge and the boats pass"] * 4 + [prose(20, i)])) for i in range(60)]
    rows = [r for r in katz.score(docs(pairs)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
