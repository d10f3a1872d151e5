import collections
import random
import re
import time
import zlib

from marquee.llm import variants
from tests.llm.conftest import SCHEMA


def plain_counts(pairs, shortest=7, fewest=2):
    c = collections.Counter()
    for i, t in pairs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= shortest and n >= fewest}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(pairs):
    """Every word against every other one."""
    words = plain_counts(pairs)
    rows = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * n else None
        rows[w] = [form, n, len(near), words[form] if form else None]
    out = set()
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, near, form_n))
    return out


def ran(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=60, alphabet="abé"):
    """Few letters, so that words are crowded and bigrams repeat; frequent bases with rare variants of them and of those."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 11))) for _ in range(12)]

    def edited(w):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:k] + (rng.choice(alphabet) if kind else "") + w[k + (kind < 2) :]

    words = [w for w in bases for _ in range(rng.choice((3, 40, 400)))]
    words += [x for w in bases for _ in range(40) for x in [edited(w)] * 3] + [edited(edited(w)) for w in bases for _ in range(30)]
    rng.shuffle(words)
    return [(i, " ".join(words[i::n])) for i in range(n)]


def test_against_every_pair(docs):
    for seed in range(3):
        pairs = corpus(seed)
        got = ran(docs(pairs))
        assert got == plain(pairs)
        assert any(r[1] for r in got)


def test_links_are_followed_to_the_last_form(docs):
    pairs = [(1, "walking " * 3 + "walkings " * 40 + "walkingsx " * 500 + "walkingsxy " * 6000)]
    got = {r[0]: r for r in ran(docs(pairs, parts=1))}
    assert got == {r[0]: r for r in plain(pairs)}
    assert got["walking"][2] == got["walkingsxy"][0] if got["walkingsxy"][1] else got["walking"][2] == "walkingsxy"


def test_ties_go_to_the_smaller_form(docs):
    pairs = [(k, "harbourz " + "harboura " * 10 + "harbourb " * 10 + "harbourz ") for k in range(2)]
    got = {r[0]: r for r in ran(docs(pairs))}
    assert got == {r[0]: r for r in plain(pairs)}


def test_long_words_around_the_inline_bound(docs):
    base = "".join(random.Random(5).choice("abcdefgh") for _ in range(66))
    words = [base[:k] for k in (62, 63, 64, 65, 66)] + [base[:64] + "x", base[:63] + "yz", "z" * 3000, "z" * 2999, "z" * 2998, "z" * 40, "z" * 41]
    pairs = [(k, " ".join(words)) for k in range(4)]
    assert ran(docs(pairs)) == plain(pairs)


def test_edges(docs, edge_pairs, spark):
    more = [(20, "straße STRASSE Straße ÀÉÎÕÜñß àéîõüñß Übergang übergang übergang"), (21, "übergang übergang Übergang×÷"), (21, "übergang übergang Übergang×÷")]
    pairs = edge_pairs + more
    df = docs(pairs, more=("word", "n", "root", "key", "a"))
    assert ran(df) == plain(pairs)
    assert variants.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_take_time_in_proportion(docs):
    rng = random.Random(9)
    times = []
    for n in (20_000, 80_000):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(8)) for _ in range(n))
        t = time.perf_counter()
        variants.word_counts(docs([(1, text)], parts=1)).collect()
        times.append(time.perf_counter() - t)
    assert times[1] < 8 * times[0] + 2
