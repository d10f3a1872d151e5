import random

import numpy as np
import pytest

from marquee.llm import tiling

from .conftest import prose


def naive(a, b, seed):
    free_a, free_b, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best[2]:
                    best = (i, j, k)
        i, j, k = best
        if k < seed:
            return out
        for x in range(k):
            free_a[i + x] = free_b[j + x] = False
        out.append(best)


def test_tiles_of_random_sequences():
    rng = random.Random(3)
    for _ in range(1200):
        a, b = (np.array([rng.randint(low, 3) for _ in range(rng.randint(1, n))]) for low, n in ((0, 14), (-1, 25)))
        seed = rng.randint(1, 4)
        assert tiling.tile(a, b, seed) == naive(a, b, seed)


def brute(pairs, items, seed=4, share=0.6):
    out = []
    for i, t in pairs:
        for item, text in items:
            a, b = tiling.words(text), tiling.words(t)
            if a and b and len(b) < 2000:
                number = {w: k for k, w in enumerate(dict.fromkeys(a))}
                tiles = naive([number[w] for w in a], [number.get(w, -1) for w in b], min(seed, len(a)))
                under = sum(x[2] for x in tiles)
                if under >= share * len(a):
                    out.append((i, item, len(a), len(tiles), under, under / len(a)))
    return sorted(out, key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank at dawn"), (2, "One two, three!"), (3, None), (4, ""), (5, prose(30, 8)), (None, "a null id item with some words in it"), (1, "the quick brown fox jumps over it")]


def texts():
    fox = ITEMS[0][1]
    w = fox.lower().split()
    return [(1, fox.upper()), (2, "x " * 50 + " ".join(w[8:] + ["and"] + w[:8]) + " y" * 20), (3, " ".join(w[:6])), (4, "say one two three now"), (5, None), (6, ""), (7, prose(300, 9)), (8, ITEMS[4][1] + " " + ITEMS[4][1]),
            (8, "quick fox brown the dog lazy"), (None, fox), (1, fox.upper()), (9, "a null id item with some words in it"), (10, prose(40, 10) + " " + ITEMS[4][1] + prose(30, 11))]


@pytest.mark.parametrize("block", [3, 10**6])
def test_rows_equal_brute_force(spark, docs, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnRenamed("x", "doc_id")
    df = docs(texts(), more=("item_id", "coverage"))
    got = sorted((tuple(r) for r in tiling.contaminated(df, bench, block_words=block).collect()), key=str)
    want = brute(texts(), ITEMS)
    assert got == want and {g[0] for g in got} >= {1, 2, 4, 8, 9, 10, None}
    kept = tiling.drop_contaminated(df, bench, block_words=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in texts() if not brute([(i, t)], ITEMS)) == [5, 6, 7, 8]


def test_empty_tables(spark, docs, edge_pairs):
    none = spark.createDataFrame([], "item_id long, text string")
    df = docs(edge_pairs)
    assert tiling.contaminated(df, none).collect() == [] and tiling.drop_contaminated(df, none).count() == len(edge_pairs)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert tiling.contaminated(df.where("doc_id = 77"), bench).collect() == []
    assert tiling.contaminated(df, bench).count() == len(brute(edge_pairs, ITEMS))


def test_window_hashes_agree_with_windows():
    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6, 3, 1, 4, 1, 5])
    for k in range(1, 14):
        h = tiling.window_hashes(ids, k)
        same = {(i, j) for i in range(len(h)) for j in range(len(h)) if h[i] == h[j]}
        assert same == {(i, j) for i in range(len(h)) for j in range(len(h)) if (ids[i : i + k] == ids[j : j + k]).all()}


def test_a_seed_of_many_items_tiles_none_of_them(monkeypatch):
    rng = random.Random(6)
    common = "one seed held by all"
    items = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20)) + f" {common} end{i}") for i in range(3000)] + [(-1, f"{common} of us here")]
    block, tiled = tiling.Benchmark(items, 4), []
    plain = tiling.tile
    monkeypatch.setattr(tiling, "tile", lambda a, b, seed: tiled.append(len(a)) or plain(a, b, seed))
    text = f"{prose(50, 3)} {common} {prose(50, 4)} {items[7][1]}"
    got = sorted(x for x in block.compare(text, 0.6) if x[3] >= 0.6 * x[1])
    assert len(tiled) == 2 and got == [(7, 26, 1, 26), (3000, 8, 1, 5)]
    assert got == sorted(x for x in block.compare(text) if x[3] >= 0.6 * x[1]) and len(tiled) == 2 + len(items)


def test_the_bound_loses_no_item():
    rng = random.Random(7)
    draw = [[f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 12))] for _ in range(150)]
    items = [(i, " ".join(w)) for i, w in enumerate(draw[:60])]
    block = tiling.Benchmark(items, 3)
    for words in draw[60:]:
        text = " ".join(words)
        for share in (0.3, 0.6, 1.0):
            got = sorted((items[i][0], n, t, under) for i, n, t, under in block.compare(text, share) if under >= share * n)
            assert got == sorted(x[1:5] for x in brute([(0, text)], items, 3, share))
