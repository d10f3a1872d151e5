import random
import re

import numpy as np
import pytest
import xxhash

from marquee.llm import simhash
from marquee.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(values, radius=3):
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(values)):
        for y in range(x):
            if (values[x] ^ values[y]).bit_count() <= radius:
                up[root(x)] = root(y)
    return [root(x) for x in range(len(values))]


def test_rows_equal_brute_force(docs, edge_pairs):
    got = sorted((tuple(r) for r in simhash.near_groups(docs(edge_pairs, more=("fp", "root", "least"))).collect()), key=str)
    fps = [fingerprint(t) for _, t in edge_pairs]
    group = classes(fps)
    least = {g: min((i for (i, _), h in zip(edge_pairs, group, strict=True) if h == g and i is not None), default=None) for g in group}
    assert got == sorted(((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(edge_pairs, fps, group, strict=True)), key=str)


def near(value, flips, rng):
    for b in rng.sample(range(64), flips):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("shard", [4, 1024])
def test_links_span_all_near_pairs(spark, shard):
    rng = random.Random(shard)
    values = {0, (1 << 64) - 1}
    for _ in range(20):
        centre = rng.getrandbits(64)
        values |= {near(centre, rng.randint(0, 4), rng) for _ in range(12)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long").repartition(5)
    got = {r.node % 2**64: r.root for r in components(simhash.links(df, shard=shard)).collect()}
    want = classes(values)
    for x in range(len(values)):
        for y in range(x):
            a, b = got.get(values[x], ("alone", x)), got.get(values[y], ("alone", y))
            assert (a == b) == (want[x] == want[y])


def test_forest_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    shard = np.sort(rng.integers(0, 5, 400))
    fp = rng.integers(0, 1 << 10, 400).astype(np.uint64)
    forest = simhash.Forest(shard, fp)
    found = {(int(q), int(n)) for qs, ns in forest.search(shard, fp, 2) for q, n in zip(qs, ns, strict=True)}
    assert found == {(i, j) for i in range(400) for j in range(400) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(docs, edge_pairs):
    df = docs(edge_pairs, more=("_fp", "_component", "least"))
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    fps = [fingerprint(t) for _, t in edge_pairs]
    group = classes(fps)
    want = {}
    for (i, _), g in zip(edge_pairs, group, strict=True):
        want[g] = min(want.get(g, (2, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(want.values())


def test_empty_table(docs):
    none = docs([(1, "a")]).where("doc_id = 2")
    assert simhash.near_groups(none).collect() == [] and simhash.drop_near_copies(none).collect() == []
