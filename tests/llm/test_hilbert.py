import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import hilbert
from marquee.llm.common import ranked


def test_curve_visits_neighbours():
    for bits, axes in ((3, 3), (4, 2), (1, 3)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=axes))).T
        index = hilbert.curve_index(list(grid), bits)
        assert sorted(index) == list(range(1 << bits * axes))
        assert (np.abs(np.diff(grid[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def check_law(rows, n, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_rows(docs, edge_pairs):
    rows = hilbert.sharded(hilbert.measured(docs(edge_pairs, more=("size", "shard", "_key", "_at")))).collect()
    check_law(rows, len(edge_pairs))
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_pairs)
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_more_rows_and_none(docs):
    pairs = [(i, "word " * (i % 37)) for i in range(1000)]
    check_law(hilbert.sharded(hilbert.measured(docs(pairs)), 7).collect(), 1000, 7)
    assert hilbert.sharded(hilbert.measured(docs([(1, "a")]).where("doc_id = 2"))).collect() == []


def test_shards_cover_small_ranges(docs):
    rows = hilbert.sharded(hilbert.measured(docs([(i, "w" * (2 ** (i % 16))) for i in range(2000)]))).collect()
    spread = [len({(r.source, r.lang) for r in rows if r.shard == s}) for s in range(16)]
    assert sum(spread) / 16 < 0.5 * len({(r.source, r.lang) for r in rows})


def test_written_shards(spark, docs, tmp_path):
    pairs = [(i, f"text {i}") for i in range(100)]
    hilbert.write_shards(docs(pairs), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(pairs)
    check_law(back.collect(), 100, 4)


def test_written_shards_keep_all_columns(spark, docs, tmp_path):
    more = ("shard", "size", "_row", "curve", "_source_cell", "_rank")
    df = docs([(i % 90, f"text {i}") for i in range(400)] + [(None, None)], more=more)
    hilbert.write_shards(df, str(tmp_path / "out"), 3, 12)
    back = spark.read.parquet(str(tmp_path / "out"))
    own = ["_" + c if c in hilbert.ADDED else c for c in df.columns]
    assert sorted(back.columns) == sorted([*own, *hilbert.ADDED])
    assert sorted(map(tuple, map(str, back.select(*own).toDF(*df.columns).collect()))) == sorted(map(tuple, map(str, df.collect())))
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count().collect()
    assert len(files) == 3 and all(r["count"] > 1 for r in files)


def walk(bits):
    """The place of each cell on the curve."""
    grid = np.array(list(itertools.product(range(1 << bits), repeat=3)))
    index = hilbert.curve_index(list(grid.T), bits)
    return {tuple(c): int(i) for c, i in zip(grid.tolist(), index, strict=True)}


def test_table_equals_brute_force(docs, edge_pairs):
    pairs = edge_pairs + [(i, "word " * (i % 53)) for i in range(100, 400)]
    df = docs(pairs)
    given = df.collect()
    cells, place = walk(hilbert.BITS), {}
    for name in ("source", "lang"):
        names = sorted({r[name] or "" for r in given})
        place[name] = {x: (1 << hilbert.BITS) * k // len(names) for k, x in enumerate(names)}
    plain = []
    for r in given:
        data = (r.text or "").encode()
        size = len(data) + 1
        cell = (place["source"][r.source or ""], place["lang"][r.lang or ""], min(31, int(np.floor(np.log2(size) * 1.25))))
        plain.append((cells[cell], zlib.crc32(data), -(2**70) if r.doc_id is None else r.doc_id, size))
    plain.sort()
    n, want, last = len(plain), [], {}
    for rank, (at, crc, doc_id, size) in enumerate(plain):
        shard = rank * 16 // n
        last[shard] = last.get(shard, -1) + 1
        want.append((shard, last[shard], at, crc, size, doc_id))
    got = sorted((r.shard, r.slot, r["curve"], r.text_crc32, r.size, -(2**70) if r.doc_id is None else r.doc_id) for r in hilbert.sharded(hilbert.measured(df)).collect())
    assert got == want


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    got = sorted((r.at, r.k, r.id) for r in ranked(df, F.desc("k"), F.col("id"), name="at").collect())
    assert [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted([g[1:] for g in got], key=lambda x: (-x[0], x[1]))
    assert ranked(df.where("id < 0"), F.col("id"), name="at").collect() == []
