"""Connected components against a plain union, with hubs whose edges are dealt over tasks."""

import random

import pyarrow as pa
import pytest

from marquee.llm import components as module
from marquee.llm.components import components


def plain(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def graphs():
    rng = random.Random(3)
    hub = [(10**6 + k, 5 if k % 2 else 10**7) for k in range(900)] + [(5, 10**7)]
    chain = [(k, k + 1) for k in range(2000, 2100)]
    loose = [(rng.randint(-300, 300) * 7, rng.randint(-300, 300) * 7) for _ in range(250)]
    return {"hub": hub, "chain": chain, "all": hub + chain + loose + hub[:20] + [(4, 4)], "none": []}


@pytest.mark.parametrize("size", [3, 256])
@pytest.mark.parametrize("name", ["all", "none"])
def test_same_as_plain_union(spark, monkeypatch, name, size):
    monkeypatch.setattr(module, "HUB", size)
    edges = graphs()[name]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])


def test_edges_of_a_hub_are_dealt(spark):
    rows = spark.createDataFrame([(1, k) for k in range(4000)] + [(k, 1) for k in range(2, 500)], "u long, v long")
    got = module.hung(rows, rows.count())
    assert got.count() == 4498
    assert {r.m for r in got.where("u = 1").collect()} == {0}
    assert {r.m for r in got.where("u > 1").collect()} == {1}
    assert "part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_few_edges_take_few_tasks(spark):
    """The pipeline's finding of round 3: with many shuffle partitions the files of a round's tasks, however few its edges, filled the disk."""
    rng = random.Random(11)
    edges = graphs()["hub"] + graphs()["chain"] + [(rng.randint(0, 500) * 3, 10**8 + rng.randint(0, 99)) for _ in range(2000)]
    frame, parts, before = spark.createDataFrame(edges, "a long, b long").coalesce(1), 40, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        got = {r.node: r.root for r in components(frame).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(edges)
    seen = spark.sparkContext.statusTracker()
    stages = {s: seen.getStageInfo(s) for j in seen.getJobIdsForGroup("rounds") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(s.numCompletedTasks for s in stages.values() if s)
    assert tasks < 30 * parts, tasks


def test_stars_hold_whole_nodes(spark, monkeypatch):
    """Edges are held some at a time, but those of one node together."""
    edges = sorted((max(e), min(e)) for e in graphs()["all"] if e[0] != e[1])
    batches = [pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges[at : at + 7]]) for k in (0, 1)], ["u", "v"]) for at in range(0, len(edges), 7)]
    monkeypatch.setattr(module, "HELD", 20)
    made = [[tuple(r.values()) for r in b.to_pylist()] for b in module._stars(iter(batches))]
    assert len(made) > 3
    assert plain([e for rows in made for e in rows]) == plain(edges)
    ask, of = {e[0] for e in edges}, {}
    for i, rows in enumerate(made):
        assert all(u > v for u, v in rows) and len({u for u, _ in rows}) == len(rows)
        for u, v in rows:
            of.setdefault(u, []).append((i, v))
    for u in ask:  # one task's piece has linked all that u links
        mine = {b for a, b in edges if a == u}
        assert any(len({dict(made[i]).get(x, x) for x in mine}) == 1 for i, _ in of[u])


def test_rounds_work_on_open_edges_only(spark, monkeypatch):
    """The pipeline's finding of round 3: every round gave all edges again, settled ones too, so that their sum grew with the number of rounds."""
    rng = random.Random(5)
    groups = [rng.sample(range(10**6 * k, 10**6 * (k + 1)), 12) for k in range(400)]
    edges = [(g[0], x) for g in groups for x in g[1:]] + [e for g in groups[::8] for e in zip(g, g[1:], strict=False)]
    edges += [(10**9 + 7 * k, 10**9 + 7 * k + 7) for k in range(120)]
    rng.shuffle(edges)
    frame, made, stars = spark.createDataFrame(edges, "a long, b long").repartition(16), [], module.stars

    def counted(e):
        out = stars(e)
        made.append(out.count())
        return out

    monkeypatch.setattr(module, "stars", counted)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.root for r in components(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert got == plain(edges)
    assert len(made) > 2 and sum(made) < 2 * len(edges), made
