"""One test for each finding of the third round."""

import datetime
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee import schema, session
from marquee.functions import dates
from marquee.functions.tree import Page
from marquee.llm import near_text
from marquee.operators import crowded, dedup
from marquee.plans.queries import P
from marquee.sources import pages, sheet
from tests.llm.test_near_text import linked
from tests.test_dedup import row, scan, survivors

D = datetime.date


def test_old_leap_days_of_a_sheet_are_no_errors(spark):
    """29 February of a leap year before 2000 is a day outside the window; days that no year has, or not the written one, stay errors."""
    lines = ["1996-02-29,a,shell,,", "2/29/96,b,shell,,", "2/29/99,c,shell,,", "Feb 29,d,shell,,", "2000-02-30,e,shell,,"]
    s = sheet.parse_lines(spark.createDataFrame([("o", i, x) for i, x in enumerate(lines)], "origin string, pos long, line string"),
                          ["Event Date", "Act", "Place", "Doors", "Notes"])
    assert [(r.pos, r.reason) for r in sheet.bad_rows(s, P).orderBy("pos").collect()] == [(2, "bad date"), (3, "bad date"), (4, "bad date")]
    assert sheet.stage_sheet(s, P).count() == 0


def test_old_leap_days_as_the_reference_reads_them(column):
    """``replace(year=...)`` fails inside the loop over layouts, and the search then finds the day with its written year."""
    texts = ["Feb 29, 1996", "February 29, 1996", "  Feb  29, 1996 ", "Feb 29 1996", "Feb 28, 1996"]
    assert column(texts, lambda x: dates.parse_date_text(x, 2026)) == [D(1996, 2, 29)] * 4 + [D(2026, 2, 28)]


def test_references_cut_off_before_a_tag():
    """a name of HTML 4 ends at the tag after it, with its semicolon or without."""
    assert Page("<h3>Ly.&amp;&amp; and&amp</h3>").text == ["Ly.&& and&"]


def test_blocks_of_some_thousand_rows_are_scanned(spark, monkeypatch):
    """such a block went to the plan for crowded blocks, which took many rounds of joins for long texts."""
    words = [f"w{i * 7919 % 9973}" for i in range(9973)]
    long = [row(i, " ".join(words[(i * 31 + j * j * 7) % 9973] for j in range(60)) + f" n{i % 5000}", ["7 PM", None][i % 2]) for i in range(6000)]
    monkeypatch.setattr(crowded, "resolve", lambda recs: 1 / 0)
    got = survivors(spark, long)
    assert len(got) == len(set(got)) and 4000 < len(got) <= 6000


def test_scan_of_short_and_long_forms_in_one_block(spark):
    """maps become wide when a long form comes after short ones; copies and replaced representatives are looked up anew."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        text = " ".join(rnd.sample(vocab, rnd.choice([1, 2, 3, 60, 70]) if i > 50 else 2))
        if rows and rnd.random() < 0.5:
            text = rnd.choice(rows)["artist"]
        rows.append(row(i, text + rnd.choice(["", "", " x"]), rnd.choice([None, "7 PM"]), rnd.choice([None, "u"])))
    assert survivors(spark, rows) == scan(rows)


def test_survivors_of_crowded_blocks_are_joined_without_sending_the_rows(spark):
    """the rows of crowded blocks were broadcast through the driver wherever their files looked small."""
    rows = [row(i, f"act {i}") for i in range(60)]
    found = dedup.deduplicate(spark.createDataFrame(rows, schema.LISTING), max_rows=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and sorted(r.pos for r in found.select("pos").collect()) == scan(rows)


def test_tasks_of_heavy_tables_follow_the_rows(spark, monkeypatch):
    """a table went over as many tasks as there are cores, however many rows it had."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 100, raising=False)
    assert session.spread(spark.range(5_000).repartition(1)).rdd.getNumPartitions() == 50
    assert session.spread(spark.range(5_000).repartition(60)).rdd.getNumPartitions() == 60


def test_near_copies_come_from_trees_of_fingerprints(monkeypatch):
    """pairs of a shard are those a BK-tree search over SimHash fingerprints gives, checked by whole sets; without the search there are none."""
    rng = np.random.default_rng(8)
    rows, sets = [], []
    for shard in range(6):
        for n in range(30):
            base = rng.integers(0, 1 << 64, rng.integers(4, 90), np.uint64)
            more = rng.integers(0, 1 << 64, max(1, len(base) // rng.integers(4, 8)), np.uint64)
            for s in (base, np.concatenate([base, more]), np.concatenate([base[1:], more[:1]])):
                s = np.unique(s)
                rows.append((shard, len(rows), 3, near_text.fingerprint(s), s.tobytes()))
                sets.append(set(s.tolist()))
    up = list(range(len(rows)))
    for a, b in near_text.shard_links(rows):
        up = [up[b] if x == up[a] else x for x in up]
    group, pairs = linked(sets)
    assert len(pairs) > 200 and len(set(zip(up, group, strict=True))) == len(set(up)) == len(set(group))
    monkeypatch.setattr(near_text.Wide, "search", lambda *_: iter(()))
    assert list(near_text.shard_links(rows)) == []


@pytest.mark.parametrize("radius", [0, 3, 26, 64])
def test_wide_search_equals_every_pair(radius):
    """searches of a wide radius, over several trees, copies of a fingerprint and shards without a tree."""
    rng = np.random.default_rng(radius)
    fp = np.concatenate([rng.integers(0, 1 << 64, 150, np.uint64), rng.integers(0, 32, 50, np.uint64)])
    shard, ask = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    found = [p for q, node in near_text.Wide(shard, fp).search(ask, fp, radius) for p in zip(q.tolist(), node.tolist(), strict=True)]
    assert sorted(found) == [(a, b) for a in range(200) for b in range(200) if ask[a] == shard[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= radius]


@pytest.mark.parametrize("shared, one, other", [(4, 1, 0), (40, 5, 5), (120, 0, 30)])
def test_texts_of_the_least_likeness_lie_within_the_radius(shared, one, other):
    """what the search may miss, at a likeness of exactly four fifths."""
    rng, far = np.random.default_rng(9), []
    for _ in range(3000):
        s = rng.integers(0, 1 << 64, shared + one + other, np.uint64)
        a, b = near_text.fingerprint(s[: shared + one]), near_text.fingerprint(np.concatenate([s[:shared], s[shared + one :]]))
        far.append(((a ^ b) & ((1 << 64) - 1)).bit_count())
    assert max(far) <= near_text.RADIUS and np.mean(far) < 13


def test_texts_go_to_workers_in_batches_of_some_bytes(spark):
    """Memory of the pipeline: a setting of the session is kept, the default of 10,000 rows is not."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "9m")
        session.small_batches(spark)
        assert spark.conf.get(name) == "9m"
        spark.conf.unset(name)
        session.small_batches(spark)
        assert spark.conf.get(name) == "4m"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_pages_go_to_workers_in_small_batches(spark):
    """F8: an Arrow batch of 10,000 whole pages was held several times over by each core's worker."""
    x = spark.createDataFrame([("generic", "<div class='event-item'><h3>a</h3><time datetime='2026-02-17'>x</time></div>", "Growlers", "s", 1, "o", 0)],
                              "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    found = pages.stage_pages(x, P)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and [r.artist for r in found.collect()] == ["a"]


def test_page_state_works_each_value_out_once(spark):
    """a lambda repeats what it refers to; dates, names and an object's members were worked out anew for every use and every member."""
    html = spark.createDataFrame([("x",)], "html string")
    plan = html.select(pages.page_state_events(html["html"]).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert [plan.count(x) for x in ("parse_json", "to_date")] == [1, 2]  # to_date: of a stamp, of a plain day


def test_wide_objects_of_page_state(spark):
    """an object's members were extracted once for each of them."""
    n = 3000
    many = ",".join(f'"k{i}":{{"@type":"Event","name":"act {i}","startDate":"2026-02-{i % 28 + 1:02d}"}}' for i in range(n))
    html = f'<script id="__NEXT_DATA__">{{"a":{{{many}}}}}</script>'
    rows = spark.createDataFrame([(html,)], "html string").select(pages.page_state_events(F.col("html")).alias("e"))
    rows.count()
    began = time.time()
    got = rows.first().e
    assert [e.artist for e in got] == [f"act {i}" for i in range(n)]
    assert [e.date.day for e in got] == [i % 28 + 1 for i in range(n)]
    assert time.time() - began < 15


def test_page_state_values_of_wrong_types(spark):
    """what ends a page's events, and what is passed over, is as before."""
    def state(*items):
        return "".join(['<script id="__NEXT_DATA__">[', ",".join(items), "]</script>"])

    good = '{"@type":"Event","name":"a","startDate":"2026-02-16T20:00:00Z"}'
    cases = {
        '{"@type":"Event","name":5,"startDate":"2026-02-16"}': 1, '{"@type":"Event","name":"b","startDate":7}': 1,
        '{"@type":"Event","name":"b","startDate":"2026-02-16","location":{"name":1}}': 1, '{"@type":"Event","name":"b","startDate":"soon","location":{"name":1}}': 2,
        '{"@type":"Event","name":" ","startDate":7}': 2, '{"@type":"Other","name":5,"startDate":7}': 2, '{"@type":5,"name":5,"startDate":7}': 2, '{"@type":"Event","name":null,"startDate":"2026-02-16"}': 1}
    rows = spark.createDataFrame([(i, state(good, bad, good)) for i, bad in enumerate(cases)] + [(99, state(good)[:-11] + ",</script>"), (98, "<p>x</p>"), (97, None)], "i int, html string")
    got = {r.i: r.n for r in rows.select("i", F.size(pages.page_state_events(F.col("html"))).alias("n")).collect()}
    assert got == dict(enumerate(cases.values())) | {99: 0, 98: 0, 97: 0}


def test_cards_beside_links_with_a_day_are_not_read(spark):
    """cards of a saved city page count only where no link is an event; they were read, and thrown away, on every page."""
    def page(day):
        return (f'<a href="/e/1"><div><div></div><div><div><div>act</div><div>bar</div></div><div>{day}</div></div></div></a>'
                "<div class='event-card'><h3>card</h3><time>Feb 17</time></div>")

    days = ["Feb 28", "Feb 9 - 8:00 PM", "Feb 1 - late - night", "Feb 29", "Feb 31", "Sep 30", "Feb 7th", "Feb 007", "Feb 7 pm", "feb 7"]
    rows = spark.createDataFrame([("artifact", page(d), d) for d in days], "kind string, html string, day string")
    layout = F.lit(next(p["layout"] for p in map(lambda r: r.asDict(), pages.profile_dim(spark).collect()) if p["kind"] == "artifact"))
    read = {r.day: (len(r.x.links), len(r.x.cards)) for r in rows.select("day", pages.read_cards(layout, rows["html"], F.lit(True), F.lit(True)).alias("x")).collect()}
    sure = days[:3]
    assert {d: n[1] > 0 for d, n in read.items()} == {d: d not in sure for d in days}
    x = rows.select("*", F.lit(None).cast("string").alias("page_venue"), F.lit("A").alias("source_name"), F.lit(5).alias("source_rank"),
                    F.col("day").alias("origin"), F.lit(0).alias("endpoint_rank"))
    got = {r.day: [(e.artist, str(e.date)) for e in r.events] for r in pages.page_events(x, 2026).select("day", "events").collect()}
    card = [("card", "2026-02-17")]
    assert [got[d] for d in days[:6]] == [[("act", "2026-02-28")], [("act", "2026-02-09")], [("act", "2026-02-01")], card, card, [("act", "2026-09-30")]]
    assert all(got[d] for d in days[6:])


def test_forms_of_crowded_blocks_are_made_in_tasks_by_rows(spark, monkeypatch):
    """they were made in as many tasks as the input has splits, few for narrow rows however many there are."""
    monkeypatch.setattr(dedup, "SPREAD_ROWS", 50)
    seen, plain = [], crowded.resolve
    monkeypatch.setattr(crowded, "resolve", lambda recs: seen.append(recs.rdd.getNumPartitions()) or plain(recs))
    rows = [row(i, f"act {i % 40} of {i % 7}", ["7 PM", None][i % 2]) for i in range(600)]
    listing = spark.createDataFrame(rows, schema.LISTING).coalesce(1)
    got = sorted((r.artist, r.pos) for r in dedup.deduplicate(listing, max_rows=50).collect())
    assert seen == [12]
    assert got == sorted((r.artist, r.pos) for r in dedup.deduplicate(listing).collect())
    monkeypatch.setattr(dedup, "SPREAD_CHARS", 2)  # long rows stay in their splits
    assert sorted((r.artist, r.pos) for r in dedup.deduplicate(listing, max_rows=50).collect()) == got
    assert seen == [12, 1]


def test_spellings_of_a_crowded_venue(spark):
    """the match form of a venue is made once for each spelling; spellings of one block stay together, and a null venue is no crowded block."""
    venues = ["The Shell", "the  shell!", "SHELL", None, "Bar"]
    rows = [row(i, f"act {i % 9} of {i % 4}", ["7 PM", None][i % 2], venue=venues[i % 5 if i < 200 else i % 3]) for i in range(300)]
    listing = spark.createDataFrame([tuple(r[f.name] for f in schema.LISTING) for r in rows], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.LISTING))
    found = dedup.measure_spellings(listing)
    assert found.count() == 5 and "artist" not in found.columns
    got = sorted(r.pos for r in dedup.deduplicate(listing, max_rows=60).select("pos").collect())
    assert got == sorted(r.pos for r in dedup.deduplicate(listing).select("pos").collect())
