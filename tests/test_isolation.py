"""One bad page, record or selector disturbs nothing but itself."""

import time

import pytest

from marquee import config
from marquee.functions.tree import Page
from marquee.operators import quarantine
from marquee.plans import daily
from marquee.plans.queries import OWN_PROFILES, P
from marquee.session import cut
from marquee.sources import api, pages, profiles, sheet

GIG = '<div class="gig event-item"><h3 class="gig-name">{}</h3><a href="/g">x</a><time datetime="2026-02-16">x</time></div>'
PAGES = "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int"


def test_a_failing_page_fails_its_venue_alone(spark, tmp_path):
    """Eleven calendars: one not fetched, one with a state of its own, the others read."""
    keys = [v[0] for v in config.VENUES if v[3] and v[4] != "manual_only"]
    assert len(keys) == 11
    rows = [(k, f"{k}.html", GIG.format(f"Act at {k}"), "connection reset" if i == 4 else None) for i, k in enumerate(keys)]
    landed = spark.createDataFrame(rows, "venue_key string, origin string, html string, fetch_error string")
    run = daily.run_daily(spark, daily.Landing(venue_pages=landed), P, str(tmp_path / "out"))
    got = {r.source_name: r for r in run.audit.collect() if r.source_name.startswith("Venue: ")}
    assert len(got) == 11 and [r.error for r in got.values() if not r.success] == ["Request failed: connection reset"]
    generic = [v[1] for v in config.VENUES if v[3] and v[4] not in ("manual_only", *profiles.SITE_PROFILES)]
    assert all(got[f"Venue: {n}"].events_found == 1 for n in generic if got[f"Venue: {n}"].success)


def test_own_profile_and_unreadable_selector(spark):
    kinds = ["own_rows", "own_broken", "unheard_of", "generic", None, "own_rows"]
    rows = [(k, GIG.format(f"Act {i}") if i < 5 else None, "House", "S", i, str(i), 0) for i, k in enumerate(kinds)]
    events = cut(pages.page_events(spark.createDataFrame(rows, PAGES), 2026, spark.createDataFrame(profiles.profile_rows(OWN_PROFILES), profiles.SCHEMA)))
    assert {r.origin: r.error for r in events.collect()} == {
        "0": None, "1": "Parse error: ValueError: selector '>>'", "2": "Parse error: no profile unheard_of", "3": None, "4": "Parse error: no profile null", "5": None}
    assert sorted((r.artist, r.venue, r.url) for r in pages.stage_events(events, P).collect()) == [("Act 0", "House", "https://own.example/g"), ("Act 3", "House", None)]
    assert [(r.source_rank, r.n_pages, r.n_failed) for r in pages.page_errors(events).orderBy("source_rank").collect()] == [(0, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 1, 1), (5, 1, 0)]
    assert sorted((r.origin, r.reason) for r in pages.unread_pages(events).collect()) == [(x, quarantine.UNREAD) for x in "124"]


def test_bad_payloads(spark):
    good = '{"name":"A","dates":{"start":{"localDate":"2026-02-16"}}}'
    bodies = ["{cut", "", None, "[]", "{}", '{"_embedded":{"events":[]}}', '{"_embedded":{"events":[%s,{"name":" "},{"name":"B"},{"name":"C","dates":{"start":{"localDate":"x"}}}]}}' % good]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "origin string, body string")
    got = sorted((r.origin, r.pos if r.pos is not None else -1, r.reason) for r in api.bad_ticketing(df).collect())
    assert got == [("0", -1, "not JSON"), ("1", -1, "not JSON"), ("2", -1, "not JSON"), ("6", 1, "no name"), ("6", 2, "no date"), ("6", 3, "bad date")]
    kept = api.stage_ticketing(df).where("kept").count()
    assert kept == 1
    second = ['{"events":[{"name":{"text":"A"},"start":{"local":"2026-02-16T19:00:00"}},{"name":{"text":"B"},"start":{"local":"soon"}},{"start":{}}]}', "nope"]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(second)], "origin string, body string")
    assert sorted((r.origin, r.reason) for r in api.bad_second(df, 4).collect()) == [("0", "bad date"), ("0", "no name"), ("1", "not JSON")]


def test_bad_rows_and_scripts(spark):
    lines = ["2/16/2026,A,shell,9 PM,n", "2/16/2026,A", "2/16/2026,A,shell,9,n,more", ",A,shell,,", "x,A,shell,,", "2/16/2026,,shell,,"]
    s = sheet.parse_lines(spark.createDataFrame([("o", i, x) for i, x in enumerate(lines)], "origin string, pos long, line string"), ["Event Date", "Act", "Place", "Doors", "Notes"])
    bad = sheet.bad_rows(s, P)
    assert [(r.pos, r.reason) for r in bad.orderBy("pos").collect()] == [(1, "too few cells"), (2, "too many cells"), (3, "no date"), (4, "bad date"), (5, "no name")]
    assert sheet.stage_sheet(s, P).count() == 1
    ld = '<script type="application/ld+json">{}</script>'
    html = "".join(ld.format(x) for x in ("{bad", '{"@type":"Event","name":"A","startDate":"2026-02-16"}', '[{"@type":"Event","name":4}]', "[[]]")) + '<script id="__NEXT_DATA__">{</script>'
    df = spark.createDataFrame([("S", 3, "p", html), ("S", 3, "q", None), ("S", 3, "r", "")], "source_name string, source_rank int, origin string, html string")
    scripts = pages.bad_scripts(df)
    assert [(r.origin, r.pos, r.reason) for r in scripts.orderBy("pos").collect()] == [("p", 0, "not JSON"), ("p", 2, "value of a wrong type"), ("p", 3, "value of a wrong type"), ("p", 4, "not JSON")]
    both, seen = quarantine.counted(quarantine.union(spark, [bad, scripts]))
    assert both.count() == 9
    assert {k: v for k, v in seen.get.items() if v} == {"all": 9, "too few cells": 1, "too many cells": 1, "no date": 1, "bad date": 1, "no name": 1, "not JSON": 2, "value of a wrong type": 2}


def test_run_keeps_bad_records(spark, tmp_path):
    (tmp_path / "api").mkdir()
    (tmp_path / "api" / "a.json").write_text("{cut")
    (tmp_path / "s.csv").write_text("date,artist,venue,time,source_note\n2/16/2026,,x,,\n2/16/2026,B,x,,\n")
    landing = daily.Landing(ticketing=str(tmp_path / "api"), sheets=[(str(tmp_path / "s.csv"), config.SHEET_LOCAL)], second_api=str(tmp_path / "missing"))
    run = daily.run_daily(spark, landing, P)
    seen = daily.write(run, str(tmp_path / "out"))
    assert (seen["all"], seen["not JSON"], seen["no name"]) == (2, 1, 1)
    assert spark.read.parquet(str(tmp_path / "out" / "bad_records")).count() == 2


def test_written_order_and_texts_that_look_like_objects(spark):
    docs = ['{"z":1,"a":{"y":[true,null],"b":"{\\"q\\":1}"},"é":"x"}', "[1,[2],{}]", "no json", None, '"[1]"']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    nodes = df.select("i", pages.walk_json(df["d"]).alias("n")).selectExpr("i", "transform(n, x -> try_variant_get(x.v, '$', 'string')) as n").orderBy("i").collect()
    assert nodes[0].n[1:] == ["1", '{"b":"{\\"q\\":1}","y":[true,null]}', "[true,null]", "true", None, '{"q":1}', "x"]
    assert [len(r.n) for r in nodes] == [8, 5, 1, 1, 1]


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<div ="', "<![", "<![cdata[", "</", "<?", "&", '<a x=">" ', "<script", "<", "<a '", "--  ", "</script  ", '<div class="event-item">x', "<i a=b/>", "]  "])
def test_pages_take_time_in_proportion(piece):
    times = []
    for size in (125_000, 1_000_000):
        html = piece * (size // len(piece))
        t = time.perf_counter()
        Page(html)
        times.append(time.perf_counter() - t)
    assert times[1] < 2 or times[1] < 16 * times[0]


def test_cut_off_markup_keeps_what_came_before():
    for tail in ("<a href='x", "<!-- never", "<![cdata[ x", "</p", "<script>var x", "<"):
        p = Page("<div><p>one</p>two" + tail)
        assert p.name[:2] == ["div", "p"] and "".join(p.text).startswith("onetwo")
    assert Page("<p class='a>x</p><b>y").attrs == [{"class": "'a"}, {}]
