"""Sources read from files, a whole run with its documents read back, and the incremental job."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.operators import intake
from marquee.plans import daily
from marquee.schema import LISTING
from marquee.sources import api, artifacts, runlog, sheet
from marquee.streaming import landing as stream

P = RunParams(datetime.date(2026, 2, 15), 7, "2026-02-15 05:58:42")

CSV = '''date,artist,venue,time,source_note
2/15/2026,A,,,
2/16/2026,B,V
2/17/2026,C,V,9 PM,n,extra
2/18/2026,"D, ""x""",the shell,"7
8",
3/18/2026,Late,V,,
soon,E,V,,
'''

MHTML = b"""MIME-Version: 1.0
Content-Type: multipart/related; boundary="B"

--B
Content-Type: text/html; charset=utf-8
Content-Transfer-Encoding: quoted-printable

<a href=3D"https://b/e/1?q=3D1"><div><div></div><div><div><div>Caf=C3=A9</div><div>DKDC</div></div><div>Feb 16 - 6:00 PM</div></div></div></a>
--B--
"""


def ticketing_payload():
    def event(name, day, time=None, venue=None):
        start = {"localDate": day, "localTime": time}
        return {"name": name, "url": "http://t/1", "dates": {"start": {k: v for k, v in start.items() if v is not None}},
                "_embedded": {"venues": [{"name": venue}] if venue else []}}
    return {"_embedded": {"events": [
        event(" Lucero ", "2026-02-16", "19:30:00", "Minglewood Hall - Memphis"), event("Trivia Night", "2026-02-16"), event("", "2026-02-16"),
        event("No Day", None), event("Bad Day", "soon"), event("Plain", "2026-03-30", "late")]}}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    d = tmp_path_factory.mktemp("landing")
    (d / "api").mkdir()
    (d / "api" / "p.json").write_text(json.dumps(ticketing_payload(), indent=1))
    (d / "empty.json").write_text("{}")
    (d / "manual.csv").write_text(CSV)
    (d / "other.csv").write_text("Event Date,Act,Place\n2/16/2026,Z,bside\n2/16/2026,Y,bside,more\n")
    (d / "art").mkdir()
    (d / "art" / "a.mhtml").write_bytes(MHTML)
    (d / "art" / "b.HTML").write_text('<div class="event-card"><h2>Card</h2><time>Feb 17</time></div>')
    (d / "art" / "c.txt").write_text("no")
    (d / "art" / "d.html").write_text("")
    return d


def test_ticketing(spark, landed):
    rows = api.stage_ticketing(api.read_payloads(spark, str(landed / "api"))).orderBy("pos").collect()
    assert [(r.artist, r.venue, r.time, r.kept, r.filtered) for r in rows] == [
        ("Lucero", "Minglewood Hall", "7:30 PM", True, False), ("Trivia Night", "Unknown Venue", None, False, True), ("", "Unknown Venue", None, False, True),
        ("No Day", "Unknown Venue", None, False, True), ("Bad Day", "Unknown Venue", None, False, False), ("Plain", "Unknown Venue", None, True, False)]
    assert api.stage_ticketing(api.read_payloads(spark, str(landed / "empty.json"))).count() == 0


def test_sheet(spark, landed):
    s, errors = sheet.first_sheet(spark, [(str(landed / "missing.csv"), config.SHEET), (str(landed / "manual.csv"), config.SHEET_LOCAL)])
    assert s.source_name == config.SHEET_LOCAL and len(errors) == 1
    rows = sheet.stage_sheet(s, P).orderBy("pos").collect()
    assert [(r.artist, r.venue, r.time, r.source) for r in rows] == [
        ("A", "Venue TBA", None, "Manual (Google Sheet)"), ("C", "Overton Park Shell", "9 PM", "Manual (n)"),
        ('D, "x"', "Overton Park Shell", "7\n8", "Manual (Google Sheet)")]
    other = sheet.stage_sheet(sheet.read_sheet(spark, str(landed / "other.csv")), P).collect()
    assert [(r.artist, r.venue) for r in other] == [("Z", "B-Side Memphis")]  # too long, and not under first names


def test_artifacts(spark, landed):
    files = artifacts.list_artifacts(spark, str(landed / "art"))
    assert sorted(r.name for r in files.select("name").collect()) == ["a.mhtml", "b.HTML"]  # an empty file holds nothing
    pages = {r.origin.rsplit("/", 1)[1]: r.html for r in artifacts.artifact_pages(*(artifacts.list_artifacts(spark, str(landed / "art"), x) for x in (artifacts.PAGES, artifacts.ARCHIVES))).collect()}
    assert "Café" in pages["a.mhtml"] and "Card" in pages["b.HTML"]
    assert intake.retained(files, F.lit("2000-01-01").cast("timestamp")).count() == 2
    assert intake.retained(files, F.lit("2100-01-01").cast("timestamp")).count() == 0


def test_responses(spark):
    bodies = ['Sure: [{"artist":"A","venue":"","date":"Feb 16","time":"","source_note":"ig"},{"artist":"B","date":"Feb 16","time":null},'
              '{"artist":"C","date":"Mar 30"},5,{"artist":"","date":"Feb 16"}] ok', "no json", '{"artist":"A","date":"Feb 16"}', "[]"]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "origin string, body string")
    rows = artifacts.stage_responses(df, P).orderBy("origin", "pos").collect()
    assert [(r.artist, r.venue, r.source, r.kept, r.filtered) for r in rows] == [
        ("A", "Venue TBA", "Artifacts (ig)", True, False), ("C", "Venue TBA", config.ARTIFACTS, False, False)]


def document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_whole_run(spark, landed, tmp_path):
    venue_pages = spark.createDataFrame([
        ("minglewood-hall", "m.html", '<div class="seven columns"><div class="tw-name">Lucero with friends</div><p class="tw-date-time">Feb 16</p></div>'
                                      '<div class="seven columns"><div class="tw-name">Far</div><p class="tw-date-time">Mar 16</p></div>'),
        ("growlers", "g.html", "<p>nothing</p>")], "venue_key string, origin string, html string")
    newspaper = spark.createDataFrame([("n0", "<p></p>", 0)], "origin string, html string, endpoint_rank int")
    run = daily.run_daily(spark, daily.Landing(
        ticketing=str(landed / "api"), sheets=[(str(landed / "manual.csv"), config.SHEET_LOCAL)], artifacts=str(landed / "art"),
        venue_pages=venue_pages, failed_venues={"lafayettes": "404"}, newspaper=newspaper), P, str(tmp_path / "out"))
    audit = {r.source_name: r for r in run.audit.collect()}
    assert (audit["Ticketmaster"].events_found, audit["Ticketmaster"].events_after_filter, audit["Ticketmaster"].events_filtered) == (6, 2, 3)
    assert (audit["Manual (local CSV)"].events_found, audit["Artifacts (Vision-Extracted)"].events_found) == (3, 2)
    assert (audit["Venue: Minglewood Hall"].events_found, audit["Venue: Minglewood Hall"].events_filtered) == (2, 1)
    assert audit["Venue: Growlers"].error == config.MSG_EMPTY_VENUE and audit["Venue: Growlers"].success
    assert not audit["Venue: Lafayette's Music Room"].success and audit["Memphis Flyer"].error == config.MSG_NEWSPAPER_DOWN
    out = tmp_path / "out"
    log = document(out / "log")
    assert log["total_raw_events"] == sum(s["events_after_filter"] for s in log["sources"]) == 8
    assert log["total_deduped_events"] == len(log["events"]) == 7  # both Lucero listings are one act
    keys = [(e["date"], e["venue"].lower(), e["artist"].lower()) for e in log["events"]]
    assert keys == sorted(keys) and ["artist", "venue", "date", "time", "source"] == list(log["events"][0])
    assert [e["artist"] for e in document(out / "feed")["events"]] == [e["artist"] for e in log["events"]]
    page = "".join(p.read_text() for p in sorted((out / "page").glob("part-*")))
    assert page.count("<li>") == 7 and page.index("MONDAY, FEBRUARY 16") < page.index("TUESDAY, FEBRUARY 17")
    assert run.totals.first().summary == "7 events from 4 sources (2 had errors)"
    marks = ["<title>Listings — Next 8 Days</title>", "<h1>LISTINGS</h1>", "Updated February 14, 2026 at 11:58 PM CST", ">7 shows over the next 8 days<", "<main>",
             '<div class="day-section">', "</main>", ">7 events from 4 sources (2 had errors)<", "<tbody>", "</tbody>", "Last built February 14, 2026 at 11:58 PM CST", "</html>"]
    at = [page.index(m) for m in marks]
    assert at == sorted(at) and page.startswith("<!DOCTYPE html>") and page.endswith("</footer></body></html>\n")
    assert page.count('<tr class="src-') == len(audit) and page.count('<tr class="src-error">') == 2 and '<td class="src-count">—</td>' in page
    # the log read back as tables
    (out / "log.json").write_text(json.dumps(log))
    back = runlog.read_run_log(spark, str(out / "log.json"))
    assert runlog.log_events(back).count() == 7 and runlog.log_runs(back).first().total_raw_events == 8
    assert runlog.log_sources(back).count() == len(log["sources"])


def test_nothing_configured(spark):
    run = daily.run_daily(spark, daily.Landing(), P)
    rows = {r.source_name: (r.success, r.error) for r in run.audit.collect()}
    assert rows == {"Ticketmaster": (False, config.MSG_NO_TICKETING_KEY), config.SHEET: (True, config.MSG_NO_SHEET),
                    config.ARTIFACTS: (True, config.MSG_NO_ARTIFACT_DIR)}
    from marquee.plans import publish
    assert [r.line for r in publish.page_body(run.deduped).collect()] == [publish.EMPTY_PAGE]
    from marquee.operators import audit
    page = [r.line for r in publish.page(P, run.totals, audit.source_health(run.audit), run.deduped, "A & B", "<c>").collect()]
    assert page[1] == "<title>A &amp; B — Next 8 Days</title></head><body><header>" and page[4] == '<div class="summary">0 shows over the next 8 days</div></header><main>'
    assert page[5] == publish.EMPTY_PAGE and [x[:16] for x in page[9:12]] == ['<tr class="src-e', '<tr class="src-w', '<tr class="src-w'] and page[13].startswith("&lt;c&gt;<br>")


def test_incremental_equals_whole(spark, tmp_path):
    from marquee.operators import dedup
    days = [P.anchor_date + datetime.timedelta(days=i % 3) for i in range(30)]
    rows = [dict(artist=f"act {i % 5}", venue=["The Shell", "Shell", "Bar"][i % 3], date=str(days[i]), time="7 PM" if i % 7 == 0 else None, source="S",
                 url=None, source_name="s", source_rank=0, origin="f", pos=i) for i in range(30)]
    folder = tmp_path / "in"
    folder.mkdir()
    store = stream.Store(str(tmp_path / "store"), 4)
    for n, part in enumerate((rows[20:], rows[:10], rows[10:20])):  # late listings come first
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in part))
        stream.start(spark, str(folder), store, P).awaitTermination()
    got = sorted(r.pos for r in spark.read.parquet(store.published).select("pos").collect())
    whole = spark.createDataFrame([{**r, "date": datetime.date.fromisoformat(r["date"])} for r in rows], LISTING)
    assert got == sorted(r.pos for r in dedup.deduplicate(whole).select("pos").collect())
    again = spark.createDataFrame([{**r, "date": datetime.date.fromisoformat(r["date"])} for r in rows[20:]], LISTING)
    stream.apply_batch(again, 0, store, P)  # a repeated batch changes nothing
    assert got == sorted(r.pos for r in spark.read.parquet(store.published).select("pos").collect())


def test_rss_document(spark):
    import xml.etree.ElementTree as ET

    from marquee.plans import publish
    rows = [("B & C", "bar", datetime.date(2026, 2, 17), None, None, 0), ("A", "Shell", datetime.date(2026, 2, 16), "7 PM", "http://x?a=1&b=2", 0)]
    df = spark.createDataFrame(rows, "artist string, venue string, date date, time string, url string, slot long")
    doc = "".join(r.line for r in publish.rss_feed(df, "Shows <now>", "http://s").collect())
    channel = ET.fromstring(doc.split("?>", 1)[1]).find("channel")
    assert channel.find("title").text == "Shows <now>"
    assert [i.find("title").text for i in channel.findall("item")] == ["A — Shell (7 PM)", "B & C — bar"]
    assert [getattr(i.find("link"), "text", None) for i in channel.findall("item")] == ["http://x?a=1&b=2", None]


def test_bad_inputs_end_one_source_only(spark, landed, tmp_path):
    art = tmp_path / "art"
    art.mkdir()
    (art / "latin.html").write_bytes('<div class="event-card"><h2>Caf\xe9</h2><time>Feb 17</time></div>'.encode("latin-1"))
    (art / "broken.mhtml").write_bytes(b"Content-Type: multipart/related; boundary=x\n\n--x\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n%%%")
    (art / "big.png").write_bytes(b"x" * 1000)
    bad = spark.createDataFrame([("n0", "<p></p>", 0)], "origin string, html string, endpoint_rank int").withColumn("html", F.raise_error(F.lit("torn page")).cast("string"))
    run = daily.run_daily(spark, daily.Landing(ticketing=str(landed / "api"), sheets=[(str(landed / "manual.csv"), config.SHEET_LOCAL)], artifacts=str(art), marketplace=bad), P, str(tmp_path / "out"))
    audit = {r.source_name: r for r in run.audit.collect()}
    assert not audit["DICE"].success and "torn page" in audit["DICE"].error
    assert audit["Ticketmaster"].success and audit["Artifacts (Vision-Extracted)"].events_found == 1
    assert "Caf\ufffd" in {r.artist for r in run.staged.collect()}
    out = tmp_path / "out"
    assert spark.read.parquet(str(out / "failures")).count() == sum(not r.success for r in audit.values())
    assert spark.read.parquet(str(out / "health")).count() == len(audit) and spark.read.parquet(str(out / "totals")).count() == 1
    assert "slot" not in spark.read.parquet(str(out / "listing")).columns
    assert "".join(p.read_text() for p in sorted((out / "rss").glob("part-*"))).rstrip().endswith("</rss>")


def test_sheets_of_a_folder_keep_their_own_headers(spark, tmp_path):
    d = tmp_path / "sheets"
    d.mkdir()
    (d / "one.csv").write_text("date,artist,venue\n2026-02-16,A,Growlers\n")
    (d / "two.csv").write_text("venue,date,artist\nGrowlers,2026-02-17,B\nGrowlers,2026-02-18,C\n")
    (d / "three.csv").write_text("date,artist,venue\n2026-02-19,D,Growlers\n")
    rows = sheet.stage_sheet(sheet.read_sheet(spark, str(d)), P).collect()
    assert sorted((r.artist, r.venue, r.date.day) for r in rows) == [("A", "Growlers", 16), ("B", "Growlers", 17), ("C", "Growlers", 18), ("D", "Growlers", 19)]
