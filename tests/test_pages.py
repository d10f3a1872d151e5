"""Page profiles on literal pages; all pages go through one plan."""

import datetime

import pytest

from marquee.config import RunParams
from marquee.functions.tree import Page
from marquee.operators import fallback
from marquee.sources import pages
from marquee.sources.cards import city_links, may_hold_links

P = RunParams(datetime.date(2026, 2, 15))
D = datetime.date
PAGES = {
    "generic/graph": """<script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":" Lucero ","startDate":"2026-02-16T19:30:00-06:00",
      "location":{"name":"The Hi-Tone!"},"url":"/x"},{"@type":"Event","name":"Day","startDate":"2026-02-17","location":"x"}]}</script>
      <script type="application/ld+json">[{"@type":"Event","name":"A","startDate":"2026-02-18"},{"@type":"Event","name":5},{"@type":"Event","name":"B","startDate":"2026-02-18"}]</script>
      <script type="application/ld+json">{"@type":["Event"],"name":"C","startDate":"2026-02-18"}</script>""",
    "generic/cards": """<body class="events"><div class="event-item"><h3><a href="http://x/1">Big &amp; Al</a></h3><time datetime="2026-02-19T20:00:00Z">x</time>
      <span class="tribe-event-time"> 8 PM </span></div><div class="event-item"><div class="summary-title"><a href="https://q.com/e?a=1&amp;b=2">Zed</a></div>
      <div>z</div><time datetime="bad">Feb 20</time></div><footer><h2>nope</h2></footer>""",
    "generic/blocked": '<div class="event-item"><p>no title</p></div><div class="event-card"><h2>Good</h2><time datetime="2026-02-19">x</time></div>',
    "generic/table": '<table class="big events"><tr><td><h3>Row</h3><time datetime="2026-02-28">x</time></td></tr></table>',
    "hi_tone/1": '<div class="x eventWrapper"><div class="eventMonth y">Sun, Feb 15</div><h2>Tropi<b>delic</b></h2><a href="/event/t/">t</a></div>',
    "minglewood/1": '<div class="columns seven"><div class="tw-name"><a href="https://m/event/1">Paul Thorn</a></div><i class="tw-date-time">Friday, February 20th, 2026</i></div>',
    "hernandos/1": '<div class="event-info-block"><p class="title"><a href="/d">Dale</a></p><p class="date">Feb 21</p><p class="see-showtime">Show: 10:00 AM</p></div>',
    "artifact/city": """<a href="https://b/e/12?x=1"><div><div><img></div><div><div><div>Art One</div><div>Growlers</div></div><div>Feb 16 - 6:00 PM</div></div></div></a>
      <a href="/e/13"><div><span>A2</span><span>Shell</span><span>Feb 17</span></div></a><a href="/e/14"><div><div></div><div><div><div>Solo</div></div><div>Feb 18</div></div></div></a>""",
    "artifact/yield.html": '<div class="event-card"><p>no</p></div><div class="event-listing"><h4>Got</h4><i class="event-date">2/19</i><p class="venue"></p></div>',
    "artifact/ld.html": '<script type="application/ld+json">{"@type":"Event","name":"J","startDate":"2026-02-17","location":{"name":""}}</script>',
    "marketplace/state": """<script id="__NEXT_DATA__" type="application/json">{"p":{"x":[{"name":"N1","startDate":"2026-02-16T20:00:00","@type":"MusicEvent"},
      {"name":"N2","date":"z","@type":"Event"}],"a":{"name":"N0","startDate":"2026-02-16","@type":"Event","location":{"name":"GPAC"}}}}</script>""",
    "marketplace/cards": """<div class="EventCard"><a href="/event/1"><h3>M1</h3><time datetime="2026-02-16">x</time></a></div>
      <div class="EventCard"><h3>M2</h3><time datetime="junk">Feb 16</time></div>""",
    "city_page/1": '<div data-testid="event-card"><h3>C1</h3><i class="eventDate">Feb 16</i><a href="/e/9">x</a></div><div data-testid="event-card"><h3>C2</h3><i class="eventDate">Mar 16</i></div>',
    "newspaper/1": """<article class="event"><h3><a href="/n/1">Jazz Night</a></h3><i class="EventDate">Feb 16</i><i class="EventTime">7 p.m.</i></article>
      <article class="event"><h3>Trivia <b>Bingo</b></h3><i class="EventDate">Feb 16</i></article>""",
    "newspaper/2": '<article class="event"><h3>Late Page</h3><i class="EventDate">Feb 16</i></article>',
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k.split("/")[0], h, "My Venue", f"Venue: {k}", i, k, int(k == "newspaper/2")) for i, (k, h) in enumerate(PAGES.items())]
    df = spark.createDataFrame(rows, "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    out = {k: [] for k in PAGES}
    for r in pages.stage_pages(df, P).orderBy("origin", "pos").collect():
        out[r.origin].append(r)
    return out


def brief(rows):
    return [(r.artist, r.venue, r.date.day, r.time, r.url) for r in rows]


def test_structured_data(found):
    assert brief(found["generic/graph"]) == [("Lucero", "Hi Tone", 16, "7:30 PM", "/x"), ("Day", "My Venue", 17, None, None), ("A", "My Venue", 18, None, None)]
    assert brief(found["artifact/ld.html"]) == [("J", "Venue TBA", 17, "12 AM", None)]
    assert found["artifact/ld.html"][0].source == "Artifacts (ld.html)"


def test_generic_cards(found):
    assert brief(found["generic/cards"]) == [("Big & Al", "My Venue", 19, "8 PM", None), ("Zed", "My Venue", 20, None, "https://q.com/e?a=1&b=2")]
    assert found["generic/blocked"] == []  # the first selector with any card wins, even if the card is unusable
    assert [(r.artist, r.kept, r.filtered) for r in found["generic/table"]] == [("Row", False, True)]


def test_site_profiles(found):
    assert brief(found["hi_tone/1"]) == [("Tropidelic", "My Venue", 15, None, "/event/t/")]
    assert brief(found["minglewood/1"]) == [("Paul Thorn", "My Venue", 20, None, "https://m/event/1")]
    assert brief(found["hernandos/1"]) == [("Dale", "My Venue", 21, "Show: 10:00 AM", "/d")]


def test_saved_pages(found):
    assert brief(found["artifact/city"]) == [("Art One", "Growlers", 16, "6:00 PM", "https://b/e/12"), ("A2", "Overton Park Shell", 17, None, "/e/13"),
                                             ("Solo", "Venue TBA", 18, None, "/e/14")]
    # the first selector that yields an event wins here; an empty venue element takes the first alias
    assert brief(found["artifact/yield.html"]) == [("Got", "Hi Tone", 19, None, None)]


def test_marketplace(found):
    # members as written: "x" stands before "a"
    assert brief(found["marketplace/state"]) == [("N1", "Venue TBA", 16, "8 PM", None), ("N0", "Germantown Performing Arts Center", 16, "12 AM", None)]
    assert brief(found["marketplace/cards"]) == [("M1", "Venue TBA", 16, None, "https://dice.fm/event/1")]


def test_city_page_counts_only_the_window(found):
    assert [(r.artist, r.found, r.kept, r.filtered) for r in found["city_page/1"]] == [("C1", True, True, False), ("C2", False, False, False)]


def test_newspaper(found):
    assert brief(found["newspaper/1"]) == [("Jazz Night", "Venue TBA", 16, "7 p.m.", "https://www.memphisflyer.com/n/1"), ("TriviaBingo", "Venue TBA", 16, None, None)]
    assert [r.kept for r in found["newspaper/1"]] == [True, False]


def test_first_yielding_endpoint(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 2, True)], "s int, rank int, ok boolean")
    got = fallback.first_yielding(rows, ["s"], "rank", rows["ok"]).select("s", "rank").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2)]


def test_links_of_saved_city_pages_by_the_tree():
    def links(html):
        return list(city_links(Page(html)))

    act = "<div><div>A<b>ct</b></div><div>Bar</div></div>"
    whole = f"<a href='/e/1'><div><p>x</p><div></div><div>{act}<div>Feb 16 - 8 PM</div></div></div></a>"
    assert links(whole) == [("Act", "Bar", "Feb 16 - 8 PM", "/e/1")]
    assert links(whole.replace("</div></div></div></a>", "")) == [("Act", "Bar", "Feb 16 - 8 PM", "/e/1")]  # left open
    assert links(whole.replace("/e/1", "&#x2F;e/1")) == [("Act", "Bar", "Feb 16 - 8 PM", "/e/1")]
    assert links(whole.replace("/e/", "/event/")) == links(whole.replace("Feb 16", "Feb")) == links(whole.replace("<div><p>x", "<p><div><p>x")) == []
    assert links("<a href='/e/1'><div><div>A</div></div>b | c|d</a>") == [("A", "b", "c", "/e/1")]
    assert links("<a href='/e/1'><div>a|b</div></a>") == [] == links("<a href='/e/1'>a|b|Feb 16</a>")
    assert links("<a href='/e/1'><div><div><div>Only act</div><div>Feb 16</div></div></div></a>") == [("Only act", "", "Feb 16", "/e/1")]
    assert links("<a href='/e/1'><div><div><div></div><div>Mar 1 act</div><div>Feb 16</div></div></div></a>") == []  # the first block has no text
    assert may_hold_links("<a href='&#47;e/'>") and may_hold_links("/e/") and not may_hold_links("<a href='/f/'>&amp;")
