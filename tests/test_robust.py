"""Very long inputs, character references, and the page tree."""

import datetime
import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from marquee import config, schema
from marquee.config import RunParams
from marquee.functions import markup, text
from marquee.functions.tree import Page, Selector
from marquee.sources import pages, sheet

MB = 60_000
P = RunParams(datetime.date(2026, 2, 15))


@pytest.mark.parametrize("inner", ["<!--" + "x-" * (MB // 2) + "-->A", "<b " + "x" * MB + ">A</b>", " " * MB + "<i>A</i>" + " " * MB, "<i></i>" * (MB // 7) + "A", "A<!--" + "<p>" * (MB // 3) + "-->",
                                   "&" * MB + "A", "&#" * (MB // 2) + "A", "&a" * (MB // 2) + "A"], ids=lambda x: x[:6])
def test_long_markup(column, inner):
    assert column([inner], text.element_text)[0].endswith("A")


def test_long_scripts_and_attributes(column):
    script = '<script type="application/ld+json">[' + "1," * (MB // 2) + "1]</script>"
    assert len(column([script], lambda c: F.regexp_extract(c, markup.SCRIPT_JSONLD, 1))[0]) > MB // 2
    assert column(['<a x="' + "y" * MB + '" href="/z">'], lambda c: markup.attribute(c, "href")) == ["/z"]
    assert column([" " * MB + "a" + " " * MB], text.squeeze_ends) == ["a"] and column(["a" + " " * MB + "b"], text.squeeze) == ["a b"]


def test_long_cells(spark):
    cell = '"' + "x" * MB + '""' * 5000 + '"'
    lines = spark.createDataFrame([("o", 0, f"2026-02-16,{cell},Growlers"), ("o", 1, f"2026-02-16,Act,Growlers,{cell},,more")], "origin string, pos int, line string")
    got = sheet.stage_sheet(sheet.parse_lines(lines, ["date", "artist", "venue", "time", "source_note"]), P).collect()
    assert {r.pos for r in got} == {1} and all(r.venue == "Growlers" for r in got)


@pytest.mark.parametrize("page", ["<div class='event-card'>" * 800 + "<h3>A</h3><time datetime=2026-02-16>x</time>", "<p>" * (MB // 3), "<div class='event-card'>" + "<i></i>" * (MB // 7) + "<h3>A</h3><time datetime='2026-02-16'>x</time></div>", "<" * MB, "<!--" + "-" * MB])
def test_long_pages(spark, page):
    df = spark.createDataFrame([("generic", page, "V", "S", 1, "o", 0)], "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    assert {r.artist for r in pages.stage_pages(df, P).select("artist").distinct().collect()} <= {"A"}


@pytest.mark.parametrize("section", ["<![foo[x]]>", "<![ 5 >", "<![5", "<![", "<![foo", "<![foo[<b>]]>", "<![if x]>", "<![CDATA[x]]>"])
def test_marked_sections_lose_no_page(spark, section):
    card = "<div class='event-card'><h3>{}</h3><time datetime='2026-02-16'>x</time></div>"
    rows = [("generic", html, "V", "S", i, f"o{i}", 0) for i, html in enumerate([card.format("A") + section, card.format("B"), section + "\n>" + card.format("C")])]
    df = spark.createDataFrame(rows, "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    assert {"A", "B"} <= {r.artist for r in pages.stage_pages(df, P).collect()}


def test_no_declaration_raises():
    rng = random.Random(8)
    for _ in range(20000):
        Page("".join(rng.choice(["<!", "<![", "[", "]", "]]>", "]>", ">", "foo", "if", "cdata", " ", "5", "-", "--", "<", "</", "<p>", "doctype", "<?", "&", '"', "="]) for _ in range(rng.randint(1, 9))))


def test_references(column):
    assert column(["&#x10FFFF;&#0000039;&#X27;&ntilde;&uuml;&#38;lt;&amp;lt;&#60&nope;&#55296;&#x110000;&#0;&#150;&#99999999999;&;&"], text.decode_entities) == [
        "\U0010FFFF''ñü&lt;&lt;<&nope;���–�&;&"]
    given = "".join(f"[&{n};]" for n in sorted(html.entities.name2codepoint))
    assert column([given], text.decode_entities) == [html.unescape(given)]
    every = "".join(f"[&{n}]" for n in sorted(html.entities.html5) if n.endswith(";"))
    assert Page(f"<p>{every}</p>").text_of(0) == html.unescape(every)
    assert column([None, "", "plain"], text.decode_entities) == [None, "", "plain"]


TREE = """<div class="a b"><p>One<br>two <i>three</i></p><script>no</script><!-- no --><ul><li class=x>1<li class="x y">2</ul> tail</div><a href=/q data-k='V1'>l</a>"""


def test_tree():
    p = Page(TREE)
    assert p.name == ["div", "p", "br", "i", "script", "ul", "li", "li", "a"]
    assert [p.text_of(i) for i in (0, 1, 5, 6, 7)] == ["Onetwothree12tail", "Onetwothree", "12", "12", "2"]
    for written, want in [("li", [6, 7]), (".x.y", [7]), ("div li", [6, 7]), (".b .x .y", [7]), ("ul .x.y", [7]), ("p li", []), ("a[href]", [8]), ("[data-k='V1']", [8]), ("[data-k*='v' i]", [8]), ("[data-k*='v']", []),
                          ("[class*='a b']", [0]), ("i, a", [3, 8]), ("ul .a", []), ("br", [2])]:
        assert Selector(written).all(p) == want, written


def test_unbalanced_trees():
    rng = random.Random(1)
    for _ in range(300):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "x", "<br>", "</i>", "<i/>"]) for _ in range(30))
        p = Page(page)
        assert all(i < p.end[i] <= len(p.name) and (p.parent[i] < 0 or p.end[i] <= p.end[p.parent[i]]) for i in range(len(p.name)))
        assert "".join(p.text) == "x" * page.count("x")


NESTED = {
    "marketplace": '<div class="EventCard"><div class="EventCard__title"><h3>M1</h3></div><div class="EventCard__date"><time datetime="2026-02-16">Feb 16</time></div><a href="/e">l</a></div>',
    "city_page": '<div class="EventCard-a"><h3>M1</h3><div class="EventCard-b"><i class="date">Feb 16</i></div><a href="/e">l</a></div>',
    "newspaper": '<div class="event-x"><h3><a href="/e">M1</a></h3><div class="event-y"><i class="date">Feb 16</i></div></div>',
    "generic": '<div class="event-item-x"><h3><a href="http://e">M1</a></h3><div class="event-item-head"><time datetime="2026-02-16">x</time></div></div>',
    "minglewood": '<div class="seven columns"><div class="tw-name"><div>x</div>Act</div><div class=tw-date-time>Feb 16</div></div>',
    "hi_tone": "<div class=eventWrapper><div class=eventMonth>Feb 16</div><h2>M1</h2><a href=/event/1>l</a></div>",
    "artifact": '<div class="event-card"><div><div class="event-card"><h2>In</h2><time>Feb 17</time></div></div><h2>Out</h2></div>',
}


def test_nested_cards(spark):
    rows = [(k, h, "V", k, i, k, 0) for i, (k, h) in enumerate(NESTED.items())]
    df = spark.createDataFrame(rows, "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    got = {}
    for r in pages.stage_pages(df, P).orderBy("origin", "pos").collect():
        got.setdefault(r.origin, []).append((r.artist, r.date.day, r.url))
    assert got == {"marketplace": [("M1", 16, "https://dice.fm/e")], "city_page": [("M1", 16, "https://www.bandsintown.com/e")], "newspaper": [("M1", 16, "https://www.memphisflyer.com/e")],
                   "generic": [("M1", 16, None)], "minglewood": [("xAct", 16, None)], "hi_tone": [("M1", 16, "/event/1")],
                   "artifact": [("In", 17, None), ("In", 17, None)]}


def test_descendants_of_a_card(spark):
    page = ('<div class="event-item"><h3>A</h3><abbr>Mar 1</abbr><p class="tribe-event-schedule-details"><abbr>Feb 16</abbr></p></div>'
            '<div class="tribe-events-list-event"><h3>no list</h3><time datetime="2026-02-16"></time></div>')
    df = spark.createDataFrame([("generic", page, "V", "S", 1, "o", 0)], "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    assert [(r.artist, r.date.day) for r in pages.stage_pages(df, P).collect()] == [("A", 16)]


def test_dimensions(spark):
    assert schema.alias_dim(spark).count() == len(config.ALIASES) if hasattr(config, "ALIASES") else schema.alias_dim(spark).count() > 40
    assert schema.rules_dim(spark).count() > 80
    assert spark.range(1).select(text.megabytes(F.lit(3 * 1024 * 1024))).first()[0] == 3
