"""Texts of listing cards and of the links of saved city pages: the one step of page extraction that needs the page's tree.

Nested elements have no form as JVM expressions over text, so they are read in a Python function of one page.
It returns texts only; dates, venues and rules stay with Spark. A page that lacks the words of all of its profile's selectors is not parsed.
What goes wrong with one page is that page's ``error``, beside the cards of all others.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import config
from marquee.functions.tree import Page, Selector

CARD = "struct<rank:int,title:string,stamp:string,date:string,time:string,venue:string,link:string>"
LINK = "struct<artist:string,venue:string,day:string,url:string>"
_MONTH_DAY = re.compile(r"(?:" + "|".join(m[:3] for m in config.MONTHS) + r")\s+\d")

# a month and a day that every year has, and what may follow: the day of such a link is read for certain
_SURE_DAY = re.compile(r"(?:" + "|".join(x for m in config.MONTHS for x in dict.fromkeys((m, m[:3]))) + r") (?:1[0-9]|2[0-8]|[1-9])(?: - .*)?", re.S)


class Reader:
    """The selectors of one profile, given as a row of the profile table's ``layout``."""

    def __init__(self, layout: str):
        p = json.loads(layout)
        self.strategies = [Selector(s) for s in p["strategies"]]
        self.stems = {t for s in self.strategies for t in s.stems()}
        self.title, self.title_else, self.date, self.venue, self.link = (Selector(p.get(f) or "") for f in ("title", "title_else", "date", "venue", "link"))
        self.times = [Selector(s) for s in p.get("times") or ()]
        self.every, self.link_from, self.link_rule = bool(p.get("yield_mode")), p.get("link_from"), p.get("link_rule")

    def may_hold_cards(self, html: str) -> bool:
        low = html.lower()
        return any(s in low for s in self.stems)

    def cards(self, page: Page) -> Iterator[tuple]:
        """Cards of the first strategy that finds any, or of all of them, as ``CARD``; a card inside a card is one of its own."""
        fields = {name: getattr(self, name).all(page) for name in ("title", "title_else", "date", "venue", "link")}
        fields["anchors"] = page.named("a")
        times = [t.all(page) for t in self.times]
        for rank, strategy in enumerate(self.strategies):
            found = strategy.all(page)
            yield from (self.read(page, i, rank, fields, times) for i in found)
            if found and not self.every:
                return

    def read(self, page: Page, card: int, rank: int, fields: dict[str, list[int]], times: list[list[int]]) -> tuple:
        at = {name: page.first_of(found, card) for name, found in fields.items() if name != "anchors"}
        anchors = fields["anchors"]
        title = at["title_else"] if at["title"] is None else at["title"]
        time = next((t for found in times if (t := page.first_of(found, card)) is not None), None)

        def text(i: int | None) -> str | None:
            return None if i is None else page.text_of(i)

        stamp = None if at["date"] is None else page.attrs[at["date"]].get("datetime")
        return rank, text(title), stamp, text(at["date"]), text(time), text(at["venue"]), self.address(page, card, title, at["link"], anchors) or None

    def address(self, page: Page, card: int, title: int | None, link: int | None, anchors: list[int]) -> str | None:
        if self.link_from == "title":
            if title is None or page.name[title] == "a":
                return None if title is None else page.attrs[title].get("href")
            inner = page.first_of(anchors, title) if self.link_rule == "prefix" else None
            return None if inner is None else page.attrs[inner].get("href")
        own = page.attrs[card].get("href") if self.link_from == "own" else None
        return own or (None if link is None else page.attrs[link].get("href"))


def may_hold_links(html: str) -> bool:
    return "/e/" in html or "&#" in html or "&sol;" in html  # or its signs written as references


def city_links(page: Page) -> Iterator[tuple]:
    """Links to /e/ of a saved city page as ``LINK``, those with an artist and a day.

    A link's first own block holds its parts; the first of them with more than five signs is its information. The blocks in there are act and place
    (nested, or the act alone) and, in any of them, a day. Without such a part the link's texts, also split at bars, are act, place and day.
    """
    inside: dict[int, list[int]] = defaultdict(list)
    for i in page.named("div"):
        inside[page.parent[i]].append(i)
    for link in page.named("a"):
        url = page.attrs[link].get("href") or ""
        if "/e/" not in url or not inside[link]:
            continue
        info = next((i for i in inside[inside[link][0]] if len(page.text_of(i)) > 5), None)
        if info is None:
            pieces = [x for t in page.text[slice(*page.texts[link])] for y in t.split("|") if (x := y.strip())]
            if len(pieces) < 3:
                continue
            artist, venue, day = pieces[:3]
        else:
            blocks = [t for i in inside[info] if (t := page.text_of(i))]
            if len(blocks) < 2:
                continue
            first = inside[info][0]
            named = inside[first] or [first]
            artist, venue = page.text_of(named[0]), page.text_of(named[1]) if len(named) > 1 else ""
            day = next((t for t in blocks if _MONTH_DAY.search(t)), "")
        if artist and day:
            yield artist, venue, day, url


def read_cards(layout: Column, html: Column, city: Column, card: Column) -> Column:
    """struct<links array of ``LINK``, cards array of ``CARD``, error>: links where ``city`` holds, cards where ``card`` holds and no link is
    certain to be an event (links come before cards); the page is read once for both. A null page has none, and what comes before an error is not kept either."""
    readers: dict[str, Reader] = {}
    names = ("rank", "title", "stamp", "date", "time", "venue", "link")
    parts = ("artist", "venue", "day", "url")

    # rows go to the worker 100 at a time: an Arrow batch of 10,000 whole pages is held several times over
    @F.udf(f"struct<links:array<{LINK}>,cards:array<{CARD}>,error:string>", useArrow=False)
    def cards(layout, html, city, card):  # noqa: ANN001, ANN202
        if html is None or layout is None:
            return [], [], None
        try:
            if layout not in readers:
                readers[layout] = Reader(layout)
            reader = readers[layout]
            city, card = city and may_hold_links(html), card and reader.may_hold_cards(html)
            if not city and not card:
                return [], [], None
            page = Page(html)
            links = [dict(zip(parts, x, strict=True)) for x in city_links(page)] if city else []
            card = card and not any(_SURE_DAY.fullmatch(x["day"]) for x in links)
            return links, [dict(zip(names, c, strict=True)) for c in reader.cards(page)] if card else [], None
        except Exception as e:  # of this page alone: it is reported, the others go on
            return [], [], f"{type(e).__name__}: {e}"

    return cards(layout, html, F.coalesce(city, F.lit(False)), F.coalesce(card, F.lit(False)))
