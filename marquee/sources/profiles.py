"""Page profiles: how listings are laid out on each kind of page.

A profile lists ordered card strategies and one selector per field, and is a row of the profile table. The entries here are the built-in rows; a site
of its own is a further row of a table with ``SCHEMA``, without any code, named in the venue dimension. The extraction plan does not change.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from marquee import config

FLAGS = """kind string, saved_city boolean, jsonld boolean, jsonld_graph boolean, jsonld_date_time boolean, page_state boolean,
 yield_mode boolean, date_attr string, blank_venue boolean, link_rule string, base_url string, fixed_venue boolean,
 source_text string, drop_outside boolean, apply_rules boolean"""


@dataclass(frozen=True)
class Profile:
    kind: str
    strategies: tuple[str, ...]
    title: str
    date: str
    title_else: str = ""
    times: tuple[str, ...] = ()
    venue: str = ""
    link: str = ""
    link_from: str = "card"  # card: first ``link`` in it; own: the card's address, else that; title: the title's, or with a prefix that inside it
    saved_city: bool = False
    jsonld: bool = False
    jsonld_graph: bool = False
    jsonld_date_time: bool = False
    page_state: bool = False
    yield_mode: bool = False
    date_attr: str = "ignore"
    blank_venue: bool = False
    link_rule: str = "raw"
    base_url: str = ""
    fixed_venue: bool = False
    source_text: str = ""
    drop_outside: bool = False
    apply_rules: bool = False


# fixed values: selectors, in order of preference
PROFILES = [
    Profile(
        "generic", jsonld=True, jsonld_graph=True, fixed_venue=True,
        strategies=(
            ".tribe-events-list .tribe-events-list-event", ".type-tribe_events", ".eventon_list_event a", ".eventlist-event", ".summary-item",
            ".event-item", ".event-listing", ".event-card", "[class*='event-item']", "[class*='eventItem']", "article[class*='event']", "table.events tr"),
        title="h1 a, h2 a, h3 a, h1, h2, h3, .tribe-events-list-event-title a, .eventlist-title a, .eventlist-title-link, .summary-title a",
        date="time[datetime], .tribe-event-schedule-details abbr, .eventlist-meta-date, .summary-metadata-item--date", date_attr="prefer",
        times=("time.event-time-localized-start", ".tribe-event-time", ".eventlist-meta-time"), link_from="title", link_rule="absolute"),
    Profile("hi_tone", (".eventWrapper",), title="h2, h3", date="[class*='eventMonth']", link="a[href*='/event/']", fixed_venue=True),
    Profile("minglewood", (".seven.columns",), title=".tw-name", date=".tw-date-time", link="a[href*='/event/']", fixed_venue=True),
    Profile("hernandos", (".event-info-block",), title=".title a, .title", date=".date", times=(".see-showtime",), link="a[href]", fixed_venue=True),
    Profile(
        "artifact", saved_city=True, jsonld=True, jsonld_date_time=True, yield_mode=True,
        strategies=(".event-item", ".event-card", ".event-listing", "[class*='event-item']", "[class*='eventItem']", "article[class*='event']",
                    ".tribe-events-list-event", ".eventlist-event"),
        title="h2, h3, h4, [class*='title']", date="time, [class*='date']", date_attr="prefer", venue="[class*='venue'], [class*='location']",
        blank_venue=True, source_text="artifact"),
    Profile(
        "marketplace", jsonld=True, jsonld_date_time=True, page_state=True, strategies=("[class*='event'], [class*='Event'], [data-testid*='event']",),
        title="h2, h3, h4, [class*='title'], [class*='name']", date="time, [class*='date'], [datetime]", date_attr="strict",
        venue="[class*='venue'], [class*='location']", link="a", link_rule="prefix", base_url=config.MARKETPLACE_BASE, source_text=config.MARKETPLACE, apply_rules=True),
    Profile(
        "city_page", strategies=("[data-testid='event-card']", ".event-card, .eventCard, [class*='EventCard']", "a[href*='/e/']"),
        title="[class*='artist'], [class*='Artist'], [data-testid='event-name'], h3, h4", date="[class*='date'], [class*='Date'], time",
        venue="[class*='venue'], [class*='Venue'], [class*='location']", link="a", link_from="own", link_rule="prefix", base_url=config.CITY_PAGE_BASE,
        source_text=config.CITY_PAGE, drop_outside=True, apply_rules=True),
    Profile(
        "newspaper",
        strategies=(".EventListing, .event-listing, [class*='event-item'], article.event", ".fdn-listing-item, .listing-item", "div[class*='event' i]"),
        title="h3 a, h2 a, .fdn-listing-title a, .event-title a, [class*='title'] a", title_else="h3, h2, .event-title",
        date=".EventDate, .event-date, [class*='date'], time", times=(".EventTime, .event-time, [class*='time']",),
        venue=".EventVenue, .event-venue, [class*='venue'], [class*='location']", link_from="title", link_rule="prefix", base_url=config.NEWSPAPER_BASE,
        source_text=config.NEWSPAPER, apply_rules=True),
]

PROFILE_FIELDS = [x.strip().split()[0] for x in FLAGS.split(",")][1:]
SITE_PROFILES = ["hi_tone", "minglewood", "hernandos"]
#: The profile table: flags, and ``layout``, a JSON object of strategies (an array) and selectors by the field names of ``Profile``.
SCHEMA = FLAGS + ", layout string"
LAYOUT = ("strategies", "title", "title_else", "date", "times", "venue", "link", "link_from", "link_rule", "yield_mode")


def profile_rows(profiles: list[Profile]) -> list[tuple]:
    """Rows of ``SCHEMA``."""
    return [(*(getattr(p, f) for f in ["kind", *PROFILE_FIELDS]), json.dumps({k: v for k, v in asdict(p).items() if k in LAYOUT})) for p in profiles]


def profile_dim(spark: SparkSession) -> DataFrame:
    """The built-in profiles as a table."""
    return spark.createDataFrame(profile_rows(PROFILES), SCHEMA)
