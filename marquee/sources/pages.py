"""Listings out of web pages: structured data, embedded page state and card layouts, one plan for all kinds.

Every page is worked on inside its own row (arrays and higher-order functions; cards by one Arrow-batched function), so choosing the first
strategy that yields needs no shuffle; the plan is a scan, a broadcast of the profile dimension, and an explode.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.functions import dates, markup, text
from marquee.operators import quarantine
from marquee.operators.rules import in_window, is_music
from marquee.operators.venues import canonical_venue, venue_or_tba
from marquee.sources.cards import read_cards
from marquee.sources.profiles import PROFILE_FIELDS, profile_dim

EVENT = "struct<artist:string,venue:string,date:date,time:string,url:string>"
EVENT_TYPES = ["Event", "MusicEvent"]
EMPTY = f"array<{EVENT}>"
NODES = "array<struct<path:string,v:variant,raw:string>>"


def _event(artist: Column, venue: Column, day: Column, time: Column, url: Column) -> Column:
    return F.struct(artist.alias("artist"), venue.alias("venue"), day.alias("date"), time.alias("time"), url.alias("url")).cast(EVENT)


def _no_events() -> Column:
    return F.array().cast(EMPTY)


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _elements(v: Column) -> Column:
    """An array's elements; any other value as its own single element; unparsable text gives none."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(many, F.array(v)))


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def structured_event(item: Column, default_venue: Column | None, date_time: Column) -> Column:
    """One structured-data object as struct(event, stop): ``event`` is null when it is not a usable listing,
    ``stop`` says that a value of the wrong type ends the whole block.

    With a ``default_venue`` an object location's name overrides it; without, a missing name is the placeholder.
    ``date_time``: whether a bare date gets a time (midnight). Where it does not, only ``yyyy-m-d`` or a stamp
    with ``T`` is a date.
    """
    found = F.struct(_field(item, "$.name").alias("name"), _field(item, "$.startDate").alias("start"), _field(item, "$.location.name").alias("place"))
    typed = F.coalesce(F.try_variant_get(item, "$[\"@type\"]", "string").isin(EVENT_TYPES)
                       & _is_text(_field(item, "$[\"@type\"]")), F.lit(False))

    # each made once, and only for what is typed: in a lambda every reference is worked out anew
    def values(f: Column) -> Column:
        start_text = F.replace(F.try_variant_get(f["start"], "$", "string"), F.lit("Z"), F.lit("+00:00"))

        def dated(t: Column) -> Column:
            stamped = date_time | F.contains(t, F.lit("T"))
            return F.struct(F.when(stamped, dates.iso_date(t)).otherwise(dates.strict_day(t)).alias("day"), F.when(stamped, dates.iso_clock(t)).alias("time"))

        return F.struct(
            text.squeeze_ends(F.try_variant_get(f["name"], "$", "string")).alias("name"), F.try_variant_get(f["place"], "$", "string").alias("place"), text.let(start_text, dated).alias("at"),
            f["name"].isNotNull().alias("has_name"), _is_text(f["name"]).alias("is_name"), f["start"].isNotNull().alias("has_start"), _is_text(f["start"]).alias("is_start"),
            f["place"].isNotNull().alias("has_place"), _is_text(f["place"]).alias("is_place"))

    def judged(v: Column) -> Column:
        day = v["at"]["day"]
        placed = v["is_place"] & (v["place"] != "")
        venue = F.when(placed, canonical_venue(v["place"]))
        if default_venue is not None:
            venue = venue.when(default_venue.isNotNull(), default_venue)
        named = v["is_name"] & (v["name"] != "")
        ok = named & v["is_start"] & day.isNotNull()
        bad = (v["has_name"] & ~v["is_name"]) | (named & v["has_start"] & ~v["is_start"]) | (v["has_place"] & ~v["is_place"] & day.isNotNull())
        url = F.try_variant_get(item, "$.url", "string")
        return F.struct(F.when(ok & ~bad, _event(v["name"], venue.otherwise(F.lit(config.VENUE_TBA)), day, v["at"]["time"], url)).alias("event"), bad.alias("stop"))

    nothing = F.struct(F.lit(None).cast(EVENT).alias("event"), F.lit(False).alias("stop"))
    return F.when(typed, text.let(text.let(found, values), judged)).otherwise(nothing)


def _usable(results: Column) -> Column:
    """Events before the first stop."""
    def before(rs: Column) -> Column:
        at = F.array_position(F.transform(rs, lambda r: r["stop"]), True)
        return F.when(at > 0, F.slice(rs, F.lit(1), at.cast("int") - 1)).otherwise(rs)

    # the results are made once, not for the stop and for the events
    return F.transform(F.filter(text.let(results, before), lambda r: r["event"].isNotNull()), lambda r: r["event"])


def jsonld_events(html: Column, default_venue: Column | None, graph: Column, date_time: Column) -> Column:
    """Events of all structured-data blocks of a page, in page order. ``graph``: also look one level into @graph."""
    def block(script: Column) -> Column:
        items = _elements(F.try_parse_json(script))

        def widen(item: Column) -> Column:
            inner = F.try_variant_get(item, "$[\"@graph\"]", "array<variant>")
            return F.when(graph & inner.isNotNull(), inner).otherwise(F.array(item))

        flat = F.flatten(F.transform(items, widen))
        # anything but an object ends the block
        return _usable(F.transform(flat, lambda i: F.when(_is_object(i), structured_event(i, default_venue, date_time))
                                   .otherwise(F.struct(F.lit(None).cast(EVENT).alias("event"), F.lit(True).alias("stop")))))

    scripts = F.regexp_extract_all(html, F.lit(markup.SCRIPT_JSONLD), F.lit(1))
    return F.when(F.contains(html, F.lit("ld+json")), F.flatten(F.transform(scripts, block))).otherwise(_no_events())


def walk_json(source: Column, depth: int = 10) -> Column:
    """All values of a JSON text down to ``depth``, depth first and members as written, as array<struct<path, v, raw>>.

    The levels are unrolled by one fold inside the row. A parsed object has lost the order of its members; so each node also keeps its text, whose
    members a map reads in order. Text that is no JSON gives one null node.
    """
    def children(node: Column) -> Column:
        def place(i: Column) -> Column:
            return F.concat(node["path"], F.lpad(i.cast("string"), 8, "0"), F.lit(".")).alias("path")

        def named(members: Column) -> Column:
            return F.transform(F.map_entries(F.from_json(node["raw"], "map<string,string>")), lambda m, i: F.struct(
                place(i), F.element_at(members, m["key"]).alias("v"), m["value"].alias("raw")))

        def listed(many: Column) -> Column:
            return text.let(F.from_json(node["raw"], "array<string>"), lambda raws: F.transform(many, lambda k, i: F.struct(
                place(i), k.alias("v"), F.get(raws, i).alias("raw"))))

        # extracted once for all members of a node
        none = F.array().cast(NODES)
        return text.let(F.try_variant_get(node["v"], "$", "array<variant>"), lambda many: F.when(many.isNotNull(), listed(many)).otherwise(
            text.let(F.try_variant_get(node["v"], "$", "map<string,variant>"), lambda members: F.when(members.isNotNull(), named(members)).otherwise(none))))

    start = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(source).alias("v"), source.alias("raw"))).cast(NODES)

    def down(a: Column, _: Column) -> Column:
        return text.let(F.flatten(F.transform(a["edge"], children)).cast(NODES), lambda nxt: F.struct(F.concat(a["seen"], nxt).alias("seen"), nxt.alias("edge")))

    def in_order(seen: Column) -> Column:
        keys = F.array_sort(F.transform(seen, lambda n, i: F.struct(n["path"].alias("path"), i.alias("i"))))
        return F.transform(keys, lambda k: F.get(seen, k["i"]))

    def levels(first: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(first.alias("seen"), first.alias("edge")), down)["seen"]

    return text.let(text.let(start, levels), in_order)


def page_state_events(html: Column) -> Column:
    """Events anywhere in a page's embedded state: objects with a name and a date that are also typed events."""
    def is_candidate(node: Column) -> Column:
        v = node["v"]
        return _field(v, "$.name").isNotNull() & (_field(v, "$.startDate").isNotNull() | _field(v, "$.date").isNotNull())

    def found(state: Column) -> Column:
        return text.let(walk_json(state), lambda seen: F.when(F.get(seen, F.lit(0))["v"].isNotNull(), _usable(F.transform(F.filter(seen, is_candidate), lambda n: structured_event(n["v"], None, F.lit(True))))))

    return F.when(F.contains(html, F.lit("__NEXT_DATA__")), F.coalesce(text.let(F.regexp_extract(html, markup.SCRIPT_STATE, 1), found), _no_events())).otherwise(_no_events())


def saved_city_events(links: Column, year: int) -> Column:
    """Events of a saved city page's links (``LINK``); those whose day cannot be read are left out."""
    def one(link: Column) -> Column:
        day_text, time_text = dates.split_day_and_time(link["day"])
        url = text.blank_to_null(text.strip_query(link["url"]))
        return _event(link["artist"], venue_or_tba(link["venue"]), dates.parse_date_text(day_text, year), time_text, url)

    return F.filter(F.transform(links, one), lambda e: e["date"].isNotNull())


def card_events(read: Column, p: dict[str, Column], fixed_venue: Column, year: int) -> Column:
    """Events of a page's cards (``CARD``) under the first strategy that yields a card, or an event where the profile says so."""
    def build(c: Column) -> Column:
        stamp = text.blank_to_null(c["stamp"])
        by_attr = F.when(p["date_attr"] != "ignore", dates.iso_date(F.replace(stamp, F.lit("Z"), F.lit("+00:00"))))
        by_text = F.when((p["date_attr"] != "strict") | stamp.isNull(), dates.parse_date_text(c["date"], year))
        venue = (F.when(p["fixed_venue"], fixed_venue)
                 .when(p["blank_venue"], canonical_venue(F.coalesce(c["venue"], F.lit(config.VENUE_TBA))))
                 .otherwise(venue_or_tba(c["venue"])))
        link = c["link"]
        url = (F.when(p["link_rule"] == "absolute", text.absolute_url(link, None))
               .when(p["link_rule"] == "prefix", text.absolute_url(link, p["base_url"])).otherwise(link))
        return F.struct(c["rank"].alias("rank"), _event(c["title"], venue, F.coalesce(by_attr, by_text), c["time"], url).alias("event"))

    built = F.filter(F.transform(read, build), lambda e: F.coalesce((e["event"]["artist"] != "") & e["event"]["date"].isNotNull(), F.lit(False)))

    def best(events: Column) -> Column:
        # each made once: a lambda repeats what it refers to for every element
        return text.let(F.array_min(F.transform(events, lambda e: e["rank"])),
                        lambda least: F.transform(F.filter(events, lambda e: e["rank"] == least), lambda e: e["event"]))

    return text.let(built, best)


@lru_cache(maxsize=16)
def _attempts(application: str, year: int) -> tuple[Column, Column, Column, Column, Column]:
    """The four attempts as expressions over html, page_venue and the profile's columns. The tree is read for saved city pages, and for cards where
    structured data and page state gave nothing. Built once per session and year, since they are large."""
    html = F.col("html")
    cols = {f: F.col(f) for f in PROFILE_FIELDS}
    ld = F.when(cols["jsonld"], jsonld_events(
        html, F.when(cols["fixed_venue"], F.col("page_venue")), cols["jsonld_graph"], cols["jsonld_date_time"])).otherwise(_no_events())
    state = F.when(cols["page_state"] & (F.size("_ld") == 0), page_state_events(html)).otherwise(_no_events())
    none = (F.size("_ld") + F.size("_state")) == 0
    read = read_cards(F.col("layout"), F.when(none | cols["saved_city"], html), cols["saved_city"], none)
    return ld, state, read, saved_city_events(F.col("_read.links"), year), card_events(F.col("_read.cards"), cols, F.col("page_venue"), year)


def page_events(pages: DataFrame, year: int, profiles: DataFrame | None = None) -> DataFrame:
    """``pages`` (kind, html, page_venue and any lineage) with ``events``, the array found by the page's profile, and ``error``, why it
    could not be read; a page with an error has no events and disturbs no other.

    Order of attempts: saved city page, structured data, page state, cards; each only where the profile uses it. ``profiles``: a table of further
    profiles (``profiles.SCHEMA``), one row for each kind. A page may bring ``fetch_error``, the message of a landing step that failed. Pages of a kind
    without a profile fail as well.
    """
    spark = pages.sparkSession
    lineage = [c for c in pages.columns if c != "fetch_error"]
    ld, state, read, city, cards = _attempts(spark.sparkContext.applicationId, year)
    p = profile_dim(spark)
    p = F.broadcast(p) if profiles is None else p.unionByName(profiles)  # eight rows; a table of unknown size is left to the planner
    x = pages.join(p.withColumnRenamed("kind", "_kind"), F.col("kind") == F.col("_kind"), "left")
    x = x.withColumn("_ld", ld).withColumn("_state", state).withColumn("_read", read)
    x = x.withColumn("_city", city).withColumn("_card", cards)
    found = (F.when(F.size("_city") > 0, F.col("_city")).when(F.size("_ld") > 0, F.col("_ld"))
             .when(F.size("_state") > 0, F.col("_state")).otherwise(F.col("_card")))
    failed = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    error = (F.when(failed.isNotNull(), F.concat(F.lit("Request failed: "), F.substring(failed, 1, 80)))
             .when(F.col("_kind").isNull(), F.concat(F.lit("Parse error: no profile "), F.coalesce("kind", F.lit("null"))))
             .when(F.col("_read.error").isNotNull(), F.concat(F.lit("Parse error: "), F.substring("_read.error", 1, 80))))
    return x.select(*lineage, "source_text", "drop_outside", "apply_rules", (F.size("_city") > 0).alias("from_city"),
                    F.when(error.isNull(), found).otherwise(_no_events()).alias("events"), error.alias("error"))


def stage_pages(pages: DataFrame, p: RunParams, profiles: DataFrame | None = None) -> DataFrame:
    """Staged listings of web pages.

    ``pages``: kind, html, page_venue, source_name, source_rank, origin, endpoint_rank. Where a source has
    several endpoints only the first that yields any event is used.
    """
    return stage_events(page_events(pages, p.year, profiles), p)


def page_errors(events: DataFrame) -> DataFrame:
    """What failed, out of ``page_events`` that have been cut or written (its listings are read from them as well): per source the number of its
    pages, of those that failed, and the message of the first one."""
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("endpoint_rank", "origin", "error")))
    return (events.groupBy("source_rank", "source_name").agg(F.count(F.lit(1)).alias("n_pages"), F.count("error").alias("n_failed"), first.alias("first"))
            .select("source_rank", "source_name", "n_pages", "n_failed", F.col("first.origin").alias("origin"), F.col("first.error").alias("error")))


def bad_scripts(pages: DataFrame) -> DataFrame:
    """Embedded scripts that are no JSON or whose events end at a value of a wrong type; ``pos`` is the script's place in its page.

    ``pages``: html, source_name, source_rank, origin. The state of a page, if it is bad, comes after its structured data.
    """
    def why(script: Column) -> Column:
        def stops(item: Column) -> Column:
            return F.coalesce(structured_event(item, None, F.lit(True))["stop"], F.lit(False)) | ~_is_object(item)

        def widen(item: Column) -> Column:
            return F.coalesce(F.try_variant_get(item, "$[\"@graph\"]", "array<variant>"), F.array(item))

        return text.let(F.try_parse_json(script), lambda v: F.when(v.isNull(), quarantine.NOT_JSON).when(
            F.exists(F.flatten(F.transform(_elements(v), widen)), stops), quarantine.WRONG_TYPE))

    html = F.col("html")
    scripts = F.when(F.contains(html, F.lit("ld+json")), F.regexp_extract_all(html, F.lit(markup.SCRIPT_JSONLD), F.lit(1))).otherwise(F.array().cast("array<string>"))
    state = F.when(F.contains(html, F.lit("__NEXT_DATA__")), F.regexp_extract_all(html, F.lit(markup.SCRIPT_STATE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.transform(scripts, lambda x: F.struct(x.alias("record"), why(x).alias("reason"))),
                     F.transform(state, lambda x: F.struct(x.alias("record"), F.when(F.try_parse_json(x).isNull(), quarantine.NOT_JSON).alias("reason"))))
    rows = pages.select("source_name", "source_rank", "origin", F.posexplode(found).alias("pos", "r"))
    return quarantine.bad_rows(rows, F.col("r.reason"), F.col("r.record"), F.col("source_name"), F.col("source_rank"))


def unread_pages(events: DataFrame) -> DataFrame:
    """Pages with an error, out of ``page_events``."""
    return quarantine.bad_rows(events.withColumn("pos", F.lit(None)), F.when(F.col("error").isNotNull(), quarantine.UNREAD), F.col("error"), F.col("source_name"), F.col("source_rank"))


def stage_events(events: DataFrame, p: RunParams) -> DataFrame:
    """Staged listings out of ``page_events``."""
    # the outer form keeps the planner from testing size(events) first, which would extract everything twice
    ev = events.select("*", F.posexplode_outer("events").alias("pos", "e")).drop("events", "error")
    ev = ev.where(F.col("e").isNotNull())
    source = (F.when(F.col("source_text") == "", F.col("source_name"))
              .when(F.col("source_text") != "artifact", F.col("source_text"))
              .when(F.col("from_city"), F.lit(config.ARTIFACTS_CITY_PAGE))
              .otherwise(F.concat(F.lit("Artifacts ("), F.element_at(F.split("origin", "/"), -1), F.lit(")"))))
    inside_window = in_window(F.col("date"), p)
    rows = ev.select("e.*", source.alias("source"), "source_name", "source_rank", "origin",
                     F.col("pos").cast("long").alias("pos"), "endpoint_rank", "drop_outside", "apply_rules", "kind")
    found = ~F.col("drop_outside") | inside_window
    music = ~F.col("apply_rules") | is_music(F.col("artist"), F.lit("music"))
    kept = found & music & inside_window
    return rows.select(
        "artist", "venue", "date", "time", "source", "url", "source_name", "source_rank", "origin", "pos",
        found.alias("found"), kept.alias("kept"),
        (found & ~kept & (F.col("kind") != "artifact")).alias("filtered"), "endpoint_rank")
