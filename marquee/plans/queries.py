"""Registered queries: each operator run over whole driver tables, or over documents Spark derives from them."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.functions import dates, markup, text
from marquee.operators import audit, dedup, fallback, intake, overrides, quarantine, rules, venues
from marquee.operators.manifest_store import ManifestStore, merge_files, read_manifest
from marquee.plans import publish
from marquee.session import cut, ensure_checkpoint_dir, spread
from marquee.sources import api, artifacts, pages, profiles, runlog, sheet
from marquee.sources import venues as calendars
from marquee.sources.request import Request

P = RunParams(datetime.date(2026, 2, 15), 7, "2026-02-15 05:58:42")
BASE = datetime.date(2026, 2, 15)
ALIASES = [a for _, a, _ in config.venue_aliases()]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if heavy else df


def _plus(n: Column) -> Column:
    return F.date_add(F.lit(BASE), n.cast("int"))


def _pick(values: list[str], n: Column) -> Column:
    """The ``n mod len`` th of a constant list."""
    return F.element_at(text.folded(values, "array<string>"), (n % len(values)).cast("int") + 1)


# --- duplicate removal ---------------------------------------------------------------------------------------

def documents_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as artists, languages as venues; exact and near copies of a text share its length's date."""
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    return d.select(
        F.col("text").alias("artist"), F.col("lang").alias("venue"), _plus(n % 8).alias("date"),
        F.when(n % 3 == 0, "7 PM").alias("time"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Venue: "), F.col("source"))).otherwise(F.col("source")).alias("source"),
        F.when(n % 5 == 0, F.concat(F.lit("http://x/"), F.col("doc_id"))).alias("url"),
        F.col("source").alias("source_name"), F.lit(0).alias("source_rank"), F.col("source").alias("origin"),
        F.col("doc_id").alias("pos"))


def part_listing(spark: SparkSession, sf: str, venue: str, spread: int) -> DataFrame:
    d = table(spark, sf, "part")
    k = F.col("p_partkey")
    artist = F.when(k % 3 == 0, F.concat_ws(" ", "p_name", F.lower("p_type"))).when(k % 7 == 0, F.concat(F.lit("The "), F.col("p_name"), F.lit(" Live"))).otherwise(F.col("p_name"))
    return d.select(
        artist.alias("artist"), F.col(venue).alias("venue"), _plus(F.col("p_size") % spread).alias("date"),
        F.when(k % 2 == 0, "8 PM").alias("time"), F.when(k % 11 == 0, "Ticketmaster").otherwise("Sheet").alias("source"),
        F.when(k % 5 == 0, F.concat(F.lit("http://x/"), k)).alias("url"), F.lit("parts").alias("source_name"),
        F.lit(0).alias("source_rank"), F.lit("part").alias("origin"), k.alias("pos"))


def _survivors(d: DataFrame) -> DataFrame:
    return d.select("date", "venue", F.md5("artist").alias("artist_md5"), "time", "url", "source", "pos")


@query
def listing_dedup(spark, sf):
    """Flagship: windowed listings deduplicated and put in publishing order."""
    listing = documents_listing(spark, sf).where(rules.in_window(F.col("date"), P))
    return _survivors(dedup.published(listing))


@query
def dedup_parts(spark, sf):
    return _survivors(dedup.deduplicate(part_listing(spark, sf, "p_brand", 8)))


@query
def windowed_dedup(spark, sf):
    """A third of the dates lie outside the window."""
    return _survivors(dedup.deduplicate(part_listing(spark, sf, "p_brand", 12).where(rules.in_window(F.col("date"), P))))


@query
def dedup_crowded(spark, sf):
    """The same result for blocks treated as too large to gather: one date, few venues."""
    return _survivors(dedup.deduplicate(part_listing(spark, sf, "p_type", 1), max_rows=50))


@query
def artist_match(spark, sf):
    d = table(spark, sf, "part")
    return d.select("p_partkey",
                    dedup.artists_match(F.col("p_name"), F.concat(F.lit("The "), F.col("p_name"), F.lit(" Tour"))).alias("same"),
                    dedup.artists_match(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand")).alias("other"),
                    dedup.artists_match(F.concat_ws(" ", "p_name", "p_type", "p_brand"),
                                        F.concat_ws(" ", "p_brand", "p_type", F.substring_index("p_name", " ", 1))).alias("words"))


@query
def detail_score(spark, sf):
    d = documents_listing(spark, sf)
    return d.select("pos", dedup.detail_score(F.col("artist"), F.col("time"), F.col("url"), F.col("source")).alias("score"))


# --- text and dates ------------------------------------------------------------------------------------------

@query
def text_normalize(spark, sf):
    d = table(spark, sf, "documents", heavy=True).select("doc_id", text.identity_norm(F.col("text")).alias("i"), text.match_norm(F.col("text")).alias("m"))
    return d.select("doc_id", F.md5("i").alias("identity_md5"), F.md5("m").alias("match_md5"), F.size(text.words(F.col("m"))).alias("n_words"))


@query
def identity_key(spark, sf):
    d = table(spark, sf, "part")
    return d.select("p_partkey", text.identity_key(F.concat(F.lit("The "), F.col("p_name"), F.lit("!")), F.col("p_brand"), _plus(F.col("p_size"))).alias("key"))


DATE_LAYOUTS = ["MMM d, yyyy", "MMMM d, yyyy", "MMM d", "M/d/yyyy", "MM/dd/yy", "M-d-yyyy", "MM-dd-yy", "M.d.yyyy", "MM.dd.yy",
                "M.d", "yyyy-M-d", "MMMM d", "M/d", "EEE MMM d", "'Doors 7 'MMM d", "'  'MMM'  'd', 'yyyy' '", "MMM d yyyy"]


def _loose_dates(spark, sf) -> DataFrame:
    d = table(spark, sf, "orders", heavy=True).withColumn("layout", (F.col("o_orderkey") % len(DATE_LAYOUTS)).cast("int"))
    shown = F
    for i, layout in enumerate(DATE_LAYOUTS):
        shown = shown.when(F.col("layout") == i, F.date_format("o_orderdate", layout))
    return d.select("o_orderkey", shown.alias("shown"))


@query
def date_parse(spark, sf):
    return _loose_dates(spark, sf).select("o_orderkey", dates.parse_date_text(F.col("shown"), P.year).alias("parsed"))


@query
def sheet_date_parse(spark, sf):
    return _loose_dates(spark, sf).select("o_orderkey", dates.parse_sheet_date(F.col("shown"), P.year).alias("parsed"))


@query
def iso_parse(spark, sf):
    e = table(spark, sf, "events", heavy=True)
    k = F.col("event_id") % 5
    shown = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-06:00'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
             .when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.date_format("ts", "yyyyMMdd'T'HHmmss"))
             .otherwise(F.date_format("ts", "MMM d HH:mm")))
    x = e.select("event_id", shown.alias("shown"))
    return x.select("event_id", dates.iso_date(F.col("shown")).alias("day"),
                    F.when(dates.iso_date(F.col("shown")).isNotNull(), dates.iso_clock(F.col("shown"))).alias("time"))


@query
def time_display(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", dates.clock_of(F.col("ts")).alias("clock"),
                    dates.clock_text(F.date_format("ts", "HH:mm:ss")).alias("clock_text"), dates.day_heading(F.col("ts")).alias("heading"))


@query
def utc_to_local(spark, sf):
    ts = F.expr("ts + make_dt_interval(cast(event_id % 600 as int))")
    e = table(spark, sf, "events").select("event_id", ts.alias("ts"))
    return e.select("event_id", dates.local_stamp(F.col("ts")).alias("page_stamp"), dates.build_stamp(F.col("ts")).alias("build_stamp"))


@query
def split_day_time(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "MMM d")).otherwise(
        F.concat(F.date_format("ts", "MMM d"), F.lit(" - "), F.date_format("ts", "h:mm a"), F.lit(" - late"))).alias("x"))
    day, time = dates.split_day_and_time(F.col("x"))
    return e.select("event_id", dates.parse_date_text(day, P.year).alias("day"), time.alias("time"))


# --- filters and lookups -------------------------------------------------------------------------------------

@query
def window_filter(spark, sf):
    d = table(spark, sf, "orders")
    p = RunParams(datetime.date(1998, 10, 1))
    return d.where(rules.stamp_in_window(F.col("o_orderdate"), p)).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query
def radius_filter(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    at = c.select("c_custkey", (F.lit(config.CENTER_LAT) + ((k * 37) % 2001 - 1000) / 1000.0).alias("lat"),
                  (F.lit(config.CENTER_LON) + ((k * 53) % 2003 - 1000) / 1000.0).alias("lon"))
    miles = rules.miles_between(F.lit(config.CENTER_LAT), F.lit(config.CENTER_LON), F.col("lat"), F.col("lon"))
    return at.where(rules.in_radius(F.col("lat"), F.col("lon"))).select("c_custkey", F.round(miles, 3).alias("miles"))


def _venue_names(spark, sf) -> DataFrame:
    d = table(spark, sf, "orders", heavy=True)
    k = F.col("o_orderkey")
    alias = _pick(ALIASES, F.floor(k / 5))
    shown = (F.when(k % 5 == 0, F.upper(alias)).when(k % 5 == 1, F.concat(F.lit("  "), alias, F.lit(" ")))
             .when(k % 5 == 2, F.concat(alias, F.lit(" (main room)"))).when(k % 5 == 3, F.substring_index(alias, " ", 1))
             .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))))
    return d.select("o_orderkey", shown.alias("name"))


@query
def venue_resolve(spark, sf):
    d = _venue_names(spark, sf)
    return d.select("o_orderkey", venues.exact_venue(F.col("name")).alias("exact"), venues.contained_venue(F.col("name")).alias("contained"),
                    venues.canonical_venue(F.col("name")).alias("venue"))


@query
def venue_table(spark, sf):
    """The lookup against an alias table instead of the fixed list."""
    n = table(spark, sf, "nation")
    aliases = n.select(F.col("n_nationkey").alias("alias_rank"), F.lower("n_name").alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("canonical"))
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey")))
                                            .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("hall nation_"), F.col("c_nationkey"))).otherwise(F.col("c_name")).alias("name"))
    return venues.resolve_with_table(c, aliases, "name", "venue").select("c_custkey", "venue")


@query
def rule_classify(spark, sf):
    d = table(spark, sf, "part")
    k = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", _pick(config.EXCLUDE_KEYWORDS + [""] * 20, k), _pick(config.INCLUDE_KEYWORDS + [""] * 60, F.floor(k / 3)))
    cat = _pick(["music", "", "Concerts", "arts"], F.floor(k / 7))
    desc = _pick(["", "at the shell", "b-side", "x"], F.floor(k / 11))
    return d.select("p_partkey", rules.is_music(title, cat, desc).alias("music"))


@query
def rule_classify_documents(spark, sf):
    d = table(spark, sf, "documents", heavy=True)
    return d.select("doc_id", rules.is_music(F.col("text"), F.lit("music")).alias("with_category"), rules.is_music(F.col("text")).alias("plain"))


# --- lines and addresses -------------------------------------------------------------------------------------

def conversation_listing(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") + F.col("turn")
    return c.select("conv_id", "turn", F.col("text").alias("artist"), F.concat(F.lit('A&B "'), F.col("role"), F.lit('" <x>')).alias("venue"),
                    F.when(k % 2 == 0, "7 PM").when(k % 3 == 0, "").alias("time"),
                    F.when(k % 4 == 0, F.concat(F.lit("http://x/?a=1&b="), F.col("conv_id"))).alias("url"), _plus(k % 8).alias("date"))


@query
def listing_lines(spark, sf):
    c = conversation_listing(spark, sf)
    cols = [F.col(x) for x in ("artist", "venue", "time", "url")]
    return c.select("conv_id", "turn", F.md5(text.display_line(*cols[:3])).alias("plain_md5"), F.md5(text.page_line(*cols)).alias("page_md5"),
                    F.md5(text.html_escape(F.col("artist"))).alias("escaped_md5"))


@query
def rss_items(spark, sf):
    c = conversation_listing(spark, sf)
    return c.select("conv_id", "turn", F.md5(publish.rss_item(F.col("artist"), F.col("venue"), F.col("date"), F.col("time"), F.col("url"))).alias("item_md5"))


@query
def url_clean(spark, sf):
    d = table(spark, sf, "pages")
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    rel = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(path)
    return d.select("page_id", text.strip_query(F.col("url")).alias("clean"), text.absolute_url(rel, "https://base.example").alias("prefixed"),
                    text.absolute_url(rel, None).alias("absolute_only"))


# --- audit ---------------------------------------------------------------------------------------------------

EVENT_SOURCES = [("view", 0, True, None, None), ("click", 1, True, None, None), ("purchase", 2, True, None, None), ("signup", 3, True, None, None),
                 ("error", 4, False, "Request failed: https://x.example/a?b=1 HTTPSConnectionPool(host='x')", None), ("absent", 5, True, None, "no rows"),
                 ("down", 6, False, None, None)]
AUDIT_WINDOW = RunParams(datetime.date(2024, 1, 10), 7, "2024-01-10 12:00:00")


def event_audit(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    src = spark.createDataFrame(EVENT_SOURCES, audit.SOURCE_DIM)
    rank = F.element_at(text.folded({s[0]: s[1] for s in EVENT_SOURCES}, "map<string,int>"), F.col("event_type"))
    inside = rules.stamp_in_window(F.col("ts"), AUDIT_WINDOW)
    staged = e.select(rank.alias("source_rank"), F.lit(True).alias("found"), inside.alias("kept"), (~inside & (F.col("value") > 20)).alias("filtered"))
    return audit.source_audit(staged, F.broadcast(src), F.lit(AUDIT_WINDOW.run_ts))


@query
def source_audit(spark, sf):
    return event_audit(spark, sf).drop("run_ts")


@query
def source_status_lines(spark, sf):
    a = event_audit(spark, sf)
    c = F.col
    return a.select("source_rank", audit.status_icon(c("success"), c("events_found")).alias("icon"),
                    audit.status_line(c("source_name"), c("success"), c("events_found"), c("events_filtered"), c("error")).alias("line"),
                    audit.public_status_line(c("source_name"), c("success"), c("events_found")).alias("public_line"),
                    audit.public_error(c("error")).alias("public_error"))


@query
def source_health(spark, sf):
    return audit.source_health(event_audit(spark, sf))


@query
def source_failures(spark, sf):
    return audit.failures(event_audit(spark, sf))


@query
def source_rollup(spark, sf):
    return audit.rollup(event_audit(spark, sf), "All sources")


@query
def run_totals(spark, sf):
    deduped = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return audit.run_totals(event_audit(spark, sf), deduped)


@query
def health_history(spark, sf):
    e = table(spark, sf, "events")
    runs = e.groupBy(F.col("event_type").alias("source_name"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("run_ts")).agg(
        F.count("*").alias("events_after_filter"), (F.count("*") % 3 != 0).alias("success"))
    return audit.health_history(runs)


@query
def origin_status(spark, sf):
    d = table(spark, sf, "documents")
    return audit.origin_status(d.select(F.lit(2).alias("source_rank"), F.col("source").alias("origin"), F.lit(True).alias("found"),
                                        (F.col("n_chars") % 3 != 0).alias("kept")))


# --- publishing ----------------------------------------------------------------------------------------------

def order_listing(spark, sf) -> DataFrame:
    d = table(spark, sf, "orders")
    return d.select(F.concat(F.lit("Order "), F.col("o_orderkey")).alias("artist"), F.col("o_orderpriority").alias("venue"),
                    F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderstatus") == "F", "7 PM").alias("time"),
                    F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderstatus") == "O", F.lit("http://x")).alias("url"),
                    F.col("o_orderkey").alias("slot"))


@query
def by_day(spark, sf):
    return publish.by_day(table(spark, sf, "events").select(F.col("ts").cast("date").alias("date")))


@query
def page_body(spark, sf):
    return publish.page_body(order_listing(spark, sf))


@query
def page_document(spark, sf):
    """The whole page: title, counts, days, sources."""
    a = event_audit(spark, sf)
    listing = order_listing(spark, sf)
    return publish.page(AUDIT_WINDOW, audit.run_totals(a, listing), audit.source_health(a), listing, "Orders & more", "Compiled daily")


@query
def text_summary(spark, sf):
    return publish.text_summary(order_listing(spark, sf))


@query
def run_log(spark, sf):
    a = event_audit(spark, sf)
    listing = order_listing(spark, sf)
    return publish.run_log(AUDIT_WINDOW, audit.run_totals(a, listing), a, listing)


@query
def json_feed(spark, sf):
    return publish.json_feed(P, order_listing(spark, sf))


# --- JSON ----------------------------------------------------------------------------------------------------

@query
def json_path(spark, sf):
    e = table(spark, sf, "events")
    v = F.try_parse_json("props")
    return e.select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"),
                    F.coalesce(F.try_variant_get(v, "$.venue.name", "string"), F.lit(config.UNKNOWN_VENUE)).alias("venue"))


@query
def json_walk(spark, sf):
    """All values of a nested document built around each event's properties, with their place in the walk."""
    e = table(spark, sf, "events", heavy=True)
    doc = F.concat(F.lit('{"a":['), F.col("props"), F.lit(","), F.col("event_id"), F.lit('],"b":{"c":'), F.col("props"), F.lit("}}"))
    nodes = e.select("event_id", F.posexplode(pages.walk_json(doc)).alias("n", "node"))
    return nodes.select("event_id", "n", F.try_variant_get("node.v", "$", "string").alias("value"))


@query
def model_responses(spark, sf):
    """Free-text answers holding a JSON array, built from whole conversation turns."""
    c = table(spark, sf, "conversations", heavy=True)
    k = F.col("conv_id") + F.col("turn")
    body = F.concat(F.lit("Here is what I found: "), F.to_json(F.array(
        F.struct(F.col("text").alias("artist"), F.lit("the hi-tone").alias("venue"), F.date_format(_plus(k % 12), "M/d/yyyy").alias("date"),
                 F.lit("9 PM").alias("time"), F.col("role").alias("source_note")),
        F.struct(F.col("role").alias("artist"), F.lit("").alias("venue"), F.lit("someday").alias("date"), F.lit("").alias("time"), F.lit("").alias("source_note")),
        F.struct(F.col("role").alias("artist"), F.lit("").alias("venue"), F.lit("Feb 16").alias("date"), F.lit("").alias("time"), F.lit("").alias("source_note")))),
        F.lit(" done"))
    origin = F.concat_ws("/", "conv_id", "turn")
    r = artifacts.stage_responses(c.select(origin.alias("origin"), body.alias("body")), P)
    return r.select("origin", "pos", F.md5("artist").alias("artist_md5"), "venue", "date", "time", "source", "kept")


# --- sources -------------------------------------------------------------------------------------------------

@query
def api_ticketing(spark, sf):
    d = table(spark, sf, "orders", heavy=True)
    k = F.col("o_orderkey")
    def event(name: Column, day: Column, time: Column, venue: Column) -> Column:
        return F.struct(name.alias("name"), F.concat(F.lit("http://t/"), k).alias("url"),
                        F.struct(F.struct(day.alias("localDate"), time.alias("localTime")).alias("start")).alias("dates"),
                        F.struct(F.array(F.struct(venue.alias("name"))).alias("venues")).alias("_embedded"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    events = F.array(event(F.concat(F.lit(" Order "), k), day, F.format_string("%02d:%02d:%02d", F.floor(k * 61 / 3600) % 24, F.floor(k * 61 / 60) % 60, k * 61 % 60), F.lit("Growlers")),
                     event(_pick(["", "Trivia Night", "Jazz Trivia", "Coldplay"], k), day, F.lit("late"), F.col("o_orderpriority")),
                     event(F.lit("No date"), F.when(k % 2 == 0, "soon"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    body = F.to_json(F.struct(F.struct(events.alias("events")).alias("_embedded")))
    r = api.stage_ticketing(d.select(k.cast("string").alias("origin"), body.alias("body")))
    return r.select("origin", "pos", F.col("artist"), "venue", "date", "time", "url", "kept", "filtered")


@query
def api_request(spark, sf):
    """Events that answer a request for dates, a category and a circle; some lack coordinates or a category."""
    d = table(spark, sf, "orders", heavy=True)
    k = F.col("o_orderkey")
    lat = F.lit(config.CENTER_LAT) + ((k * 37) % 2001 - 1000) / 1000.0
    lon = F.lit(config.CENTER_LON) + ((k * 53) % 2003 - 1000) / 1000.0
    place = F.struct(F.when(k % 10 != 3, lat.cast("string")).alias("latitude"), F.when(k % 10 != 4, lon.cast("string")).otherwise("east").alias("longitude"))
    event = F.struct(F.concat(F.lit("Order "), k).alias("name"), F.struct(F.struct(F.date_format(_plus(k % 12), "yyyy-MM-dd").alias("localDate")).alias("start")).alias("dates"),
                     F.when(k % 5 != 0, F.array(F.struct(F.struct(_pick(["Music", "Sports", "music"], k).alias("name")).alias("segment")))).alias("classifications"),
                     F.struct(F.array(F.struct(F.lit("Growlers").alias("name"), place.alias("location"))).alias("venues")).alias("_embedded"))
    body = F.to_json(F.struct(F.struct(F.array(event).alias("events")).alias("_embedded")))
    events = api.ticketing_events(d.select(k.cast("string").alias("origin"), body.alias("body")))
    return api.stage_ticketing_events(events, Request.of(P)).select("origin", "pos", "artist", "venue", "date", "kept", "filtered")


@query
def api_second(spark, sf):
    d = table(spark, sf, "documents", heavy=True)
    k = F.col("doc_id")
    event = F.struct(
        F.struct(F.when(k % 9 != 0, F.concat(F.lit("Doc "), k)).otherwise(F.lit(" ")).alias("text")).alias("name"),
        F.struct(F.date_format(_plus(F.col("n_chars") % 8), "yyyy-MM-dd'T'19:30:00").alias("local")).alias("start"), F.lit("http://e").alias("url"),
        F.struct(_pick(["Music", "", "Arts"], k).alias("name")).alias("category"), F.struct(F.col("text").alias("text")).alias("description"),
        F.struct(F.when(k % 2 == 0, F.lit("GPAC Main")).otherwise(F.lit("")).alias("name"),
                 F.struct(F.when(k % 4 == 1, F.concat(F.lit("Street "), k)).alias("localized_address_display")).alias("address")).alias("venue"))
    body = F.to_json(F.struct(F.array(event).alias("events")))
    r = api.stage_second(d.select(k.cast("string").alias("origin"), body.alias("body")), 4)
    return r.select("origin", "artist", "venue", "date", "time", "url", "kept", "filtered")


@query
def sheet_rows(spark, sf):
    """CSV records of five shapes: plain, short, too long, quoted, sparse."""
    d = table(spark, sf, "orders", heavy=True)
    k = F.col("o_orderkey")
    day = F.date_format(_plus(k % 12), "M/d/yyyy")
    line = (F.when(k % 5 == 0, F.concat(day, F.lit(",Act "), k, F.lit(",the shell,9 PM,flyer")))
            .when(k % 5 == 1, F.concat(day, F.lit(",Act "), k, F.lit(",Growlers")))
            .when(k % 5 == 2, F.concat(day, F.lit(",Act "), k, F.lit(",Growlers,9 PM,n,extra")))
            .when(k % 5 == 3, F.concat(day, F.lit(',"Act, ""'), k, F.lit('""",b side,"7, 8",')))
            .otherwise(F.concat(day, F.lit(",Act "), k, F.lit(",,,"))))
    s = sheet.parse_lines(d.select(F.lit("orders").alias("origin"), k.alias("pos"), line.alias("line")), ["Date ", "Artist", "VENUE", "time", "source_note"])
    return sheet.stage_sheet(s, P).select("pos", "artist", "venue", "date", "time", "source")


@query
def sheet_files(spark, sf):
    """Whole CSV files, one for each part, under three headers; cells with line breaks and quotes, empty, short and long records."""
    d = table(spark, sf, "part", heavy=True)
    k = F.col("p_partkey")
    day = F.date_format(_plus(k % 12), "M/d/yyyy")
    name = F.concat(F.lit('"Act ""'), k, F.lit('"", the\n'), "p_name", F.lit('"'))
    third = F.concat(F.lit("Doors,Act,Place,Event Date\n9 PM,"), name, F.lit(",b side,"), day, F.lit("\n9 PM,"), name, F.lit("\n"))
    body = (F.when(k % 3 == 0, F.concat(F.lit("date,artist,venue\n"), day, F.lit(","), name, F.lit(",shell\n\n"), day, F.lit(",Other,shell,more\n")))
            .when(k % 3 == 1, F.concat(F.lit(" Venue ,TIME,Date,Artist,Source_Note\r\nGrowlers,,"), day, F.lit(","), name, F.lit(",flyer\r\nGrowlers,7 PM,"), day, F.lit(",Long,n,x")))
            .otherwise(third))
    s = sheet.parse_files(d.select(k.cast("string").alias("origin"), body.alias("body")))
    return sheet.stage_sheet(s, P).select("origin", "pos", "artist", "venue", "date", "time", "source")


@query
def archive_decode(spark, sf):
    """Web archives built around whole pages, decoded back."""
    d = table(spark, sf, "pages")
    head = "MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=\"BB\"\r\n\r\n--BB\r\nContent-Type: text/css\r\n\r\np{}\r\n--BB\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    content = F.concat(F.lit(head).cast("binary"), F.base64(F.encode("html", "UTF-8")).cast("binary"), F.lit("\r\n--BB--\r\n").cast("binary"))
    x = artifacts.decode_archives(d.select(F.col("page_id").cast("string").alias("origin"), content.alias("content")))
    return x.select(F.col("origin").cast("long").alias("page_id"), F.md5("html").alias("html_md5"))


def titled_pages(spark, sf) -> DataFrame:
    """Whole pages with a card and a structured-data block made of their own title and address added."""
    d = table(spark, sf, "pages", heavy=True)
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    day = F.date_format(_plus(F.col("page_id") % 12), "yyyy-MM-dd")
    return d.select("page_id", "url", "html", raw.alias("raw_title"), day.alias("day"))


@query
def page_cards(spark, sf):
    """Card extraction over whole pages, the card placed inside each page."""
    d = titled_pages(spark, sf)
    card = F.concat(F.lit('<div class="list"><div class="wide event-card"><h3>'), F.col("raw_title"), F.lit('</h3><div><div class="summary-title"><a href="'),
                    F.col("url"), F.lit('">more</a></div></div><time datetime="'), F.col("day"), F.lit('">soon</time></div><h2>after</h2></div>'))
    x = d.select(F.lit("generic").alias("kind"), F.replace("html", F.lit("<article>"), F.concat(card, F.lit("<article>"))).alias("html"),
                 F.lit("Growlers").alias("page_venue"), F.lit("Venue: Growlers").alias("source_name"), F.lit(5).alias("source_rank"),
                 F.col("page_id").cast("string").alias("origin"), F.lit(0).alias("endpoint_rank"))
    r = pages.stage_pages(x, P)
    return r.select("origin", "pos", F.md5("artist").alias("artist_md5"), "venue", "date", "time", "url", "source", "kept", "filtered")


@query
def page_jsonld(spark, sf):
    """Structured data over whole pages."""
    d = titled_pages(spark, sf)
    item = F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.col("url").alias("name"), F.concat(F.col("day"), F.lit("T19:30:00-06:00")).alias("startDate"),
                              F.struct(F.lit("the shell").alias("name")).alias("location"), F.col("url").alias("url")))
    other = F.lit('{"@graph":[{"@type":["Event"],"name":"no"},{"@type":"Event","name":"Plain","startDate":"2026-02-16","location":"x"}]}')
    script = F.concat(F.lit('<script type="application/ld+json">['), item, F.lit(","), other, F.lit(']</script><script type="application/ld+json">{bad</script><article>'))
    x = d.select(F.lit("generic").alias("kind"), F.replace("html", F.lit("<article>"), script).alias("html"),
                 F.lit("Growlers").alias("page_venue"), F.lit("Venue: Growlers").alias("source_name"), F.lit(5).alias("source_rank"),
                 F.col("page_id").cast("string").alias("origin"), F.lit(0).alias("endpoint_rank"))
    return pages.stage_pages(x, P).select("origin", "pos", "artist", "venue", "date", "time", "url", "source", "kept", "filtered")


PROFILE_KINDS = ["hi_tone", "minglewood", "hernandos", "artifact", "marketplace", "city_page", "newspaper", "saved_city", "page_state"]


@query
def page_profiles(spark, sf):
    """Every page profile: a page per part in the layout its number picks, with a decoy card that must not count."""
    d = table(spark, sf, "part", heavy=True)
    k = F.col("p_partkey")
    day = F.date_format(_plus(F.col("p_size") % 12), "MMM d")
    name = F.concat(F.lit("Act "), F.col("p_name"), F.lit(" "), k)
    href = F.concat(F.lit("/event/"), k)
    def page(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    html = {
        "hi_tone": page('<div class="x eventWrapper"><h2> ', name, ' </h2><div class="eventMonth a">', day, '</div><a href="', href, '">t</a></div><div class="eventWrapper"><h2>x</h2></div>'),
        "minglewood": page('<div class="seven columns"><div class="tw-name">', name, '</div><p class="tw-date-time">', day, '</p></div><div class="seven"><div class="tw-name">z</div><p class="tw-date-time">', day, "</p></div>"),
        "hernandos": page('<div class="event-info-block"><p class="title"><a href="', href, '">', name, '</a></p><p class="date">', day, '</p><i class="see-showtime">8 pm</i></div>'),
        "artifact": page('<div class="event-item"><h3>none</h3></div><article class="an-event"><h4>', name, '</h4><time>', day, '</time><p class="location">DKDC</p></article>'),
        "marketplace": page('<div class="EventRow"><a href="', href, '"><h3>', name, '</h3></a><time datetime="', F.date_format(_plus(F.col("p_size") % 12), "yyyy-MM-dd"), '">x</time></div>'),
        "city_page": page('<div class="EventCard"><h4>', name, '</h4><p class="date">', day, '</p><p class="venue">B Side</p><a href="', href, '">t</a></div>'),
        "newspaper": page('<div class="listing-item"><h3><a href="', href, '">', name, '</a></h3><p class="EventDate">', day, '</p><p class="EventTime">8 pm</p><p class="EventVenue">bar</p></div>'),
        "saved_city": page('<a class="c" href="http://c/e/', k, '?x=1"><div><div></div><div><div><div>', name, '</div><div>growlers</div></div><div>', day, ' - 8:00 PM</div></div></div></a>'),
        "page_state": page('<script id="__NEXT_DATA__" type="a">{"p":{"q":[{"@type":"Event","name":"', name, '","startDate":"', F.date_format(_plus(F.col("p_size") % 12), "yyyy-MM-dd"), 'T20:00:00Z"}]}}</script>'),
    }
    n = (k % len(PROFILE_KINDS)).cast("int")
    body, kind = F, F
    for i, name_ in enumerate(PROFILE_KINDS):
        body = body.when(n == i, html[name_])
        kind = kind.when(n == i, F.lit({"saved_city": "artifact", "page_state": "marketplace"}.get(name_, name_)))
    x = d.select(kind.alias("kind"), body.alias("html"), F.lit("House").alias("page_venue"), F.lit("Venue: House").alias("source_name"),
                 F.lit(5).alias("source_rank"), k.cast("string").alias("origin"), F.lit(0).alias("endpoint_rank"))
    return pages.stage_pages(x, P).select("origin", "artist", "venue", "date", "time", "url", "source", "found", "kept", "filtered")


@query
def saved_city_links(spark, sf):
    """Saved city pages, one for each part: links in every layout, with references in texts and addresses, elements left open, and links that are no event."""
    d = table(spark, sf, "part", heavy=True)
    k = F.col("p_partkey")
    day = F.date_format(_plus(F.col("p_size") % 12), "MMM d")

    def link(path: str, *parts: Column | str) -> Column:
        return F.concat(F.lit(f'<a class="x" href="{path}'), k, F.lit('?a=1&amp;b=2">'), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("</a>"))

    name = F.col("p_name")
    html = F.concat(
        link("https://c/e/", "<div><div><img></div><div><div><div>", name, " &eacute</div><div>growlers</div></div><div>", day, " - 8:00 PM</div></div></div>"),
        link("https://c&#47;e/", "<div><div>", "<div><div>", name, "</div></div><div>Doors</div><div>", day, "</div></div></div>"),
        link("/e/", "<div><div><div><b>", name, "</b> ", "<i>x</i></div><p>in no block</p><div>", day, " - late - night</div></div></div>"),
        link("/e/", "<div><div> </div></div><span>", name, "| bar |", day, "</span>"),
        link("/e/", "<div><p>", name, "<p>The Shell<p>", day, "</div>"),
        link("/event/", "<div><div><div>", name, "</div><div>", day, "</div></div></div>"),
        link("/e/", "<div><div><div>", name, "</div><div>no day</div></div></div>"),
        link("/e/", name, " | bar | ", day),
        F.lit("<div class='event-card'><h3>card</h3><time>Feb 17</time></div>"))
    x = d.select(F.lit("artifact").alias("kind"), html.alias("html"), F.lit(None).cast("string").alias("page_venue"), F.lit("Artifacts").alias("source_name"),
                 F.lit(5).alias("source_rank"), k.cast("string").alias("origin"), F.lit(0).alias("endpoint_rank"))
    return pages.stage_pages(x, P).select("origin", "pos", "artist", "venue", "date", "time", "url", "source", "kept")


@query
def venue_fanout(spark, sf):
    """One audit row per venue calendar from one plan over all pages."""
    d = titled_pages(spark, sf)
    keys = [v[0] for v in config.VENUES]
    card = F.concat(F.lit('<div class="event-item"><h3>'), F.col("raw_title"), F.lit('</h3><time datetime="'), F.col("day"), F.lit('">x</time></div>'))
    x = d.select(_pick(keys, F.col("page_id")).alias("venue_key"), F.col("page_id").cast("string").alias("origin"), F.concat("html", card).alias("html"))
    staged = pages.stage_pages(calendars.venue_pages(x), P)
    src = calendars.calendar_sources(spark).select("source_name", "source_rank", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
                                                   F.lit(config.MSG_EMPTY_VENUE).alias("empty_message"))
    return audit.source_audit(staged, F.broadcast(src), F.lit(P.run_ts)).drop("run_ts")


#: A site without code: a row of the profile table; the second row's selector cannot be read.
OWN_PROFILES = [
    profiles.Profile("own_rows", (".gig",), title=".gig-name", date="time", date_attr="prefer", link="a", link_rule="prefix", base_url="https://own.example", fixed_venue=True),
    profiles.Profile("own_broken", (".gig >> [",), title="h3", date="time", fixed_venue=True),
]


@query
def venue_errors(spark, sf):
    """Eleven sources from one plan over all pages, some of whose pages fail: not fetched, of a kind without a profile, or under a selector that cannot be read."""
    d = titled_pages(spark, sf)
    n = (F.col("page_id") % 11).cast("int")
    own = profiles.profile_rows(OWN_PROFILES)
    card = F.concat(F.lit('<div class="event-item gig"><h3 class="gig-name">'), F.col("raw_title"), F.lit('</h3><a href="/g">x</a><time datetime="'), F.col("day"), F.lit('">x</time></div>'))
    kind = F.when(n == 2, "own_broken").when(n == 7, "unheard_of").when(n % 3 == 0, "own_rows").otherwise("generic")
    name = F.concat(F.lit("Source "), n)
    x = d.select(kind.alias("kind"), F.concat("html", card).alias("html"), F.lit("Growlers").alias("page_venue"), name.alias("source_name"), (n + 3).alias("source_rank"),
                 F.lpad(F.col("page_id").cast("string"), 12, "0").alias("origin"), F.lit(0).alias("endpoint_rank"),
                 F.when((n == 5) | (F.col("page_id") % 22 == 4), F.concat(F.lit("404 for page "), "page_id")).alias("fetch_error"))
    events = cut(pages.page_events(x, P.year, spark.createDataFrame(own, profiles.SCHEMA)))
    errors = pages.page_errors(events)
    sources = d.select((n + 3).alias("source_rank"), name.alias("source_name")).distinct().select(
        "source_name", "source_rank", F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.lit(config.MSG_EMPTY_VENUE).alias("empty_message"))
    rows = audit.source_audit(pages.stage_events(events, P), audit.with_page_errors(sources, errors), F.lit(P.run_ts)).drop("run_ts")
    return rows.join(errors.select("source_rank", "n_pages", "n_failed"), "source_rank")


@query
def bad_records(spark, sf):
    """What adapters cannot use: API payloads and spreadsheet rows built from orders, scripts placed in whole pages."""
    o = table(spark, sf, "orders", heavy=True)
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def event(name: Column, day: Column) -> Column:
        return F.struct(name.alias("name"), F.struct(F.struct(day.alias("localDate")).alias("start")).alias("dates"))

    body = F.to_json(F.struct(F.struct(F.array(event(F.col("o_orderpriority"), day), event(F.when(k % 7 != 1, F.col("o_orderpriority")).otherwise(" "), F.when(k % 7 == 2, F.lit(None)).when(k % 7 == 3, "soon").otherwise(day))).alias("events")).alias("_embedded")))
    body = F.when(k % 7 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    line = (F.when(k % 6 == 0, F.concat(day, F.lit(","), "o_orderpriority")).when(k % 6 == 1, F.concat(day, F.lit(","), "o_orderpriority", F.lit(",shell,9 PM,a,b")))
            .when(k % 6 == 2, F.concat(F.lit(","), "o_orderpriority", F.lit(",shell,,"))).when(k % 6 == 3, F.concat(day, F.lit(", ,shell,,")))
            .when(k % 6 == 4, F.concat(F.lit("some day,"), "o_orderpriority", F.lit(",shell,,"))).otherwise(F.concat(day, F.lit(","), "o_orderpriority", F.lit(",shell,,"))))
    rows = sheet.parse_lines(o.select(F.lit("orders").alias("origin"), k.alias("pos"), line.alias("line")), ["Event Date", "Act", "Place", "Doors", "Notes"])
    d = table(spark, sf, "pages", heavy=True)
    n = F.col("page_id")
    script = F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"'), n, F.lit('","startDate":"2026-02-16"}</script><script type="application/ld+json">'),
                      F.when(n % 4 == 0, "{cut off").when(n % 4 == 1, '[{"@type":"Event","name":5},{}]').when(n % 4 == 2, '{"@graph":[{"@type":"Event","name":"a"},7]}').otherwise("[]"),
                      F.lit('</script><script id="__NEXT_DATA__">'), F.when(n % 3 == 0, "{").otherwise('{"a":[]}'), F.lit("</script><article>"))
    x = d.select(F.replace("html", F.lit("<article>"), script).alias("html"), F.lit("Pages").alias("source_name"), F.lit(5).alias("source_rank"), n.cast("string").alias("origin"))
    bad = quarantine.union(spark, [api.bad_ticketing(o.select(k.cast("string").alias("origin"), body.alias("body"))), sheet.bad_rows(rows, P), pages.bad_scripts(x)])
    return bad.select("source_name", "source_rank", "origin", "pos", "reason")


@query
def page_state_order(spark, sf):
    """Page state whose members are not in order of their names; which of two equal acts is the first depends on how it is written."""
    d = table(spark, sf, "part", heavy=True)
    k = F.col("p_partkey")
    day = F.date_format(_plus(F.col("p_size") % 8), "yyyy-MM-dd")

    def member(key: str, name: str, path: str) -> Column:
        return F.concat(F.lit(f'"{key}":{{"more":[{{"url":"{path}","name":"{name} '), k, F.lit(' \\"q\\" {x}","startDate":"'), day, F.lit('T20:00:00Z","@type":"Event"}]}'))

    z, m, a = member("z", "Act", "/z"), member("m", "Act", "/m"), member("a", "Other", "/a")
    comma = F.lit(",")
    body = F.when(k % 3 == 0, F.concat(z, comma, m, comma, a)).when(k % 3 == 1, F.concat(m, comma, a, comma, z)).otherwise(F.concat(a, comma, z, comma, m))
    html = F.concat(F.lit('<p>x</p><script id="__NEXT_DATA__" type="application/json">{"props":{'), body, F.lit("}}</script>"))
    x = d.select(F.lit("marketplace").alias("kind"), html.alias("html"), F.lit(None).cast("string").alias("page_venue"), F.lit("M").alias("source_name"),
                 F.lit(5).alias("source_rank"), k.cast("string").alias("origin"), F.lit(0).alias("endpoint_rank"))
    rows = pages.stage_pages(x, P)
    return rows.groupBy("origin", "artist").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"), F.count(F.lit(1)).alias("n"))


@query
def page_links(spark, sf):
    d = table(spark, sf, "pages")
    links = d.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<li><a href="([^"]*)">'), F.lit(1))).alias("pos", "href"))
    return links.select("page_id", "pos", text.absolute_url(F.col("href"), "https://base.example").alias("link"))


@query
def page_text(spark, sf):
    d = table(spark, sf, "pages")
    return d.select("page_id", F.md5(text.element_text(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1))).alias("h1_md5"),
                    F.md5(text.html_escape(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))).alias("title_md5"))


@query
def strategy_fallback(spark, sf):
    """Links of a page under the first pattern that finds any."""
    d = table(spark, sf, "pages")
    patterns = [r'<a class="x" href="([^"]*)"', r'<a href="(/[a-m][^"]*)"', r'<a href="([^"]*)"']
    rows = None
    for rank, p in enumerate(patterns):
        part = d.select("page_id", F.lit(rank).alias("rank"), F.posexplode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("pos", "href"))
        rows = part if rows is None else rows.unionByName(part)
    return fallback.first_yielding(rows, ["page_id"], "rank")


@query
def run_log_scan(spark, sf):
    """Daily logs built from the events, read back as source rows."""
    e = table(spark, sf, "events")
    per = e.groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("kept"))
    src = F.struct(F.col("event_type").alias("name"), (F.col("n") % 5 != 0).alias("success"), F.col("n").alias("events_found"),
                   F.col("kept").alias("events_after_filter"), (F.col("n") - F.col("kept")).alias("events_filtered"), F.lit(None).cast("string").alias("error"))
    docs = per.groupBy("d").agg(F.sort_array(F.collect_list(src)).alias("sources")).select(
        F.col("d").cast("string").alias("origin"), F.to_json(F.struct(F.concat(F.col("d").cast("string"), F.lit("T00:00:00")).alias("run_timestamp"), "sources")).alias("body"))
    log = runlog.log_sources(runlog.parse_documents(docs, runlog.LOG_SCHEMA))
    return log.select(F.col("run_ts").cast("date").alias("day"), "source_name", "source_rank", "success", "events_found", "events_after_filter", "events_filtered")


@query
def status_scan(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("event_type"), F.struct(F.when(F.col("n") % 5 == 0, "error").otherwise("ok").alias("status"), F.col("n").alias("count")))
    docs = per.groupBy("d").agg(F.map_from_entries(F.collect_list(entry)).alias("sources")).select(
        F.col("d").cast("string").alias("origin"), F.to_json(F.struct(F.col("d").cast("string").alias("last_run"), "sources")).alias("body"))
    return runlog.status_sources(runlog.parse_documents(docs, runlog.STATUS_SCHEMA))


# --- files, overrides, limits --------------------------------------------------------------------------------

@query
def intake_manifest(spark, sf):
    d = table(spark, sf, "pages")
    k = F.col("page_id")
    name = F.concat(F.lit("Pägé ("), F.floor(k / 3), F.lit(")"), _pick([".HTML", ".png", ".exe", "", ".mhtml"], k))
    files = d.select("page_id", name.alias("name"), F.when(k % 17 == 0, 0).otherwise(F.length("html") * 1000).cast("long").alias("length"), ((k * 7) % 100).alias("modified"))
    prior = d.select(F.concat(F.lit("Pägé "), F.floor(k / 3) * 2, F.lit(".png")).alias("file_name"))
    return intake.manifest(files, prior).select("file_name", "page_id", "name", "length", "modified", "updated")


@query
def manifest_merge(spark, sf):
    """Pages as files in three merges, the last one a repeat: a kept manifest whose rows are those of one merge of all, with what replaced an earlier file."""
    d = table(spark, sf, "pages")
    k = F.col("page_id")
    name = F.concat(F.lit("Pägé ("), F.floor(k / 3), F.lit(")"), _pick([".HTML", ".png", ".exe", "", ".mhtml"], k))
    files = d.select(name.alias("name"), F.when(k % 17 == 0, 0).otherwise(F.length("html") * 1000).cast("long").alias("length"), ((k * 7) % 100).alias("modified"), "page_id")
    store = ManifestStore(f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4()}", "name string, length long, modified long, page_id long")
    early = files.where(k % 2 == 0)
    for batch in (early, files, early):
        merge_files(batch, store)
    return read_manifest(spark, store).select("file_name", "page_id", "name", "length", "modified", "updated")


@query
def intake_rejections(spark, sf):
    d = table(spark, sf, "pages")
    k = F.col("page_id")
    name = _pick(["a.HTML", "(((.png", "b.exe", "c", ".htm", "é é.webp"], k)
    return d.select("page_id", intake.rejection(name, F.length("html") * (k % 4) * 3000).alias("reason"), text.safe_file_name(name).alias("safe"))


@query
def retention(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("modified"))
    return intake.retained(e, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("event_id")


@query
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return fallback.latest_per_key(e, "user_id", ["ts", "event_id"])


@query
def overrides_apply(spark, sf):
    """Deletes, edits and picks by identity key, all derived from the parts themselves."""
    d = part_listing(spark, sf, "p_brand", 8)
    keyed = overrides.with_identity(d)
    deletes = overrides.with_identity(d.where("source = 'Ticketmaster'")).select("key")
    edits = overrides.with_identity(d.where("time is null")).groupBy("key").agg(F.concat(F.lit("edit "), F.min("pos")).alias("artist")).select(
        "key", "artist", F.lit(None).cast("string").alias("venue"), F.lit("late").alias("time"), F.lit(None).cast("string").alias("url"))
    picks = overrides.with_identity(d.where("url is not null")).groupBy("key").agg(F.concat(F.lit("note "), F.max("pos")).alias("note"))
    out = overrides.mark_featured(overrides.apply_edits(overrides.drop_deleted(keyed, deletes), edits), picks)
    return out.select("pos", "key", "artist", "venue", "date", "time", "url", "featured", "featured_note")


@query
def soonest(spark, sf):
    """The first hundred by date, as the ticketing request asks for."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "event_type").orderBy("ts", "event_id").limit(100)
