"""Event API payloads: one JSON document per row of text, exploded to listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.functions import dates, text
from marquee.operators import quarantine
from marquee.operators.rules import is_music
from marquee.operators.venues import canonical_venue
from marquee.sources import request
from marquee.sources.request import Request

TICKETING_SCHEMA = """struct<_embedded: struct<events: array<struct<name: string, url: string,
 dates: struct<start: struct<localDate: string, localTime: string>>,
 classifications: array<struct<segment: struct<name: string>>>,
 _embedded: struct<venues: array<struct<name: string, location: struct<latitude: string, longitude: string>>>>>>>>"""

SECOND_SCHEMA = """struct<events: array<struct<name: struct<text: string>, start: struct<local: string>, url: string,
 category: struct<name: string>, description: struct<text: string>,
 venue: struct<name: string, address: struct<localized_address_display: string>>>>>"""


def read_payloads(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Landed payloads as (origin, body). Large landings should hold one payload per line, which can be split."""
    raw = spark.read.text(path, wholetext=not one_per_line)
    return raw.select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("body"))


def _items(payloads: DataFrame, schema: str, path: str) -> DataFrame:
    doc = F.from_json("body", schema).alias("doc")
    return payloads.select("origin", doc).select("origin", F.posexplode(f"doc.{path}").alias("pos", "e"))


def _finish(rows: DataFrame, source: str, rank: int) -> DataFrame:
    return rows.select(
        "artist", "venue", "date", "time", F.lit(source).alias("source"), "url", F.lit(source).alias("source_name"),
        F.lit(rank).alias("source_rank"), "origin", F.col("pos").cast("long").alias("pos"),
        F.lit(True).alias("found"), "kept", "filtered")


def ticketing_events(payloads: DataFrame) -> DataFrame:
    """Events of ticketing payloads with what a request asks for: (origin, pos, e, category, lat, lon, cell, event_date)."""
    e = _items(payloads, TICKETING_SCHEMA, "_embedded.events")
    place = F.get(F.col("e._embedded.venues"), F.lit(0))["location"]
    e = e.select("*", F.get(F.col("e.classifications"), F.lit(0))["segment"]["name"].alias("category"),
                 place["latitude"].try_cast("double").alias("lat"),
                 place["longitude"].try_cast("double").alias("lon"))
    e = e.withColumn("cell", request.cell(F.col("lat"), F.col("lon")))
    lat, lon = (F.when(F.col("cell") != request.NOWHERE, F.col(x)).alias(x) for x in ("lat", "lon"))
    return e.select("origin", "pos", "e", "category", lat, lon, "cell", dates.strict_day(F.col("e.dates.start.localDate")).alias("event_date"))


def stage_ticketing_events(events: DataFrame, r: Request, rank: int = 0) -> DataFrame:
    """Listings of landed ticketing events (``ticketing_events``) that answer a request."""
    return _ticketing(request.asked(events, r).select("origin", "pos", "e"), rank)


def stage_ticketing(payloads: DataFrame, rank: int = 0) -> DataFrame:
    """Listings of the ticketing API. The date window is part of the request, so it is not applied again.

    A row without name or date, or one the music rules reject, counts as filtered; a date that does not parse
    drops the row without counting it.
    """
    return _ticketing(_items(payloads, TICKETING_SCHEMA, "_embedded.events"), rank)


def _ticketing(e: DataFrame, rank: int) -> DataFrame:
    start = F.col("e.dates.start")
    venues = F.col("e._embedded.venues")
    venue = F.when(F.size(venues) > 0, F.coalesce(F.get(venues, F.lit(0))["name"], F.lit(config.UNKNOWN_VENUE)))
    rows = e.select(
        "origin", "pos", text.squeeze_ends(F.col("e.name")).alias("artist"),
        canonical_venue(F.coalesce(venue, F.lit(config.UNKNOWN_VENUE))).alias("venue"),
        start["localDate"].alias("raw_date"), dates.strict_day(start["localDate"]).alias("date"),
        dates.clock_text(start["localTime"]).alias("time"), F.col("e.url").alias("url"))
    missing = (F.coalesce(F.length("artist"), F.lit(0)) == 0) | (F.coalesce(F.length("raw_date"), F.lit(0)) == 0)
    parsed = ~missing & F.col("date").isNotNull()
    rows = rows.withColumn("music", is_music(F.col("artist"), F.lit("music")))
    return _finish(rows.select("*", (parsed & F.col("music")).alias("kept"),
                               (missing | (parsed & ~F.col("music"))).alias("filtered")), config.TICKETING_API, rank)


def stage_second(payloads: DataFrame, rank: int) -> DataFrame:
    """Listings of the second API; rules look at title, category and the first 200 characters of the description.

    Rows that do not parse are not counted as filtered here.
    """
    e = _items(payloads, SECOND_SCHEMA, "events")
    local = F.col("e.start.local")
    address = F.coalesce(F.col("e.venue.address.localized_address_display"), F.lit(config.CITY_DEFAULT))
    rows = e.select(
        "origin", "pos", text.squeeze_ends(F.col("e.name.text")).alias("artist"),
        canonical_venue(F.coalesce(text.blank_to_null(F.col("e.venue.name")), address)).alias("venue"),
        dates.iso_date(local).alias("date"), dates.iso_clock(local).alias("time"), F.col("e.url").alias("url"),
        F.col("e.category.name").alias("category"), F.substring("e.description.text", 1, 200).alias("summary"))
    parsed = F.coalesce(F.length("artist") > 0, F.lit(False)) & F.col("date").isNotNull()
    rows = rows.withColumn("music", is_music(F.col("artist"), F.col("category"), F.col("summary")))
    return _finish(rows.select("*", (parsed & F.col("music")).alias("kept"),
                               (parsed & ~F.col("music")).alias("filtered")), config.SECOND_API, rank)


def _bad(payloads: DataFrame, schema: str, path: str, name: str, day: str, parse, source: str, rank: int) -> DataFrame:  # noqa: ANN001
    """Payloads that are no JSON, and events without a name or a date; one scan."""
    rows = payloads.select("origin", "body", F.try_parse_json("body").isNull().alias("broken"), F.from_json("body", schema).alias("doc"))
    rows = rows.select("origin", "broken", F.when(F.col("broken"), F.col("body")).alias("body"), F.posexplode_outer(f"doc.{path}").alias("pos", "e"))
    reason = F.when(F.col("broken"), quarantine.NOT_JSON).when(F.col("pos").isNotNull(), quarantine.missing(text.squeeze_ends(F.col(name)), F.col(day), parse(F.col(day))))
    rows = rows.withColumn("pos", F.when(~F.col("broken"), F.col("pos")))
    return quarantine.bad_rows(rows, reason, F.coalesce(F.col("body"), F.to_json("e")), F.lit(source), F.lit(rank))


def bad_ticketing(payloads: DataFrame, rank: int = 0) -> DataFrame:
    """What ``stage_ticketing`` cannot use."""
    return _bad(payloads, TICKETING_SCHEMA, "_embedded.events", "e.name", "e.dates.start.localDate", dates.strict_day, config.TICKETING_API, rank)


def bad_second(payloads: DataFrame, rank: int) -> DataFrame:
    """What ``stage_second`` cannot use."""
    return _bad(payloads, SECOND_SCHEMA, "events", "e.name.text", "e.start.local", dates.iso_date, config.SECOND_API, rank)
