"""Venue calendars: one landed page per venue, all venues in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import schema
from marquee.functions.text import venue_source
from marquee.sources.profiles import SITE_PROFILES

FIRST_RANK = 3


def calendar_sources(spark) -> DataFrame:
    """Venues that have a page to read: (venue_key, page_venue, source_name, source_rank, kind).

    A profile name without its own layout falls to the generic one.
    """
    v = schema.venue_dim(spark).where(F.col("calendar_url").isNotNull() & (F.col("scraper") != "manual_only"))
    return v.select("venue_key", F.col("name").alias("page_venue"), venue_source(F.col("name")).alias("source_name"),
                    (F.col("venue_rank") + FIRST_RANK).alias("source_rank"),
                    F.when(F.col("scraper").isin(SITE_PROFILES), F.col("scraper")).otherwise("generic").alias("kind"), "calendar_url")


def venue_pages(pages: DataFrame) -> DataFrame:
    """Landed pages (venue_key, origin, html and, where landing failed, fetch_error) as input of ``pages.page_events``."""
    dim = F.broadcast(calendar_sources(pages.sparkSession).drop("calendar_url"))
    failed = ["fetch_error"] if "fetch_error" in pages.columns else []
    return pages.join(dim, "venue_key").select("kind", "html", "page_venue", "source_name", "source_rank", "origin",
                                               F.lit(0).alias("endpoint_rank"), *failed)


def tagged_pages(pages: DataFrame, kind: str, source_name: str, rank: int) -> DataFrame:
    """Pages of one non-venue source (origin, html and, for alternate addresses, endpoint_rank)."""
    endpoint = F.col("endpoint_rank") if "endpoint_rank" in pages.columns else F.lit(0)
    return pages.select(F.lit(kind).alias("kind"), "html", F.lit(None).cast("string").alias("page_venue"),
                        F.lit(source_name).alias("source_name"), F.lit(rank).alias("source_rank"), "origin",
                        endpoint.cast("int").alias("endpoint_rank"))
