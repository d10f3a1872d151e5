"""Row filters: music rules, date window, distance, required fields."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.functions.text import contains_any, let


def is_music(title: Column, category: Column | None = None, description: Column | None = None) -> Column:
    """Whether a listing reads as music.

    Keywords are plain substrings of ``title category description``, joined by single blanks even when a part is
    empty. An exclusion word without any inclusion word rejects; otherwise a category word, an inclusion word or
    a venue alias accepts.
    """
    category = F.lit("") if category is None else F.coalesce(category, F.lit(""))
    description = F.lit("") if description is None else F.coalesce(description, F.lit(""))
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), category, description))
    in_category = contains_any(F.lower(category), config.CATEGORY_KEYWORDS)

    def judge(t: Column) -> Column:
        at_venue = contains_any(t, [alias for _, alias, _ in config.venue_aliases()])
        return (contains_any(t, config.INCLUDE_KEYWORDS)
                | (~contains_any(t, config.EXCLUDE_KEYWORDS) & (in_category | at_venue)))

    return let(text, judge)


def in_window(day: Column, p: RunParams) -> Column:
    """Inclusive at both ends: the anchor day and the ``horizon_days`` after it."""
    return day.between(F.lit(p.anchor_date), F.lit(p.end_date))


def stamp_in_window(ts: Column, p: RunParams) -> Column:
    """The same window over a time stamp, as a plain range: a cast to date would keep it out of the file scan."""
    return (ts >= F.lit(p.anchor_date)) & (ts < F.lit(p.end_date + timedelta(days=1)))


def miles_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * 3958.7613) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def in_radius(lat: Column, lon: Column, miles: float = config.RADIUS_MILES) -> Column:
    """Within ``miles`` of the centre. A cheap box on plain columns comes first; it can reach the file scan."""
    d_lat = miles / 68.0
    d_lon = miles / 50.0
    box = (lat.between(config.CENTER_LAT - d_lat, config.CENTER_LAT + d_lat)
           & lon.between(config.CENTER_LON - d_lon, config.CENTER_LON + d_lon))
    return box & (miles_between(F.lit(config.CENTER_LAT), F.lit(config.CENTER_LON), lat, lon) <= miles)


def has_required(artist: Column, day: Column) -> Column:
    return F.coalesce((F.length(artist) > 0) & day.isNotNull(), F.lit(False))
