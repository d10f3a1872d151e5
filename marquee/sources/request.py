"""What a run asks of an event API: dates, a category, and a circle on the map; and events landed so that the answer is read without the rest.

Landed events are partitioned by their date and sorted by the cell of a fixed grid of coordinates. A request becomes a range of dates, which prunes partitions,
and one range of cells for each band of latitude that the circle touches, which prunes row groups; the great-circle distance is worked out only
for what is left. Events that lack a date, coordinates or a category are the API's own choice and stay in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.operators.rules import miles_between

#: Cells of a quarter of a degree; ``NOWHERE`` is that of events without coordinates.
STEP = 4
ROW = 360 * STEP
NOWHERE = -1
MANY_BANDS = 32
EARTH_MILES = 3958.7613


@dataclass(frozen=True)
class Request:
    start: date
    end: date
    lat: float = config.CENTER_LAT
    lon: float = config.CENTER_LON
    miles: float = config.RADIUS_MILES
    category: str | None = "music"

    @classmethod
    def of(cls, p: RunParams) -> Request:
        return cls(p.anchor_date, p.end_date)


def cell(lat: Column, lon: Column) -> Column:
    """Number of the grid cell, band by band from the south pole; coordinates that are none are ``NOWHERE``."""
    good = lat.between(-90, 90) & lon.between(-180, 180)
    band = F.least(F.floor((lat + 90) * STEP), F.lit(180 * STEP - 1))
    return F.when(F.coalesce(good, F.lit(False)), band * ROW + F.floor((lon + 180) * STEP) % ROW).otherwise(NOWHERE).cast("int")


def cell_ranges(lat: float, lon: float, miles: float) -> list[tuple[int, int]]:
    """Ranges of cells that hold every point within ``miles``: one or, across the date line, two for each band; a single one of many bands."""
    angle = miles / EARTH_MILES
    up = math.degrees(angle) + 1e-6
    south, north = max(-90.0, lat - up), min(90.0, lat + up)
    over_pole = lat - up <= -90 or lat + up >= 90 or angle >= math.pi / 2
    wide = 180.0 if over_pole else math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-6
    bands = range(min(180 * STEP - 1, math.floor((south + 90) * STEP)), min(180 * STEP - 1, math.floor((north + 90) * STEP)) + 1)
    if wide >= 180 - 1 / STEP:
        return [(bands[0] * ROW, bands[-1] * ROW + ROW - 1)]
    west, east = (math.floor((x + 180) * STEP) % ROW for x in (lon - wide, lon + wide))
    spans = [(west, east)] if west <= east else [(0, east), (west, ROW - 1)]
    return [(b * ROW + x, b * ROW + y) for b in bands for x, y in spans] if len(bands) <= MANY_BANDS else [(bands[0] * ROW, bands[-1] * ROW + ROW - 1)]


def near(r: Request) -> Column:
    """Over columns cell, lat, lon (a null one where the cell is ``NOWHERE``): cells first, then the distance of what lies in them."""
    inside = reduce(lambda a, b: a | b, [F.col("cell").between(x, y) for x, y in cell_ranges(r.lat, r.lon, r.miles)])
    # missing coordinates are taken as the centre, not as a second alternative, which the planner would merge with the first into one that the scan cannot use
    lat, lon = F.coalesce("lat", F.lit(r.lat)), F.coalesce("lon", F.lit(r.lon))
    return ((F.col("cell") == NOWHERE) | inside) & (miles_between(F.lit(r.lat), F.lit(r.lon), lat, lon) <= r.miles)


def asked(events: DataFrame, r: Request) -> DataFrame:
    """The events that answer a request; ``events`` has event_date, category, lat, lon and cell."""
    dated = F.col("event_date").isNull() | F.col("event_date").between(F.lit(r.start), F.lit(r.end))
    kind = F.lit(True) if r.category is None else F.col("category").isNull() | (F.lower("category") == r.category.lower())
    return events.where(dated).where(kind).where(near(r))


def land(events: DataFrame, path: str) -> None:
    """Append events: a folder for each date, in it files that are sorted by cell."""
    (events.repartition("event_date", F.shiftright(F.col("cell"), 9)).sortWithinPartitions("event_date", "cell")
     .write.mode("append").partitionBy("event_date").parquet(path))


def read_landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed events; ``schema`` is that of the events without event_date."""
    return spark.read.schema(f"{schema}, event_date date").parquet(path)
