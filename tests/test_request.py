"""Requests: dates prune folders, cells prune rows, and distance decides."""

import datetime
import math
import random

import pytest

from marquee.sources import api, request
from marquee.sources.request import Request


def miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * request.EARTH_MILES * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat,lon,far", [(35.1, -90.0, 30), (0, 179.9, 200), (-45, -179.99, 500), (89.5, 10, 100), (-90, 0, 10), (60, 0, 3000), (10, 10, 13000), (0, 0, 0)])
def test_ranges_hold_every_point_of_the_circle(spark, lat, lon, far):
    rng = random.Random(int(lat * 7 + far))
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(max(-90, min(90, lat + rng.gauss(0, far / 100 + 0.1))), (lon + rng.gauss(0, far / 60 + 0.1) + 180) % 360 - 180) for _ in range(300)]
    points += [(lat, lon), (90.0, 180.0), (-90.0, -180.0), (0.0, 180.0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lat double, lon double")
    df = df.withColumn("cell", request.cell(df["lat"], df["lon"]))
    got = {(r.lat, r.lon) for r in df.where(request.near(Request(None, None, lat, lon, far))).collect()}
    for a, b in points:
        d = miles(lat, lon, a, b)
        if abs(d - far) > 1e-6:
            assert ((a, b) in got) == (d < far), (a, b, d)


def payload(name, day, lat=None, lon=None, segment=None):
    place = f'"location":{{"latitude":"{lat}","longitude":"{lon}"}}' if lat is not None else '"city":"x"'
    kind = f',"classifications":[{{"segment":{{"name":"{segment}"}}}}]' if segment else ""
    start = f'"localDate":"{day}"' if day else ""
    return f'{{"name":"{name}","dates":{{"start":{{{start}}}}}{kind},"_embedded":{{"venues":[{{"name":"V",{place}}}]}}}}'


def test_landed_events_are_pruned(spark, tmp_path):
    given = [payload("in", "2026-02-16", 35.1, -90.0, "Music"), payload("far", "2026-02-16", 40.0, -90.0, "Music"), payload("late", "2026-03-16", 35.1, -90.0, "Music"),
             payload("sport", "2026-02-16", 35.1, -90.0, "Sports"), payload("unknown", "2026-02-17"), payload("undated", None, 35.1, -90.0, "MUSIC"), payload("odd", "2026-02-17", "north", "1", "music"),
             payload("off", "2026-02-17", 95, 0, "music")]
    df = spark.createDataFrame([("a.json", '{"_embedded":{"events":[' + ",".join(given) + "]}}"), ("b.json", "{cut"), ("c.json", None)], "origin string, body string")
    events = api.ticketing_events(df)
    path = str(tmp_path / "events")
    request.land(events, path)
    request.land(events.limit(0), path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields if f.name != "event_date")
    landed = request.read_landed(spark, path, schema)
    r = Request(datetime.date(2026, 2, 15), datetime.date(2026, 2, 22))
    rows = api.stage_ticketing_events(landed, r)
    want = {"in", "unknown", "undated", "odd", "off"}
    assert {x.artist for x in rows.collect()} == want == {x.artist for x in api.stage_ticketing_events(events, r).collect()}
    assert {x.artist: (x.kept, x.filtered) for x in rows.collect()}["undated"] == (False, True)  # as the adapter counts it
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    scan = scan[: scan.index("ReadSchema")]
    assert "event_date" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "cell" in scan[scan.index("PushedFilters"):]  # row groups outside the circle's cells are not read
    away = api.stage_ticketing_events(landed, Request(r.start, r.end, 40.0, -90.0, 5, None))
    assert {x.artist for x in away.collect()} == {"far", "unknown", "odd", "off"}
    assert {x.artist for x in api.stage_ticketing(df).collect()} == {"in", "far", "late", "sport", "unknown", "undated", "odd", "off"}
