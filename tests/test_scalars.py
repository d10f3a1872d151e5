"""Edge cases of the scalar expressions."""

import datetime

from pyspark.sql import functions as F

from marquee.functions import dates, text
from marquee.operators import audit, rules, venues

D = datetime.date


def test_loose_dates(column):
    feb12 = D(2026, 2, 12)
    cases = {
        "Feb 12, 2026": feb12, "february 12, 2026": feb12, "2/12/26": feb12, "2-12-2026": feb12, "2.12.26": feb12,
        "2026-2-12": feb12, "Feb 12": feb12, "2/12": feb12, "2.12": feb12, "Feb  12": feb12, "Wed Feb 12": feb12,
        "Friday, February 13th, 2026": D(2026, 2, 13), "2/15/99": D(2026, 2, 15), "Feb 2026": D(2026, 2, 20),
        "02/29": None, "Feb 29": None, "2/29/96": None, "Doors 7 Feb 12": None, "Sept 5": None, "tonight": None, "": None,
        "1/3": D(2026, 1, 3), "2-12": None, "2/12-26": None, "Feb 12": feb12, "2/30/2026": None, "13/1/2026": None,
        "Feb 12 2027": D(2027, 2, 12), "12/31/68": D(2068, 12, 31), "May 5": D(2026, 5, 5),
    }
    assert column(list(cases), lambda x: dates.parse_date_text(x, 2026)) == list(cases.values())


def test_leap_window_year(column):
    assert column(["Feb 29", "02/29", "2/29/96"], lambda x: dates.parse_date_text(x, 2028)) == [D(2028, 2, 29), None, D(2028, 2, 29)]


def test_sheet_dates_have_no_dots_and_no_search(column):
    got = column(["2/16/2026", "2.16.2026", "Wed Feb 16", "Feb 16", "2-16-26"], lambda x: dates.parse_sheet_date(x, 2026))
    assert got == [D(2026, 2, 16), None, None, D(2026, 2, 16), D(2026, 2, 16)]


def test_iso(column):
    values = ["2026-02-15T19:30:00-06:00", "2026-02-15", "20260215T0700", "2026-02-30", "2026-02-15 19:00", "2026-02-15T25:00", "x"]
    assert column(values, dates.iso_date) == [D(2026, 2, 15)] * 3 + [None, D(2026, 2, 15), None, None]
    assert column(values[:3], dates.iso_clock) == ["7:30 PM", "12 AM", "7 AM"]
    assert column(["2026-2-5", "2026-02-15T", "x"], dates.strict_day) == [D(2026, 2, 5), None, None]


def test_clock_and_headings(column):
    assert column(["19:00:00", "19:30:00", "00:00:00", "12:05:00", "25:00:00", "7 PM"], dates.clock_text) == [
        "7 PM", "7:30 PM", "12 AM", "12:05 PM", None, None]
    assert column(["2026-02-15"], lambda x: dates.day_heading(x.cast("date"))) == ["SUNDAY, FEBRUARY 15"]
    stamps = column(["2026-02-15 05:58:42", "2026-07-15 05:58:42"], lambda x: dates.local_stamp(x.cast("timestamp_ntz")))
    assert stamps == ["February 14, 2026 at 11:58 PM CST", "July 15, 2026 at 12:58 AM CDT"]
    assert column(["2026-02-15 05:58:42"], lambda x: dates.build_stamp(x.cast("timestamp_ntz"))) == ["February 15, 2026 at 5:58 AM CT"]
    assert column(["Feb 11 - 6:00 PM", "Feb 11", "Feb 11 - 6 - 7"], lambda x: dates.split_day_and_time(x)[1]) == ["6:00 PM", None, "6 - 7"]


def test_normal_forms(column):
    values = ["The Movement", "Movement Live", "Live Show", "Show!", "Olive", "B.B. King's", "!!!", "Café  Tacuba ft."]
    assert column(values, text.match_norm) == ["movement", "movement", "live", "show", "o", "bb kings", "", "café tacuba"]
    assert column(["The Movement Live", "The"], text.identity_norm) == ["movement live", "the"]
    assert column(["a b a", ""], text.words) == [["a", "b"], []]


def test_addresses_names_and_markup(column):
    assert column(["http://a?x=1", "/b", "", None], lambda x: text.absolute_url(x, "http://h")) == ["http://a?x=1", "http://h/b", None, None]
    assert column(["http://a", "/b"], lambda x: text.absolute_url(x, None)) == ["http://a", None]
    assert column(["a b(1).PNG", "((", "é.htm"], text.safe_file_name) == ["a b1.PNG", None, "é.htm"]
    assert column(["a.b.PNG", "noext", ".htm"], text.suffix) == [".png", "", ""]
    assert column([' <b> A </b> &amp; <i>Y&#8217;all</i> &#x41; <!-- x -->'], text.element_text) == ["A&Y’allA"]
    assert column(['<a&"b">'], text.html_escape) == ["&lt;a&amp;&quot;b&quot;&gt;"]


def test_venues(column):
    values = ["the hi-tone", "Hi Tone Cafe (small room)", "bar", "hall", "  ", "Lamplighter Lounge "]
    assert column(values, venues.canonical_venue) == ["Hi Tone", "Hi Tone", "Bar DKDC", "Minglewood Hall", "Hi Tone", "Lamplighter Lounge"]
    assert column(["", "gpac"], venues.venue_or_tba) == ["Venue TBA", "Germantown Performing Arts Center"]


def test_rules(column):
    values = ["Trivia Night", "Jazz Trivia Night", "Open Mic Comedy", "Coldplay", "Coldplay Tour", "Paul Thorn"]
    assert column(values, lambda x: rules.is_music(x, F.lit("music"))) == [False, True, True, False, True, True]
    assert column(["Paul Thorn", "Night at Minglewood", "mc"], rules.is_music) == [False, True, True]


def test_summary_and_status(column):
    assert column(["47"], lambda x: audit.summary_line(x.cast("long"), F.lit(6), F.lit(5))) == ["47 events from 6 sources (5 had errors)"]
    assert column(["1"], lambda x: audit.summary_line(x.cast("long"), F.lit(1), F.lit(0))) == ["1 events from 1 source"]
    assert column(["x https://a/b HTTPSConnectionPool(host)"], audit.public_error) == ["x [url] connection failed"]
