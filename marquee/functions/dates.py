"""Date and time expressions over loosely written text.

Accepted layouts fall into three shapes, so each text is matched against three patterns instead of one per
layout; each shape is rewritten to ``year-month-day`` by one replacement and parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import config
from marquee.functions.text import folded, let, squeeze

_DAY = r"(3[01]|[12]\d|0?[1-9])"
_MON = r"(1[0-2]|0?[1-9])"
NUMERIC = rf"^{_MON}([/.-]){_DAY}(?:([/.-])(\d{{4}}|\d{{2}}))?$"
ISO_DAY = rf"^(\d{{4}})-{_MON}-{_DAY}$"
NAMED = rf"^([a-z]+) {_DAY}(?:, (\d{{4}}))?$"
# first "word number [year]" anywhere in the text
LOOSE = r"([\p{L}\p{N}_]{3,9}) (\d{1,2})(?:,? (\d{4}))?"
ISO_STAMP = (r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
             r"(?:.([01]\d|2[0-3])(?::?([0-5]\d)(?::?[0-5]\d(?:[.,]\d+)?)?)?"
             r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?$")


def _month_number(word: Column) -> Column:
    """1..12 for a lower-case English month, full or cut to three letters; null for anything else."""
    table = {}
    for i, name in enumerate(config.MONTHS, 1):
        table[name.lower()] = table[name[:3].lower()] = str(i)
    return F.try_element_at(folded(table, "map<string,string>"), word)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")


def _resolve(parts: Column, year: int, dotted: bool) -> Column:
    """Date of ``[year, month, day, shape]`` texts, where the year may be empty or have two or four digits.

    A year before 2000, two digits from 69 on, or no year at all means the window's own year. The day must then
    exist in both years; without a year 29 February is never accepted. ``shape`` is the separators of a numeric
    date, or ``w`` for a named month. Separators must agree; a yearless date may use "/" and, where allowed, ".".
    """
    written, month, day, shape = (F.get(parts, F.lit(i)) for i in range(4))
    shapes = ["w", "/", "//", "--"] + ([".", ".."] if dotted else [])
    full = (F.when(written == "", "1900").when(F.length(written) == 4, written)
            .when(written >= "69", F.concat(F.lit("19"), written)).otherwise(F.concat(F.lit("20"), written)))
    number = F.when(shape == "w", _month_number(month)).otherwise(month)
    bound = F.struct(full.alias("y"), number.alias("m"), day.alias("d"), shape.isin(shapes).alias("ok"))

    def pick(b: Column) -> Column:
        own = _day(b["y"], b["m"], b["d"])
        return (F.when(~b["ok"] | b["m"].isNull(), None).when(b["y"] >= "2000", own)
                .when(own.isNotNull(), _day(F.lit(str(year)), b["m"], b["d"])))

    return let(bound, pick)


def _shapes(text: Column, year: int, dotted: bool) -> Column:
    """Date of a text (lower case, single blanks) that is a date in one of the layouts and nothing else."""
    canon = (F.when(F.rlike(text, F.lit(NUMERIC)), F.regexp_replace(text, NUMERIC, "$5|$1|$3|$2$4"))
             .when(F.rlike(text, F.lit(ISO_DAY)), F.regexp_replace(text, ISO_DAY, "$1|$2|$3|--"))
             .when(F.rlike(text, F.lit(NAMED)), F.regexp_replace(text, NAMED, "$3|$1|$2|w")))
    return let(F.split(canon, r"\|"), lambda parts: _resolve(parts, year, dotted))


def _loose(text: Column, year: int) -> Column:
    """Date of the first "word number [year]" in the text; the written year counts as it stands."""
    hit = F.regexp_replace(F.regexp_extract(text, LOOSE, 0), rf"^{LOOSE}$", "$3|$1|$2")

    def pick(parts: Column) -> Column:
        written = F.get(parts, F.lit(0))
        month = _month_number(F.get(parts, F.lit(1)))
        day = _day(F.when(written == "", F.lit(str(year))).otherwise(written), month,
                   F.regexp_extract(F.get(parts, F.lit(2)), rf"^{_DAY}$", 1))
        return F.when(month.isNotNull(), day)

    return let(F.split(hit, r"\|"), pick)


def parse_date_text(x: Column, year: int) -> Column:
    """Date of a loosely written text, else of the first "month day [year]" inside it, else null."""
    return let(F.lower(squeeze(x)), lambda t: F.coalesce(_shapes(t, year, dotted=True), _loose(t, year)))


def parse_sheet_date(x: Column, year: int) -> Column:
    """The spreadsheet's list of layouts: no dotted dates, nothing searched inside longer text."""
    return let(F.lower(squeeze(x)), lambda t: _shapes(t, year, dotted=False))


def iso_date(x: Column) -> Column:
    """Calendar date of an ISO text as written, whatever its offset; null when it is not ISO."""
    return let(x, lambda t: F.when(F.rlike(t, F.lit(ISO_STAMP)), F.try_to_date(
        F.regexp_replace(t, ISO_STAMP, "$1-$2$4-$3$5"), "yyyy-MM-dd")))


def iso_clock(x: Column) -> Column:
    """Display time of an ISO text as written; a bare date reads as midnight."""
    return clock(F.regexp_extract(x, ISO_STAMP, 6), F.regexp_extract(x, ISO_STAMP, 7))


def strict_day(x: Column) -> Column:
    """``yyyy-m-d`` and nothing else."""
    return let(x, lambda t: F.when(F.rlike(t, F.lit(ISO_DAY)), F.try_to_date(t, "yyyy-M-d")))


def clock(hour: Column, minute: Column) -> Column:
    """``7 PM`` / ``7:30 PM`` from 24-hour parts given as text; empty parts are zero."""
    def show(t: Column) -> Column:
        h, m = t["h"], t["m"]
        twelve = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
        mins = F.when(m == 0, F.lit("")).otherwise(F.concat(F.lit(":"), F.lpad(m.cast("string"), 2, "0")))
        return F.concat(twelve.cast("string"), mins, F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))

    return let(F.struct(F.coalesce(hour.try_cast("int"), F.lit(0)).alias("h"),
                        F.coalesce(minute.try_cast("int"), F.lit(0)).alias("m")), show)


def clock_text(x: Column) -> Column:
    """Display time of ``HH:mm:ss`` text, null when it is anything else."""
    pattern = r"^(2[0-3]|[01]?\d):([0-5]?\d):(6[01]|[0-5]?\d)$"
    return F.when(F.rlike(x, F.lit(pattern)), clock(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)))


def clock_of(ts: Column) -> Column:
    """Display time of a timestamp."""
    return F.replace(F.date_format(ts, "h:mm a"), F.lit(":00 "), F.lit(" "))


def day_heading(d: Column) -> Column:
    return F.upper(F.date_format(d, "EEEE, MMMM d"))


def build_stamp(ts: Column) -> Column:
    """The plain build stamp: labelled CT but not converted."""
    return F.concat(F.date_format(ts, "MMMM d, yyyy"), F.lit(" at "), F.date_format(ts, "h:mm a"), F.lit(" CT"))


def local_stamp(ts: Column, zone: str = config.LOCAL_ZONE) -> Column:
    """A naive UTC stamp shown in ``zone`` with the abbreviation in force on that day (CST or CDT)."""
    utc = ts.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    abbr = F.when(F.timestamp_diff("HOUR", local, utc) == 5, F.lit("CDT")).otherwise(F.lit("CST"))
    return F.concat(F.date_format(local, "MMMM d, yyyy"), F.lit(" at "), F.date_format(local, "h:mm a"), F.lit(" "), abbr)


def split_day_and_time(x: Column) -> tuple[Column, Column]:
    """``Feb 11 - 6:00 PM`` into its date text and, after the first `` - ``, its time text (else null)."""
    text = squeeze(x)
    parts = F.split(text, " - ", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
