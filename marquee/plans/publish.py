"""Marts and sinks of a run.

Nothing here gathers a day or a run in one row. Documents are written as lines in global order (headings and
listings sorted together), so the part files read one after the other are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import RunParams
from marquee.functions.dates import build_stamp, day_heading, local_stamp
from marquee.functions.text import display_line, html_escape, page_line

EMPTY_PAGE = '<p class="no-events">No events found for the upcoming week.</p>'


def by_day(deduped: DataFrame) -> DataFrame:
    """One row per day: heading and number of listings."""
    return deduped.groupBy("date").agg(F.count("*").alias("n")).select("date", day_heading(F.col("date")).alias("heading"), "n")


def _ordered(parts: DataFrame) -> DataFrame:
    return parts.orderBy("date", "kind", "v", "a", "slot").select("line")


def _listing_rows(deduped: DataFrame, line: Column) -> DataFrame:
    return deduped.select("date", F.lit(1).alias("kind"), F.lower("venue").alias("v"), F.lower("artist").alias("a"),
                          F.col("slot").cast("long").alias("slot"), line.alias("line"))


def _day_rows(deduped: DataFrame, kind: int, line: Column) -> DataFrame:
    return deduped.select("date").distinct().select(
        "date", F.lit(kind).alias("kind"), F.lit("").alias("v"), F.lit("").alias("a"),
        F.lit(0).cast("long").alias("slot"), line.alias("line"))


def _body_lines(deduped: DataFrame) -> DataFrame:
    """Lines of the days of the page with their place; the no-events line when there are none."""
    day = F.col("date")
    open_ = F.concat(F.lit('<div class="day-section"><h2>'), day_heading(day), F.lit("</h2><ul>"))
    item = page_line(F.col("artist"), F.col("venue"), F.col("time"), F.col("url"))
    lines = (_day_rows(deduped, 0, open_).unionByName(_listing_rows(deduped, item))
             .unionByName(_day_rows(deduped, 2, F.lit("</ul></div>"))))
    none = (deduped.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(None).cast("date").alias("date"), F.lit(0).alias("kind"), F.lit("").alias("v"), F.lit("").alias("a"),
        F.lit(0).cast("long").alias("slot"), F.lit(EMPTY_PAGE).alias("line")))
    return lines.unionByName(none)


def page_body(deduped: DataFrame) -> DataFrame:
    """Lines of the published page body, in order."""
    return _ordered(_body_lines(deduped))


def shows_line(total: Column, days: int) -> Column:
    """The header's count of listings."""
    return F.concat(total.cast("string"), F.lit(" show"), F.when(total == 1, "").otherwise("s"), F.lit(f" over the next {days} days"))


def page(p: RunParams, totals: DataFrame, health: DataFrame, deduped: DataFrame, name: str, credit: str = "") -> DataFrame:
    """Lines of the whole published page, in order: title and counts, the days, then the sources and the stamp.

    ``totals`` is the row of ``audit.run_totals``, ``health`` the rows of ``audit.source_health``; ``name`` and ``credit`` are plain texts. Head and foot
    are lines of one row of totals and of the source dimension, sorted together with the listings; nothing is gathered.
    """
    days = p.horizon_days + 1
    stamp = local_stamp(F.lit(p.run_ts).cast("timestamp_ntz"))
    fixed = [(0, '<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8">'),
             (0, F.concat(F.lit("<title>"), html_escape(F.lit(name)), F.lit(f" — Next {days} Days</title></head><body><header>"))),
             (0, F.concat(F.lit("<h1>"), html_escape(F.lit(name.upper())), F.lit("</h1>"))),
             (0, F.concat(F.lit('<div class="updated">Updated '), stamp, F.lit("</div>"))),
             (0, F.concat(F.lit('<div class="summary">'), shows_line(F.col("total_deduped_events"), days), F.lit("</div></header><main>"))),
             (2, F.concat(F.lit('</main><footer><div class="source-summary">'), F.col("summary"), F.lit("</div>"))),
             (2, '<details class="source-status"><summary>Source Details</summary><table class="source-table">'),
             (2, '<thead><tr><th></th><th>Source</th><th class="src-count">Events</th></tr></thead><tbody>'),
             (4, "</tbody></table></details>"),
             (4, F.concat(html_escape(F.lit(credit)), F.lit("<br>Last built "), stamp)),
             (4, "</footer></body></html>")]
    edge = totals.select(F.explode(F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(i).cast("long").alias("at"), (F.lit(x) if isinstance(x, str) else x).alias("line")) for i, (part, x) in enumerate(fixed)])).alias("e")).select("e.*")
    source = F.concat(F.lit('<tr class="'), F.col("css_class"), F.lit('"><td class="src-dot">&#x25CF;</td><td>'), F.col("source_name"), F.lit('</td><td class="src-count">'), F.col("shown_count"), F.lit("</td></tr>"))
    sources = health.select(F.lit(3).alias("part"), F.col("source_rank").cast("long").alias("at"), source.alias("line"))
    body = _body_lines(deduped).withColumn("part", F.lit(1)).withColumn("at", F.lit(0).cast("long"))
    lines = body.unionByName(edge.unionByName(sources), allowMissingColumns=True)
    return lines.orderBy("part", "at", "date", "kind", "v", "a", "slot").select("line")


def text_summary(deduped: DataFrame) -> DataFrame:
    """The plain text summary: a heading per day, then its listings."""
    head = F.concat(F.lit("━━━ "), day_heading(F.col("date")), F.lit(" ━━━"))
    item = F.concat(F.lit("  "), display_line(F.col("artist"), F.col("venue"), F.col("time")))
    return _ordered(_day_rows(deduped, 0, head).unionByName(_listing_rows(deduped, item)))


def _json_lines(head: DataFrame, rows: DataFrame, order: list[str], tail: str) -> DataFrame:
    """Lines that form one JSON document: ``head``, the elements in ``order``, ``tail``.

    The first element is the one without a leading comma; its sort key is a one-row aggregate.
    """
    keyed = rows.withColumn("k", F.struct(*order))
    first = keyed.agg(F.min("k").alias("first_k"))
    items = (keyed.join(F.broadcast(first)).select(
        F.lit(1).alias("part"), "k", F.concat(F.when(F.col("k") == F.col("first_k"), "").otherwise(","), F.col("line")).alias("line")))
    none = F.lit(None).cast(items.schema["k"].dataType)
    tops = head.select(F.lit(0).alias("part"), none.alias("k"), "line")
    ends = head.select(F.lit(2).alias("part"), none.alias("k"), F.lit(tail).alias("line"))
    return tops.unionByName(items).unionByName(ends).orderBy("part", "k").select("line")


def run_log(p: RunParams, totals: DataFrame, audit: DataFrame, deduped: DataFrame) -> DataFrame:
    """The nested run log as ordered lines of one JSON document; listings come without their url.

    The per-source array has one element per source of the dimension and is built in one row; the listings, which
    grow with the data, are one line each.
    """
    src = F.struct(F.col("source_name").alias("name"), "success", "events_found", "events_after_filter", "events_filtered", "error")
    sources = audit.agg(F.transform(F.sort_array(F.collect_list(F.struct("source_rank", src.alias("s")))),
                                    lambda x: x["s"]).alias("sources"))
    keep_nulls = {"ignoreNullFields": "false"}
    head_json = F.to_json(F.struct(
        F.lit(p.run_ts.replace(" ", "T")).alias("run_timestamp"),
        F.struct(F.lit(str(p.anchor_date)).alias("start"), F.lit(str(p.end_date)).alias("end")).alias("date_range"),
        "total_raw_events", "total_deduped_events", "sources"), keep_nulls)
    head = (totals.join(F.broadcast(sources)).select(head_json.alias("h"))
            .select(F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"events":[')).alias("line")))
    item = F.to_json(F.struct("artist", "venue", F.date_format("date", "yyyy-MM-dd").alias("date"), "time", "source"), keep_nulls)
    rows = deduped.select("date", F.lower("venue").alias("v"), F.lower("artist").alias("a"),
                          F.col("slot").cast("long").alias("slot"), item.alias("line"))
    return _json_lines(head, rows, ["date", "v", "a", "slot"], "]}")


def json_feed(p: RunParams, deduped: DataFrame) -> DataFrame:
    """Public feed as ordered lines of one JSON document."""
    spark = deduped.sparkSession
    have = deduped.columns
    featured = F.col("featured") if "featured" in have else F.lit(False)
    head = spark.range(1).select(F.concat(F.lit('{"updated":"' + p.run_ts.replace(" ", "T") + 'Z","date_range":{"start":"'
                                                + str(p.anchor_date) + '","end":"' + str(p.end_date) + '"},"events":[')).alias("line"))
    item = F.to_json(F.struct("artist", "venue", F.date_format("date", "yyyy-MM-dd").alias("date"), "time", "url",
                              featured.alias("featured")), {"ignoreNullFields": "false"})
    rows = deduped.select("date", F.lower("venue").alias("v"), F.lower("artist").alias("a"),
                          F.col("slot").cast("long").alias("slot"), item.alias("line"))
    return _json_lines(head, rows, ["date", "v", "a", "slot"], "]}")


def rss_item(artist: Column, venue: Column, day: Column, time: Column, url: Column) -> Column:
    """One feed item: title, date and venue as description, link when there is one."""
    return F.concat(
        F.lit("<item><title>"), html_escape(display_line(artist, venue, time)), F.lit("</title><description>"),
        html_escape(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), venue)), F.lit("</description>"),
        F.when(F.length(url) > 0, F.concat(F.lit("<link>"), html_escape(url), F.lit("</link>"))).otherwise(F.lit("")),
        F.lit("</item>"))


def rss_feed(deduped: DataFrame, title: str, link: str) -> DataFrame:
    """RSS 2.0 document as ordered lines."""
    spark = deduped.sparkSession
    item = rss_item(F.col("artist"), F.col("venue"), F.col("date"), F.col("time"), F.col("url"))
    body = _listing_rows(deduped, item).withColumn("part", F.lit(1))
    esc = [html_escape(F.lit(title)), html_escape(F.lit(link))]
    edge = spark.range(1).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'),
                                                      esc[0], F.lit("</title><link>"), esc[1],
                                                      F.lit("</link><description>"), esc[0], F.lit("</description>")).alias("line")),
            F.struct(F.lit(2).alias("part"), F.lit("</channel></rss>").alias("line")))).alias("e")).select("e.*")
    for c, t in [("date", "date"), ("kind", "int"), ("v", "string"), ("a", "string"), ("slot", "long")]:
        edge = edge.withColumn(c, F.lit(None).cast(t))
    return body.unionByName(edge).orderBy("part", "date", "v", "a", "slot").select("line")


def stamps(p: RunParams, spark) -> DataFrame:
    """The two stamps of a run. The page converts the UTC time to local time, the plain stamp does not."""
    ts = F.lit(p.run_ts).cast("timestamp_ntz")
    return spark.range(1).select(local_stamp(ts).alias("page_stamp"), build_stamp(ts).alias("build_stamp"))
