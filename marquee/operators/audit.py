"""What each source found, kept, filtered and failed, as aggregates over the staged listings.

What counts as found, kept or filtered differs per source; adapters say so per row (``found``, ``kept``,
``filtered``), so one aggregate serves all. Sources are a small dimension: (source_name, source_rank, status).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.config import RunParams
from marquee.functions.text import html_escape

SOURCE_DIM = ("source_name string, source_rank int, success boolean, error string, empty_message string")


def source_audit(staged: DataFrame, sources: DataFrame, run_ts: Column) -> DataFrame:
    """One AUDIT row per source of the dimension, sources without any row included.

    ``sources`` columns: source_name, source_rank, success, error (set when it could not be read), empty_message
    (the note of a readable source that found nothing).
    """
    counts = staged.groupBy("source_rank").agg(
        F.count_if("found").alias("events_found"), F.count_if("kept").alias("events_after_filter"),
        F.count_if("filtered").alias("events_filtered"))
    zero = F.lit(0).cast("long")
    found = F.coalesce("events_found", zero)
    return (sources.join(counts, "source_rank", "left").select(
        run_ts.cast("timestamp").alias("run_ts"), "source_name", "source_rank", "success",
        found.alias("events_found"), F.coalesce("events_after_filter", zero).alias("events_after_filter"),
        F.coalesce("events_filtered", zero).alias("events_filtered"),
        F.coalesce("error", F.when(F.col("success") & (found == 0), F.col("empty_message"))).alias("error")))


def with_page_errors(sources: DataFrame, errors: DataFrame) -> DataFrame:
    """The source dimension with what ``pages.page_errors`` says: a source of which a page failed has failed, with the message of the first such page."""
    e = errors.select("source_rank", F.col("error").alias("page_error"))
    return sources.join(e, "source_rank", "left").select(
        "source_name", "source_rank", (F.col("success") & F.col("page_error").isNull()).alias("success"), F.coalesce("error", "page_error").alias("error"), "empty_message")


def status_icon(success: Column, found: Column) -> Column:
    """By what was found; the health class below goes by what was kept."""
    return F.when(~success, "❌").when(found == 0, "⚠️").otherwise("✅")


def status_line(name: Column, success: Column, found: Column, filtered: Column, error: Column) -> Column:
    icon = status_icon(success, found)
    ok = F.concat(icon, F.lit(" "), name, F.lit(": "), found.cast("string"), F.lit(" event(s) found"),
                  F.when(filtered > 0, F.concat(F.lit(" ("), filtered.cast("string"), F.lit(" filtered as non-music)")))
                  .otherwise(F.lit("")))
    bad = F.concat(icon, F.lit(" "), name, F.lit(": ERROR — "), F.coalesce(error, F.lit("None")))
    return F.when(success, ok).otherwise(bad)


def public_error(error: Column) -> Column:
    """An error text without addresses and connection detail, at most 80 characters."""
    x = F.regexp_replace(F.coalesce(error, F.lit("unavailable")), r"https?://[^ \t\r\n]+", "[url]")
    return F.substring(F.regexp_replace(x, r"HTTPSConnectionPool[^\n]*", "connection failed"), 1, 80)


def public_status_line(name: Column, success: Column, found: Column) -> Column:
    """What the public may see of a source: never the error itself."""
    head = F.concat(status_icon(success, found), F.lit(" "), html_escape(name))
    return (F.when(~success, F.concat(head, F.lit(": unavailable")))
            .when(found == 0, F.concat(head, F.lit(": no events this week")))
            .otherwise(F.concat(head, F.lit(": "), found.cast("string"), F.lit(" event(s)"))))


def source_health(audit: DataFrame) -> DataFrame:
    """Rows of the health table: class by kept count, count shown as a dash for a failed source."""
    kept = F.col("events_after_filter")
    return audit.select(
        "source_rank",
        F.when(~F.col("success"), "src-error").when(kept == 0, "src-warn").otherwise("src-ok").alias("css_class"),
        html_escape(F.col("source_name")).alias("source_name"),
        F.when(F.col("success"), kept.cast("string")).otherwise("—").alias("shown_count"))


def failures(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("success")).select("source_rank", "source_name", "error")


def rollup(audit: DataFrame, name: str) -> DataFrame:
    """Several audit rows as one: sums, success when any succeeded or none failed, failing names in rank order.

    The list holds one short name per failing source; it grows with the source dimension, not with the listings.
    """
    failed = F.when(~F.col("success"), F.struct("source_rank", "source_name"))
    names = F.transform(F.sort_array(F.collect_list(failed)), lambda f: f["source_name"])
    zero = F.lit(0).cast("long")
    return audit.agg(
        F.lit(name).alias("source_name"),
        F.coalesce(F.bool_or("success"), F.lit(True)).alias("success"),
        F.coalesce(F.sum("events_found"), zero).alias("events_found"),
        F.coalesce(F.sum("events_after_filter"), zero).alias("events_after_filter"),
        F.coalesce(F.sum("events_filtered"), zero).alias("events_filtered"),
        F.when(F.count_if(~F.col("success")) > 0,
               F.concat(F.lit("Some venues failed: "), F.array_join(names, ", "))).alias("error"))


def run_totals(audit: DataFrame, deduped: DataFrame) -> DataFrame:
    """Raw and deduplicated counts and the one-line summary of the run."""
    a = audit.agg(F.coalesce(F.sum("events_after_filter"), F.lit(0).cast("long")).alias("total_raw_events"),
                  F.count_if(F.col("success") & (F.col("events_after_filter") > 0)).alias("ok_sources"),
                  F.count_if(~F.col("success")).alias("error_sources"))
    d = deduped.agg(F.count("*").alias("total_deduped_events"))
    both = a.join(F.broadcast(d))
    return both.withColumn("summary", summary_line(F.col("total_deduped_events"), F.col("ok_sources"), F.col("error_sources")))


def summary_line(total: Column, ok: Column, failed: Column) -> Column:
    return F.concat(total.cast("string"), F.lit(" events from "), ok.cast("string"), F.lit(" source"),
                    F.when(ok == 1, "").otherwise("s"),
                    F.when(failed > 0, F.concat(F.lit(" ("), failed.cast("string"), F.lit(" had errors)"))).otherwise(""))


def origin_status(staged: DataFrame) -> DataFrame:
    """Found and kept per file or page."""
    return staged.groupBy("source_rank", "origin").agg(
        F.count_if("found").alias("events_found"), F.count_if("kept").alias("events_after_filter"))


def health_history(audits: DataFrame) -> DataFrame:
    """Change of the kept count and of the state of each source against its run before.

    ``audits`` holds one row per source and run, so a source's window is as long as its number of runs.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("source_name").orderBy("run_ts")
    before = F.lag("events_after_filter").over(w)
    return audits.select(
        "source_name", "run_ts", "success", "events_after_filter", before.alias("previous"),
        (F.col("events_after_filter") - before).alias("change"),
        F.coalesce(F.lag("success").over(w) != F.col("success"), F.lit(False)).alias("state_changed"))


def run_header(p: RunParams, totals: DataFrame) -> DataFrame:
    return totals.select(F.lit(p.run_ts).cast("timestamp").alias("run_timestamp"),
                         F.struct(F.lit(p.anchor_date).alias("start"), F.lit(p.end_date).alias("end")).alias("date_range"),
                         "total_raw_events", "total_deduped_events", "summary")
