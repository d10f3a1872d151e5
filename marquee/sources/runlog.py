"""Earlier runs' documents read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = """run_timestamp string, date_range struct<start: string, end: string>, total_raw_events long,
 total_deduped_events long,
 sources array<struct<name: string, success: boolean, events_found: long, events_after_filter: long,
  events_filtered: long, error: string>>,
 events array<struct<artist: string, venue: string, date: string, time: string, source: string>>"""

STATUS_SCHEMA = """last_run string, date_range struct<start: string, end: string>, total_raw long, total_filtered long,
 total_final long, sources map<string, struct<status: string, count: long, message: string>>"""


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path)


def parse_documents(docs: DataFrame, schema: str) -> DataFrame:
    """Documents held as text (origin, body) with the fields of ``schema``."""
    return docs.select("origin", F.from_json("body", schema).alias("d")).select("origin", "d.*")


def log_runs(log: DataFrame) -> DataFrame:
    return log.select(F.to_timestamp("run_timestamp").alias("run_ts"), F.to_date("date_range.start").alias("start"),
                      F.to_date("date_range.end").alias("end"), "total_raw_events", "total_deduped_events")


def log_sources(log: DataFrame) -> DataFrame:
    return (log.select(F.to_timestamp("run_timestamp").alias("run_ts"), F.posexplode("sources").alias("source_rank", "s"))
            .select("run_ts", F.col("s.name").alias("source_name"), "source_rank", "s.success", "s.events_found",
                    "s.events_after_filter", "s.events_filtered", "s.error"))


def log_events(log: DataFrame) -> DataFrame:
    return (log.select(F.to_timestamp("run_timestamp").alias("run_ts"), F.posexplode("events").alias("pos", "e"))
            .select("run_ts", F.col("pos").cast("long").alias("pos"), "e.artist", "e.venue", F.to_date("e.date").alias("date"),
                    "e.time", "e.source"))


def status_sources(status: DataFrame) -> DataFrame:
    """Older status documents: sources are a map from name to state."""
    return (status.select("last_run", F.explode("sources").alias("source_name", "s"))
            .select("last_run", "source_name", "s.status", "s.count", "s.message"))
