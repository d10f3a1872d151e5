"""What the physical plans must look like."""

import datetime

from pyspark.sql import functions as F

from marquee import schema
from marquee.config import RunParams
from marquee.operators import audit, dedup, fallback, rules
from marquee.sources import pages

P = RunParams(datetime.date(2026, 2, 15))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.lit(datetime.date(2026, 2, 16)).alias("date"), F.lit("2026-02-16").cast("timestamp_ntz").alias("ts"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    by_day = plan(df.where(rules.in_window(F.col("date"), P)).select("date"))
    by_stamp = plan(df.where(rules.stamp_in_window(F.col("ts"), P)).select("id"))
    assert "GreaterThanOrEqual(date,2026-02-15)" in by_day and "ReadSchema: struct<date:date>" in by_day
    assert "GreaterThanOrEqual(ts" in by_stamp and "LessThan(ts" in by_stamp


def test_pages_do_not_shuffle(spark):
    df = spark.createDataFrame([("generic", "<p></p>", "v", "s", 1, "o", 0)],
                               "kind string, html string, page_venue string, source_name string, source_rank int, origin string, endpoint_rank int")
    p = plan(pages.stage_pages(df, P))
    # cards are read from the page's tree by one Arrow-batched function, once for each page; all else is JVM expressions
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p and p.count("Python") == p.count("ArrowEvalPython") == 1


def test_ordinary_blocks_shuffle_once(spark):
    rows = [("a", "v", datetime.date(2026, 2, 16), None, "s", None, "s", 0, "f", i) for i in range(5)]
    p = plan(dedup.deduplicate(spark.createDataFrame(rows, schema.LISTING)))
    assert p.count("Exchange") == 1 and "MapInArrow" in p


def test_aggregates_are_partial_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    assert "partial_max_by" in plan(fallback.latest_per_key(df, "k", ["v"]))
    staged = df.select(F.col("k").cast("int").alias("source_rank"), F.lit(True).alias("found"), F.lit(True).alias("kept"), F.lit(False).alias("filtered"))
    dim = spark.createDataFrame([("a", 0, True, None, None)], audit.SOURCE_DIM)
    assert "partial_count" in plan(audit.source_audit(staged, dim, F.lit("2026-02-15")))
