"""Bad records: what an adapter could not use, where it came from and why.

The adapters go on without such records. Here they are rows of their own, so that a run can keep them beside its marts; a landed record is either read by its
adapter or listed here, or it is of no interest (outside the window, not music), which is no error. Reasons are a fixed set, counted while the rows are
written, without a pass of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BAD = "source_name string, source_rank int, origin string, pos long, reason string, record string"
NOT_JSON, NO_NAME, NO_DATE, BAD_DATE = "not JSON", "no name", "no date", "bad date"
FEW_CELLS, MANY_CELLS, WRONG_TYPE, UNREAD = "too few cells", "too many cells", "value of a wrong type", "page not read"
REASONS = [NOT_JSON, NO_NAME, NO_DATE, BAD_DATE, FEW_CELLS, MANY_CELLS, WRONG_TYPE, UNREAD]


def bad_rows(rows: DataFrame, reason: Column, record: Column, source_name: Column, source_rank: Column) -> DataFrame:
    """``BAD`` rows of those for which there is a reason; ``rows`` have origin and pos (null where a whole file is bad)."""
    return rows.select(source_name.alias("source_name"), source_rank.cast("int").alias("source_rank"), F.col("origin").cast("string").alias("origin"),
                       F.col("pos").cast("long").alias("pos"), reason.alias("reason"), record.alias("record")).where(F.col("reason").isNotNull())


def missing(name: Column, raw_date: Column, date: Column) -> Column:
    """Why a record without a usable name and date is bad, or null."""
    return (F.when(F.coalesce(F.length(name), F.lit(0)) == 0, NO_NAME).when(F.coalesce(F.length(raw_date), F.lit(0)) == 0, NO_DATE)
            .when(date.isNull(), BAD_DATE))


def union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], BAD)


def counted(bad: DataFrame, name: str = "bad_records") -> tuple[DataFrame, Observation]:
    """``bad``, and its number of rows by reason, to be asked for once the rows have been written."""
    seen = Observation(name)
    return bad.observe(seen, F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]), seen
