"""Which landed files are taken in, and for how long they stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import config
from marquee.functions.text import safe_file_name, suffix
from marquee.operators.fallback import latest_per_key


def accepted(name: Column, length: Column) -> Column:
    """Known suffix, at least one safe character in the name, some content, and no more than the size limit."""
    return (suffix(name).isin(config.IMAGE_SUFFIXES + config.WEB_SUFFIXES) & safe_file_name(name).isNotNull()
            & (length > 0) & (length <= config.MAX_UPLOAD_BYTES))


def rejection(name: Column, length: Column) -> Column:
    """Why a file is refused; null when it is taken."""
    return (F.when((length == 0) | (F.length(name) == 0), "No file provided")
            .when(length > config.MAX_UPLOAD_BYTES, "File too large (max 20 MB)")
            .when(~suffix(name).isin(config.IMAGE_SUFFIXES + config.WEB_SUFFIXES),
                  F.concat(F.lit("File type "), suffix(name), F.lit(" not allowed")))
            .when(safe_file_name(name).isNull(), "Invalid filename"))


def manifest(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Latest accepted file per safe name; ``updated`` when the prior manifest already has the name.

    ``files`` has name, length, modified and any further columns; ``prior`` has file_name.
    """
    ok = files.where(accepted(F.col("name"), F.col("length"))).withColumn("file_name", safe_file_name(F.col("name")))
    latest = latest_per_key(ok, "file_name", ["modified", "name"])
    known = prior.select("file_name").distinct().withColumn("_known", F.lit(True))
    return latest.join(known, "file_name", "left").withColumn("updated", F.coalesce("_known", F.lit(False))).drop("_known")


def retained(files: DataFrame, run_ts: Column, hours: int = 24) -> DataFrame:
    """Files not older than ``hours`` at the time of the run."""
    return files.where(F.col("modified") > run_ts - F.expr(f"INTERVAL {int(hours)} HOURS"))
