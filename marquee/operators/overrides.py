"""Manual corrections to the deduplicated list, joined by identity key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import identity_key

EDITABLE = ["artist", "venue", "time", "url"]


def with_identity(listing: DataFrame) -> DataFrame:
    return listing.withColumn("key", identity_key(F.col("artist"), F.col("venue"), F.col("date")))


def drop_deleted(keyed: DataFrame, deletes: DataFrame) -> DataFrame:
    """Without listings whose key is on the block list."""
    return keyed.join(deletes.select("key").distinct(), "key", "left_anti")


def apply_edits(keyed: DataFrame, edits: DataFrame) -> DataFrame:
    """Non-null columns of ``edits`` (key, artist, venue, time, url) replace the listing's. One row per key."""
    new = edits.select("key", *[F.col(c).alias(f"_new_{c}") for c in EDITABLE])
    joined = keyed.join(new, "key", "left")
    for c in EDITABLE:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return joined


def mark_featured(keyed: DataFrame, picks: DataFrame) -> DataFrame:
    """Flag picked listings and carry the note; ``picks`` is (key, note)."""
    p = picks.select("key", F.col("note").alias("featured_note"), F.lit(True).alias("_f"))
    return keyed.join(p, "key", "left").withColumn("featured", F.coalesce("_f", F.lit(False))).drop("_f")


def featured_section(keyed: DataFrame, picks: DataFrame) -> DataFrame:
    return keyed.join(picks.select("key").distinct(), "key", "left_semi")
