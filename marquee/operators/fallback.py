"""First strategy that yields: all strategies run as one union, the lowest yielding rank per group is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_yielding(rows: DataFrame, group: list[str], rank: str, yields: Column | None = None) -> DataFrame:
    """Rows of the lowest ``rank`` per ``group``, the rank taken over rows that satisfy ``yields``.

    Ranks come from a partial aggregate and join back as one small row per group. A window would gather every
    row of a group in one task, and a group (all pages of one endpoint, say) may be most of the table.
    """
    pick = rows if yields is None else rows.where(yields)
    best = pick.groupBy(*group).agg(F.min(rank).alias("_best"))
    return rows.join(best, group).where(F.col(rank) == F.col("_best")).drop("_best")


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by a partial aggregate; a hot key shrinks before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*"))
