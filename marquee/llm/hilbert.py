"""Sharding along a Hilbert curve.

Source, language and size of a row are quantised to ``2 ** BITS`` cells each (names by their place among all distinct names, the size by its
logarithm), the cells give an index on the Hilbert curve, rows are ordered by it and cut into runs of equal row counts. Rows near each other in all
dimensions lie in few shards, so that each shard covers a small range of every one and readers skip the others.

Ordering moves narrow rows only: the text is read for its size and check sum and stays where it is. Distinct names are summed before the shuffle and
come back by a join (a hot name is split by the adaptive plan; the table of names is broadcast by its measured size only). Rows are
dealt by ranges and numbered range by range, so that no task sees all of them.

Defined cases: a null text has no bytes and check sum 0, as the empty one; null names count as the empty name; equal rows get different
slots; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import fresh, ranked, table

SHARDS = 16
#: What sharding adds.
ADDED = ("size", "text_crc32", "curve", "law", "shard", "slot")
BITS = 5
LAW = "rows"


def curve_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with whole coordinates below ``2 ** bits``.

    The coordinates become the curve's transposed index by undoing its rotations from the highest bit down, then the Gray code; its bits are
    read off across the dimensions.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | (a ^ t) >> b & 1
    return index


def curve(*cells: Column, bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(a, b, c):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(curve_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    return index(*cells)


def name_cells(df: DataFrame, name: str, cell: str, bits: int = BITS) -> DataFrame:
    """``df`` with the cell of a name: its place among the distinct names, scaled."""
    key, at, value = fresh(df, "_key"), fresh(df, "_at"), fresh(df, "_value")
    with_key = df.withColumn(key, F.coalesce(F.col(name).cast("string"), F.lit("")))
    names = ranked(with_key.select(F.col(key).alias(value)).distinct(), F.col(value), name=at)
    count = names.agg(F.max(at)).first()[0]
    cells = names.select(value, F.floor(F.col(at) * (1 << bits) / F.lit((count or 0) + 1)).cast("int").alias(cell))
    return with_key.join(cells, F.col(key) == F.col(value)).drop(key, value)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``curve``, ``law``, ``shard``, ``slot``; give it narrow rows, or those that shall move with their texts."""
    source, lang, length, rank = (fresh(docs, c) for c in ("_source_cell", "_lang_cell", "_size_cell", "_rank"))
    rows = name_cells(name_cells(docs, "source", source), "lang", lang)
    rows = rows.withColumn(length, F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size") * F.lit(1.25))).cast("int"))
    rows = rows.withColumn("curve", curve(F.col(source), F.col(lang), F.col(length))).drop(source, lang, length)
    placed = ranked(rows, F.col("curve"), F.col("text_crc32"), F.col("doc_id"), F.col("size"), name=rank)
    total = (placed.agg(F.max(rank)).first()[0] or 0) + 1
    shard = F.expr(f"({rank} * {shards}) div {total}")
    first = F.expr(f"(({rank} * {shards}) div {total} * {total} + {shards - 1}) div {shards}")
    return placed.select(*[c for c in placed.columns if c != rank], F.lit(LAW).alias("law"), shard.cast("int").alias("shard"), (F.col(rank) - first).cast("long").alias("slot"))


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that sharding needs, and ``more``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), *more)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, parts: int | None = None) -> None:
    """One folder ``shard=<n>`` for each shard, with all columns of ``docs`` as they are and those that sharding adds.

    Rows are dealt by ranges of shard and slot over ``parts`` tasks (the shuffle partitions, at least one a shard), so that a shard is several
    files of one run of the curve each, in slot order; no task holds a shard, and a file's columns cover small ranges. A column of
    ``docs`` that is named as one of ``ADDED`` is in the files with ``_`` before its name.
    """
    row = "_row"
    placed = sharded(measured(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)), shards)
    kept = [F.col(f"{row}.`{c}`").alias(fresh(docs, f"_{c}") if c.lower() in ADDED else c) for c in docs.columns]
    parts = max(shards, parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    at.select(*ADDED, *kept).write.partitionBy("shard").parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(measured(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
