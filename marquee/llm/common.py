"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns, whatever their names, do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, one after the other; only a slice of a batch is Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def ranked(df: DataFrame, *order: Column, name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with a gapless position from 0 in the order of the given columns; keep ``df`` narrow.

    Rows are dealt by ranges of the order and sorted inside each range; a table of one row for each range (as many as
    there are shuffle partitions) turns positions in a range into positions overall. The ranges are cut off in the
    checkpoint folder, so that both uses see the same ones. Equal rows get any order among themselves.
    """
    pid, at, start = (fresh(df, x) for x in ("_rank_pid", "_rank_at", "_rank_start"))
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                .withColumn(at, F.monotonically_increasing_id())
                .withColumn(pid, F.shiftright(F.col(at), 33).cast("int"))
                .withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))))
    starts = (dealt.groupBy(pid).agg(F.count(F.lit(1)).alias(start))
              .withColumn(start, F.coalesce(F.sum(start).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (dealt.join(F.broadcast(starts), pid)  # one row for each range: bounded by the number of partitions
            .withColumn(name, F.col(at) + F.col(start)).drop(pid, at, start))
