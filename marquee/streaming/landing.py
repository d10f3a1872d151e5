"""Incremental publishing: staged listings dropped into a folder update the published list.

Deduplication depends on input order, so a block is never merged with its former result: the buckets that new
listings fall into are recomputed from everything landed for them, and only those partitions are rewritten.

Landed batches are merged into a generation now and then, so that what a batch has to list and open does not grow with the number of batches. A generation
counts once it is complete; only then are the batches and the generation that it replaces removed. A batch that runs again, also after its
rows were merged, changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.config import RunParams
from marquee.functions.text import match_norm
from marquee.operators.dedup import deduplicate
from marquee.operators.rules import in_window
from marquee.schema import LISTING, to_listing
from marquee.session import cut

BUCKETS = 64
COMPACT_EVERY = 16


@dataclass(frozen=True)
class Store:
    """Folders of the incremental job, all in storage every executor shares."""

    root: str
    buckets: int = BUCKETS
    compact_every: int = COMPACT_EVERY

    @property
    def landed(self) -> str:
        return f"{self.root}/landed"

    @property
    def merged(self) -> str:
        return f"{self.root}/merged"

    @property
    def published(self) -> str:
        return f"{self.root}/published"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"


def with_bucket(listing: DataFrame, buckets: int) -> DataFrame:
    """A block lies in one bucket, so a bucket can be recomputed by itself."""
    return listing.withColumn("bucket", F.pmod(F.xxhash64(match_norm(F.col("venue"))), F.lit(buckets)).cast("int"))


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Complete folders ``name=<number>`` of a path, by number."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(root)]
    return {int(n.split("=")[1]): p for n, p in found if n.startswith(f"{name}=") and fs.exists(hadoop(f"{p}/_SUCCESS"))}


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _parts(spark: SparkSession, store: Store) -> tuple[int, list[str]]:
    """Number of the last batch that a generation holds (-1: none), and the folders that hold everything landed."""
    generations = _folders(spark, store.merged, "generation")
    upto = max(generations, default=-1)
    batches = _folders(spark, store.landed, "batch")
    return upto, [p for n, p in generations.items() if n == upto] + [p for n, p in sorted(batches.items()) if n > upto]


def read_landed(spark: SparkSession, store: Store) -> DataFrame:
    """Everything landed, with its bucket: one generation and at most ``compact_every`` batches."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING.fields)
    _, parts = _parts(spark, store)
    read = [spark.read.schema(f"{fields}, bucket int").option("basePath", p).parquet(p) for p in parts]
    return reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], f"{fields}, bucket int")


def _write(rows: DataFrame, path: str, **options: str) -> None:
    """One file for each date and bucket, more where it is large: small ones are written by one task, a large one is split over several."""
    rows.hint("rebalance", "date", "bucket").write.mode("overwrite").options(**options).partitionBy("date", "bucket").parquet(path)


def compact(spark: SparkSession, store: Store, batch_id: int) -> None:
    """Merge all batches up to ``batch_id`` into one generation."""
    upto, _ = _parts(spark, store)
    if batch_id <= upto:
        return
    _write(read_landed(spark, store), f"{store.merged}/generation={batch_id}")
    for n, path in _folders(spark, store.merged, "generation").items():
        if n < batch_id:
            _remove(spark, path)
    for n, path in _folders(spark, store.landed, "batch").items():
        if n <= batch_id:
            _remove(spark, path)


def land(batch: DataFrame, batch_id: int, store: Store, p: RunParams) -> DataFrame:
    """Keep one batch's listings of the window, unless a generation holds them already; returns the dates and buckets that it touches."""
    spark = batch.sparkSession
    new = with_bucket(to_listing(batch.where(in_window(F.col("date"), p))), store.buckets)
    upto, _ = _parts(spark, store)
    if batch_id > upto:
        _write(new, f"{store.landed}/batch={batch_id}")
        new = read_landed_batch(spark, store, batch_id)
        if batch_id - upto >= store.compact_every:
            touched = cut(new.select("date", "bucket").distinct())
            compact(spark, store, batch_id)
            return touched
    return new.select("date", "bucket").distinct()


def apply_batch(batch: DataFrame, batch_id: int, store: Store, p: RunParams) -> None:
    """Land one batch and rewrite the buckets it touches. Running it again with the same id changes nothing."""
    touched = land(batch, batch_id, store, p)
    # dates in the window times buckets: a bounded table
    scope = read_landed(batch.sparkSession, store).join(F.broadcast(touched), ["date", "bucket"], "left_semi").drop("bucket")
    _write(with_bucket(deduplicate(scope).drop("venue_norm"), store.buckets), store.published, partitionOverwriteMode="dynamic")


def read_landed_batch(spark: SparkSession, store: Store, batch_id: int) -> DataFrame:
    """The dates and buckets of one landed batch."""
    path = f"{store.landed}/batch={batch_id}"
    return spark.read.schema("artist string, date date, bucket int").option("basePath", path).parquet(path)


def start(spark: SparkSession, folder: str, store: Store, p: RunParams, max_files: int = 1000) -> StreamingQuery:
    """Process what lies in ``folder`` (JSON lines in the listing schema) and stop; call again for later files."""
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", max_files).json(folder)
    return (stream.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, store, p))
            .option("checkpointLocation", store.progress).trigger(availableNow=True).start())
