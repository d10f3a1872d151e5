"""The intake manifest as a kept table: files are merged into the hash buckets of their names, and no other bucket is read or written.

A merge writes the buckets it changes as one generation, which counts once it is complete (its ``_SUCCESS`` marker); a bucket's rows are those of its
highest complete generation. Only then are the folders it replaces removed, so that a job lost at any time leaves the manifest before or after it. The same
files again change nothing and write nothing. One merge runs at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import safe_file_name
from marquee.operators.fallback import latest_per_key
from marquee.operators.intake import accepted
from marquee.session import cut
from marquee.streaming.landing import _folders, _remove


@dataclass(frozen=True)
class ManifestStore:
    """``root`` lies in storage every executor shares; ``columns`` are those of the files (DDL; name, length, modified and any further ones)."""

    root: str
    columns: str = "name string, length long, modified timestamp"
    buckets: int = 64

    @property
    def schema(self) -> str:
        return f"{self.columns}, file_name string, updated boolean, bucket int"


def _buckets(spark: SparkSession, store: ManifestStore) -> tuple[int, dict[int, str]]:
    """The highest complete generation (-1: none), and where each bucket's rows lie."""
    generations, at = _folders(spark, store.root, "generation"), {}
    for _, path in sorted(generations.items()):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p):
            name = s.getPath().getName()
            if name.startswith("bucket="):
                at[int(name.split("=")[1])] = s.getPath().toString()
    return max(generations, default=-1), at


def _read(spark: SparkSession, store: ManifestStore, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).option("basePath", store.root).parquet(*paths).drop("generation")


def read_manifest(spark: SparkSession, store: ManifestStore) -> DataFrame:
    """One row per safe file name; ``updated``: the row replaced one of an earlier merge."""
    return _read(spark, store, list(_buckets(spark, store)[1].values())).drop("bucket")


def merge_files(files: DataFrame, store: ManifestStore) -> list[int]:
    """Merge ``files`` into the manifest and return the buckets that changed.

    Of the accepted files of a name the latest counts (then the greatest name), those of earlier merges included; a file that is not later than the
    manifest's changes nothing. Files without a name, a length or a time are not accepted. Lists on the driver hold bucket numbers alone.
    """
    spark = files.sparkSession
    columns = [c.strip().split()[0] for c in store.columns.split(",")]
    ok = (files.select(*columns).where(accepted(F.col("name"), F.col("length")) & F.col("modified").isNotNull())
          .withColumn("file_name", safe_file_name(F.col("name"))))
    new = latest_per_key(ok, "file_name", ["modified", "name"]).withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(store.buckets)).cast("int"))
    new = cut(new.select(*columns, "file_name", "bucket"))
    generation, at = _buckets(spark, store)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    prior = _read(spark, store, [at[b] for b in touched if b in at])
    known = prior.select("file_name", F.struct("modified", "name").alias("_before"))
    changed = cut(new.join(known, "file_name", "left").where(F.col("_before").isNull() | (F.struct("modified", "name") > F.col("_before")))
                  .select(*columns, "file_name", F.col("_before").isNotNull().alias("updated"), "bucket"))
    buckets = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
    if not buckets:
        return []
    kept = _read(spark, store, [at[b] for b in buckets if b in at]).join(changed.select("file_name"), "file_name", "left_anti")
    (changed.unionByName(kept).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store.root}/generation={generation + 1}"))
    for b in buckets:
        if b in at:
            _remove(spark, at[b])
    return buckets
