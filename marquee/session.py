"""Session helpers for tests, bench and local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "marquee", **extra: str) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cores}]").appName(name)
         .config("spark.sql.shuffle.partitions", str(cores))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in extra.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; a cluster session must name one, since
    a machine-local folder would not outlive an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="marquee-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows of a task, on average, of a table that ``spread`` deals out.
SPREAD_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, and one for each ``SPREAD_ROWS`` rows.

    For work that is heavy per row (page and JSON extraction, long texts), where moving the rows costs less than leaving cores idle: splits are cut by
    compressed bytes, so that one of narrow rows holds very many. An input with enough splits is returned as it is, without a shuffle.
    """
    have, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    need = max(cores, -(-df.count() // SPREAD_ROWS))
    return df if have >= need else df.repartition(need)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Whole texts go to Python workers at most ``most`` bytes at a time, where the session says nothing else.

    By default a batch has 10,000 rows, and the buffers of each core, in the executor and in its worker, grow to hold them.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
