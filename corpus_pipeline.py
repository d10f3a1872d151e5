"""Documents to token ids: toxicity, near copies, benchmark passages, personal data, byte-level BPE.

Each stage works on all rows that the one before it kept and is written and read back as Parquet. All but the last return the columns of
``documents``; repeated rows, null texts and ids, and further columns pass as the operators' docstrings say. Texts go to Python workers in batches of
some MB (``small_batches``, a setting of the session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import bpe, near_text, pii, tiling, toxicity
from marquee.llm.common import table
from marquee.session import ensure_checkpoint_dir, small_batches


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic; the labels are those of ``sf_dir``."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group of texts that BK-trees of SimHash fingerprints link and that have a five-word likeness of 0.8
    or more."""
    small_batches(spark)
    return near_text.drop_near_texts(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that cover a benchmark item."""
    small_batches(spark)
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    small_batches(spark)
    return pii.mask(docs, pii.fit(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, digests of the ids and of the decoded bytes, and the ids."""
    small_batches(spark)
    return bpe.encode(spark, docs)


STAGES = [
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("byte_bpe", token_ids),
]

#: Learned models, connected components and merges have no SQL form; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is written below the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}-{name}")
    return docs
