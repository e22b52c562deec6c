"""The corpus pipeline: ``documents`` to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import cotrain, mixing, packing, secrets, simhash
from keyspan.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    judged = cotrain.classified(docs, table(spark, sf_dir, "labels"))
    return judged.where("ct_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked fingerprints one document stays."""
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document is lost."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the source targets take them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the training sequences."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("token_ids"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("secret scan", secret_scan),
          ("mixing", mix), ("packing", pack)]

#: Tokenizing and hashing thresholds have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
