"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.session import scratch_path

BATCH_BYTES = 4 << 20           # of the Arrow batches that carry texts to Python
# white space that separates words
WHITE_CHARS = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut,
    a lost executor costs only its own tasks, and Spark knows the real size
    when it chooses a join."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of some megabytes, whatever the length of
    their texts: the default bounds rows only, and ten thousand long documents
    are too much for a worker.  A setting of the session; it holds for what
    runs after it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` words of a text, in order; null gives none.
    One-character split after mapping white space to blanks stays clear of the
    regex engine."""
    blanks = F.translate(F.coalesce(text, F.lit("")), WHITE_CHARS, " " * len(WHITE_CHARS))
    return F.array_remove(F.split(blanks, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
