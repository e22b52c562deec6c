"""File listings (A14) for manifest checks (C9): the ``binaryFile`` source
lists files with their sizes in parallel; contents are never read (only the
``path`` and ``length`` columns are selected, which Spark prunes); and small
text files that appear whole or not at all, for the state of long jobs."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A14 ``dir_list``: ``(rel_path, length)`` under ``root``, recursively."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root).select("path", "length"))
    # paths come back with the scheme and authority of the store; compare what follows
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    base = re.sub(scheme, "", root).rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), scheme, "")
    return df.select(F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
                     .alias("rel_path"), F.col("length"))


def dir_size(listing: DataFrame) -> DataFrame:
    """A14 ``dir_size``: total bytes."""
    return listing.agg(F.sum("length").cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def _context(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop, hadoop.getFileSystem(conf)


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop's FileSystem, so HDFS and object stores work too."""
    _, hadoop, fs = _context(spark, path)
    return fs.exists(hadoop)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder (one level, metadata only); none if it is missing."""
    _, hadoop, fs = _context(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, whole."""
    jvm, hadoop, fs = _context(spark, path)
    stream = fs.open(hadoop)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all: written beside its
    place and renamed.  ``FileExistsError`` if the name is taken."""
    jvm, hadoop, fs = _context(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(hadoop.getParent(), f".{hadoop.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(beside, hadoop, none)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if fs.exists(hadoop):
            raise FileExistsError(path) from e
        raise


def delete(spark: SparkSession, path: str) -> bool:
    _, hadoop, fs = _context(spark, path)
    return fs.delete(hadoop, True)
