"""Session construction and shared I/O helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tables produced by the data generator (one parquet file each).
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "keyspan") -> SparkSession:
    """Session for tests, bench and scripts.  On a cluster the launcher's own
    settings win: ``getOrCreate`` keeps whatever is already configured."""
    master = master or os.environ.get("KEYSPAN_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KEYSPAN_DRIVER_MEM", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there.  Where nothing
    is configured only a single-machine ``local[...]`` session falls back to a
    temporary folder; any other master raises.  Lineage is cut with ``DataFrame.checkpoint()`` into this folder,
    never with ``localCheckpoint``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"spark.checkpoint.dir is unset and master {sc.master} is not local: "
                             "name a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="keyspan-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_scratch: list[str] = []      # folders handed out and not yet dropped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables.
    Results are lazy and read these folders, so they stay until the caller has
    used its results and calls :func:`drop_scratch`."""
    base = checkpoint_dir(spark).rstrip("/")
    _scratch.append(f"{base}/{name}-{uuid.uuid4().hex[:12]}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the folders that :func:`scratch_path` handed out in this process
    (with the copies that jobs keep beside a table); returns how many."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _scratch:
        folder = _scratch.pop()
        for p in (folder, f"{folder}.old", f"{folder}.new"):
            dropped += bool(path(p).getFileSystem(conf).delete(path(p), True))
    return dropped


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table.  Column pruning / filter pushdown happen on the
    returned lazy scan, so callers just ``select``/``filter``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
