"""Shard-map source and sink in the asset-tracker JSON layout (A11):
``{pools: [...], shards: [{min_id, max_id, parent, state, master, slaves:
[{host, weight, role}], shard_pool}], spares: [...], shard_pools: [...]}``.
``max_id`` may be the string ``INFINITY``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.spec import SHARD_MAP_SCHEMA, shard_name_col

SLAVE = T.StructType([T.StructField("host", T.StringType()), T.StructField("weight", T.LongType()),
                      T.StructField("role", T.StringType())])
SHARD = T.StructType([
    T.StructField("min_id", T.LongType()), T.StructField("max_id", T.StringType()),
    T.StructField("parent", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("master", T.StringType()), T.StructField("slaves", T.ArrayType(SLAVE)),
    T.StructField("shard_pool", T.StringType()),
])
TRACKER = T.StructType([
    T.StructField("pools", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("shards", T.ArrayType(SHARD)),
    T.StructField("spares", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("shard_pools", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Tracker JSON -> shard map (``seq`` = position in the file's list)."""
    doc = spark.read.schema(TRACKER).option("multiLine", True).json(path)
    s = doc.select(F.posexplode("shards").alias("seq", "s")).select("seq", "s.*")
    hi = F.when(F.upper(F.col("max_id")) == "INFINITY", F.lit(None)).otherwise(F.col("max_id")).cast("long")
    m = s.select(F.coalesce("shard_pool", F.lit("anon")).alias("pool"), "min_id", hi.alias("max_id"),
                 F.coalesce("state", F.lit("ready")).alias("state"), "parent", F.col("seq").cast("int"))
    return m.withColumn("name", shard_name_col(F.col("pool"), F.col("min_id"), F.col("max_id"))) \
        .select(*[f.name for f in SHARD_MAP_SCHEMA])


def write_tracker(shard_map: DataFrame, path: str) -> None:
    """Shard map -> one tracker JSON document (the map is one row per shard,
    so gathering it into a single document is bounded by the shard count)."""
    s = shard_map.select("seq", F.struct(
        "min_id", F.coalesce(F.col("max_id").cast("string"), F.lit("INFINITY")).alias("max_id"),
        "parent", "state", F.lit(None).cast("string").alias("master"),
        F.array().cast(T.ArrayType(SLAVE)).alias("slaves"), F.col("pool").alias("shard_pool")).alias("s"))
    doc = s.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"])
                .alias("shards")) \
        .select(F.array().cast(TRACKER["pools"].dataType).alias("pools"), "shards",
                F.array().cast(TRACKER["spares"].dataType).alias("spares"),
                F.array().cast(TRACKER["shard_pools"].dataType).alias("shard_pools"))
    doc.coalesce(1).write.mode("overwrite").json(path)
