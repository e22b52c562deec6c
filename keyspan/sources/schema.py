"""Schema detection (A10) and snapshot sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.spec import TableSpec


def detect_schema(spark: SparkSession, df: DataFrame, spec: TableSpec) -> DataFrame:
    """A10: columns in order with type and nullability, primary-key flag and
    position in the key (the Parquet schema plus the TableSpec overlay)."""
    rows = []
    for i, f in enumerate(df.schema.fields, start=1):
        pk_seq = spec.pk.index(f.name) + 1 if f.name in spec.pk else None
        rows.append((spec.name, f.name, i, f.dataType.simpleString(), f.nullable, pk_seq is not None,
                     pk_seq, f.name in spec.keys))
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean, "
              "is_pk boolean, pk_seq int, is_shard_key boolean")


def profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """What the data says of the declared columns: (column_name, n_rows,
    n_nulls, pk_unique).  One pass for the counts and one aggregation by key."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    repeated = df.groupBy(*spec.pk).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(1)).alias("most")).select((F.col("most") == 1)).scalar()
    return counts.selectExpr("n_rows", f"stack({len(names)}, {pairs}) AS (column_name, n_nulls)").select(
        "column_name", "n_rows", "n_nulls", repeated.alias("pk_unique"))


def int_type_flags(column_type, extra) -> list:
    """H5: from a column's type text and its extra text: auto_increment,
    unsigned (the type's last word) and data_type_max, the largest value of an
    integer type (NULL for any other)."""
    from keyspan.operators.capacity import TYPE_MAX
    text = F.lower(F.trim(column_type))
    base = F.regexp_extract(text, "^[a-z]+", 0)
    unsigned = F.element_at(F.split(text, r"\s+"), -1) == "unsigned"
    top = None
    for name, size in TYPE_MAX.items():
        values = F.when(unsigned, F.lit(str(size))).otherwise(F.lit(str(size // 2 - 1))).cast("decimal(20,0)")
        top = F.when(base == name, values) if top is None else top.when(base == name, values)
    return [F.contains(F.lower(extra), F.lit("auto_increment")).alias("auto_increment"), unsigned.alias("unsigned"),
            top.alias("data_type_max")]


def store_snapshot(snapshot: DataFrame, path: str) -> None:
    """Append one capacity snapshot, partitioned by day (so history
    scans of a time range prune whole days)."""
    (snapshot.withColumn("day", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
     .write.mode("append").partitionBy("day").parquet(path))


def history_block(history: DataFrame, pool: str | None, a: int, b: int) -> DataFrame:
    """One pool's (or, with ``pool`` None, every pool's) rows with
    ``a <= ts <= b`` (closed); the ``day`` partition filter prunes folders
    when the history is stored by A12."""
    f = F.col("ts").between(a, b)
    if pool is not None:
        f = f & (F.col("pool") == pool)
    if "day" in history.columns:
        da = F.date_format(F.timestamp_seconds(F.lit(a)), "yyyy-MM-dd")
        db = F.date_format(F.timestamp_seconds(F.lit(b)), "yyyy-MM-dd")
        f = f & F.col("day").between(da, db)
    return history.filter(f)
