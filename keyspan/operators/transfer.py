"""Moving range-sharded data: export / import (A1-A9), prune (B4), sparse
key seek (B5), projection by key list (B7).

An export of a key range is a ``filter`` on the sharding keys (pushed into
the Parquet scan), optionally sorted within partitions, written either as
Parquet or as tab-separated text (``\\N`` for NULL; backslash, tab and line
ends escaped, so any string survives).  Chunks are not separate queries: the chunk start is a column and
the writer partitions by it, so one job writes every chunk in parallel.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.operators.audit import row_hash
from keyspan.operators.ranges import (chunk_ranges_from_bounds, export_file_name,
                                      key_range_predicate)
from keyspan.spec import MAX_TABLE_MULTIPLIER, TableSpec

# --- A2 / A1 / B1 / F4 ------------------------------------------------------

def export_range(df: DataFrame, spec: TableSpec, lo=None, hi=None) -> DataFrame:
    """A1/A2: rows of ``[lo, hi]`` (OR over the sharding keys; a NULL key
    never matches a bound), sorted within partitions by ``order_by`` when the
    spec has one.  No bounds exports everything."""
    out = df.filter(key_range_predicate(spec.keys, lo, hi)) if spec.keys else df
    if spec.order_by:
        out = out.sortWithinPartitions(*spec.order_by)
    return out


# --- Fixed values: the text format ----------------------------------------------
NULL_TEXT = "\\N"
ESCAPES = (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"))
# ---------------------------------------------------------------------------------


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def _escaped(c: Column, kind: T.DataType) -> Column:
    """One field as text.  The backslash goes first, so every escape in the
    output starts at an odd backslash and the reader can undo it."""
    text = F.to_json(c) if _nested(kind) else F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, mark in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return F.coalesce(text, F.lit(NULL_TEXT))


def _unescaped(field: Column, kind: T.DataType) -> Column:
    """The reverse: between doubled backslashes every backslash starts an
    escape."""
    def part(x: Column) -> Column:
        for raw, mark in ESCAPES:
            x = F.replace(x, F.lit(mark), F.lit(raw))
        return x

    text = F.array_join(F.transform(F.split(field, r"\\\\"), part), "\\")
    text = F.when(field != NULL_TEXT, text)
    if _nested(kind):
        return F.from_json(text, kind)
    return F.unbase64(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def as_lines(df: DataFrame, *extra: str) -> DataFrame:
    """Rows as one tab-separated ``value`` each, plus the ``extra`` columns."""
    kept = [f for f in df.schema.fields if f.name not in extra]
    return df.select(F.concat_ws("\t", *[_escaped(F.col(f"`{f.name}`"), f.dataType) for f in kept]).alias("value"), *extra)


def write_tsv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    w = as_lines(df, *partition_by).write.mode("overwrite").option("lineSep", "\n")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def read_tsv(spark, path: str, schema: T.StructType) -> DataFrame:
    """Import a tab-separated export back with an explicit schema."""
    fields = F.split("value", "\t")
    lines = spark.read.option("lineSep", "\n").text(path).select(fields.alias("f"))
    return lines.select(*[_unescaped(F.get("f", F.lit(i)), f.dataType).alias(f.name)
                          for i, f in enumerate(schema.fields)])


# --- A3 / A4 / A5 chunked export ---------------------------------------------

def shard_bounds(shard_map: DataFrame, tables: dict[str, tuple[DataFrame, str]],
                 multiplier: float = MAX_TABLE_MULTIPLIER) -> DataFrame:
    """Per shard ``(shard, lo, hi, open)``; an open shard's ``hi`` is the
    largest first-key value over all tables times ``multiplier`` (floored:
    ids are integers; the reference keeps a float here).  The maximum is a
    scalar subquery, so it never passes through the driver."""
    maxes = [d.select(F.max(k).cast("long").alias("k")) for d, k in tables.values()]
    top = reduce(lambda a, b: a.unionByName(b), maxes).select(
        F.floor(F.max("k") * F.lit(multiplier)).cast("long")).scalar()
    # an open shard holding no key yet (top below its start) gets no bounded
    # chunk; its open-ended chunk then starts at its own minimum
    return shard_map.select(F.col("name").alias("shard"), F.col("min_id").alias("lo"),
                            F.coalesce(F.col("max_id"), F.greatest(top, F.col("min_id") - 1)).alias("hi"),
                            F.col("max_id").isNull().alias("open"))


def export_chunks(shard_map: DataFrame, tables: dict[str, tuple[DataFrame, str]], table: str,
                  chunks: int) -> DataFrame:
    """A3-A5: chunk table for one table's export: the bounded chunks of every
    shard, plus the open-ended ``> hi`` chunk after an open shard, each with
    its export file name."""
    b = shard_bounds(shard_map, tables)
    bounded = chunk_ranges_from_bounds(b, chunks).select("shard", "chunk_min", "chunk_max")
    infinity = b.filter("open").select("shard", (F.col("hi") + 1).alias("chunk_min"),
                                       F.lit(None).cast("long").alias("chunk_max"))
    out = bounded.unionByName(infinity)
    return out.withColumn("file_name", export_file_name(F.lit(table), F.col("chunk_min"),
                                                        F.col("chunk_max")))


def chunk_files(df: DataFrame, keys, chunks: DataFrame) -> DataFrame:
    """Every row once for each chunk (``chunk_min``, ``chunk_max``,
    ``file_name``) that any of its keys falls in.  Chunks are disjoint, so each
    key adds one name to its row at most, and the names are made distinct
    inside the row: repeated rows and rows without a primary key stay as they
    are, and nothing is shuffled."""
    from keyspan.operators.rangejoin import range_join
    names = [f"__file{i}" for i in range(len(keys))]
    for key, name in zip(keys, names):
        df = range_join(df, key, chunks.select(F.col("chunk_min").alias("__cmin"), F.col("chunk_max").alias("__cmax"),
                                               F.col("file_name").alias(name)),
                        lo="__cmin", hi="__cmax", how="left").drop("__cmin", "__cmax")
    held = F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull()))
    return df.withColumn("file_name", F.explode(held)).drop(*names)


def export_chunked(df: DataFrame, spec: TableSpec, chunks: DataFrame, path: str,
                   fmt: str = "parquet") -> DataFrame:
    """A3: write every chunk of ``df`` as its own partition directory in one
    job and return the row counts ``(file_name, rows)`` of what was written,
    read back (summed = rows exported).  A multi-key table writes a row once per
    chunk any of its keys falls in (A8); the import side removes those copies.

    One exchange by (chunk, primary key) ranges: a task writes the chunks of its
    range, so there are about as many files as tasks and chunks together, and a
    hot chunk is written by many tasks."""
    tagged = chunk_files(df, spec.keys, chunks)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("file_name"), *[F.col(c) for c in spec.pk if c in df.columns], row_hash(df.columns)]
    out = tagged.repartitionByRange(n, *order).sortWithinPartitions("file_name", *spec.order_by)
    if fmt == "tsv":
        write_tsv(out, path, ("file_name",))
        # a row is a line: line ends in values are escaped
        written = df.sparkSession.read.option("lineSep", "\n").text(path)
    else:
        out.write.mode("overwrite").partitionBy("file_name").parquet(path)
        written = df.sparkSession.read.schema(out.schema).parquet(path)
    return written.groupBy("file_name").agg(F.count(F.lit(1)).cast("long").alias("rows"))


# --- A7 / A8 import conflict modes -------------------------------------------

def import_rows(existing: DataFrame, incoming: DataFrame, pk, mode: str | None = None) -> DataFrame:
    """Load ``incoming`` into ``existing``.

    ``ignore``  keeps the existing row on a key clash (incoming duplicates of
                an existing key are dropped);
    ``replace`` takes the incoming row;
    ``None``    every key may come once: a key that repeats, among the incoming
                rows or with an existing one, fails the load when it runs.
    Incoming rows that are equal in all columns (A8 multi-key chunk copies)
    count once; of different incoming rows with one key the smallest (by all
    columns) is taken, so a rerun loads the same rows."""
    pk = list(pk)
    if mode is None:
        return _unique(existing.unionByName(incoming), pk)
    rest = [c for c in incoming.columns if c not in pk]
    inc = incoming.groupBy(*pk).agg(F.min(F.struct(*rest)).alias("__r")).select(
        *[F.col(f"__r.{c}").alias(c) if c in rest else F.col(c) for c in incoming.columns]) if rest else incoming.distinct()
    mode = mode.strip().lower()
    if mode == "ignore":
        return existing.unionByName(inc.join(existing.select(*pk), pk, "left_anti"))
    if mode == "replace":
        return inc.unionByName(existing.join(inc.select(*pk), pk, "left_anti"))
    raise ValueError(f"unknown import mode {mode!r}")


def _unique(rows: DataFrame, pk: list[str]) -> DataFrame:
    """``rows``, failing at run time at the first key that repeats.  A lag over
    key-sorted partitions, so equal keys meet, and a hot key fails at its second
    row.  A row with a NULL key column never clashes and is not shuffled."""
    keyed = F.lit(True)
    for c in pk:
        keyed = keyed & F.col(c).isNotNull()
    before = F.lag(F.lit(1)).over(Window.partitionBy(*pk).orderBy(*pk))
    clash = F.concat(F.lit("duplicate key on import: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in pk]))
    checked = (rows.where(keyed)
               .withColumn("__ok", F.when(before.isNotNull(), F.raise_error(clash).cast("int")).otherwise(1))
               .where("__ok = 1").drop("__ok"))
    return checked.unionByName(rows.where(~keyed))


# --- A9 schema copy -----------------------------------------------------------

def empty_like(df: DataFrame) -> DataFrame:
    """An empty table with the same schema (``limit(0)`` keeps the plan
    lazy and reads nothing)."""
    return df.limit(0)


# --- B4 prune ---------------------------------------------------------------

def prune_to_range(df: DataFrame, keys, lo: int, hi: int | None) -> DataFrame:
    """Keep rows a shard ``[lo, hi]`` should hold: a row goes only when
    every sharding key is non-NULL and outside the range.  Idempotent."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    outside = []
    for k in keys:
        c = F.col(k)
        out_k = (c < lo) if hi is None else ((c < lo) | (c > hi))
        outside.append(c.isNotNull() & out_k)
    return df.filter(~reduce(and_, outside))


# --- B5 next-key seek, B7 key-list projection ---------------------------------

def next_keys(df: DataFrame, key: str) -> DataFrame:
    """B5 for every distinct key at once: the next larger and next smaller
    key.  Two distributed lags (``grouped_lag`` with no group: range
    partitions plus a carry from the neighbouring partition), so no single
    task ever holds all keys."""
    from keyspan.operators.scan import grouped_lag
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    prev = grouped_lag(keys, [], [key], key, "prev_key")
    both = grouped_lag(prev.withColumn("__neg", -F.col(key)), [], ["__neg"], key, "next_key")
    return both.select(key, "next_key", "prev_key")


def next_key_after(df: DataFrame, key: str, id_, direction: str = "asc") -> DataFrame:
    """B5 single seek: smallest key > id (asc) or largest key < id (desc)."""
    if direction == "asc":
        return df.filter(F.col(key) > id_).agg(F.min(key).alias("next_id"))
    if direction == "desc":
        return df.filter(F.col(key) < id_).agg(F.max(key).alias("next_id"))
    raise ValueError(f"direction must be asc or desc, got {direction!r}")


def project_for_keys(df: DataFrame, keys_df: DataFrame, key: str, fields) -> DataFrame:
    """Selected fields of the rows whose key is in ``keys_df``, ordered by
    key; a semi-join, never a literal IN list."""
    return df.join(keys_df.select(key).distinct(), key, "left_semi").select(*fields) \
        .orderBy(key)
