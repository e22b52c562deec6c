"""Audits across shards and copies: duplicate unique keys (C3-C5, G2), count
verification (C7, C8), file-manifest diff (C9), chunk checksums (C10),
result-set diff (G3) and union of shards (G1).

Shards / copies are passed as ``{name: DataFrame}``; they are tagged with
their name and unioned, so every audit is one aggregation or join over the
union, never a loop of per-pair queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators.ranges import chunk_of


def union_shards(shards: dict[str, DataFrame], cols=None, tag: str = "shard") -> DataFrame:
    """G1: all shards as one table with a ``shard`` column."""
    parts = []
    for name, df in shards.items():
        d = df.select(*cols) if cols else df
        parts.append(d.withColumn(tag, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_keys(shards: dict[str, DataFrame], key: str | list[str]) -> DataFrame:
    """Keys present on more than one shard, with the number of
    rows carrying them and the sorted list of shards (comma-joined).

    Exact (the reference probes with a Bloom filter and skips the minimum
    key; documented divergence).  Plan: per-(key, shard) partial counts are
    combined map-side, then one shuffle on ``key``; a hot key sends at most
    one partial row per task, so skew cannot pile rows into one task."""
    keys = [key] if isinstance(key, str) else list(key)
    u = union_shards(shards, keys)
    per = u.groupBy(*keys, "shard").agg(F.count(F.lit(1)).alias("__n"))
    agg = per.groupBy(*keys).agg(F.sum("__n").cast("long").alias("n_rows"),
                               F.count(F.lit(1)).alias("__shards"),
                               F.array_join(F.array_sort(F.collect_list("shard")), ",")
                               .alias("shards"))
    return agg.filter(F.col("__shards") > 1).drop("__shards")


def duplicate_rows(shards: dict[str, DataFrame], key: str, fields) -> DataFrame:
    """For every key held by more than one shard, each holding shard's row
    (selected ``fields``) together with the list of shards involved.  Pairs
    of shards are implied by that list instead of materialising one row per
    pair, so the output stays linear in the duplicates."""
    dups = duplicate_keys(shards, key).select(key, "shards")
    u = union_shards(shards, [key, *[f for f in fields if f != key]])
    return u.join(dups, key, "inner")


def count_check(expected: DataFrame, actual: DataFrame, key: str = "table_name",
                left: str = "expected", right: str = "actual") -> DataFrame:
    """Per table, expected vs actual counts with full-outer semantics (a
    table missing on one side shows up as NULL there); ``match`` is False on
    any difference.  Built as a union plus one aggregate, not a join."""
    u = expected.select(key, F.col("n").alias("__n"), F.lit(0).alias("__side")).unionByName(
        actual.select(key, F.col("n").alias("__n"), F.lit(1).alias("__side")))
    j = u.groupBy(key).agg(F.sum(F.when(F.col("__side") == 0, F.col("__n"))).cast("long").alias(left),
                           F.sum(F.when(F.col("__side") == 1, F.col("__n"))).cast("long").alias(right))
    return j.withColumn("match", F.coalesce(F.col(left) == F.col(right), F.lit(False)))


def merge_count_validation(source_counts: DataFrame, merged_counts: DataFrame) -> DataFrame:
    """Sum of the source nodes' counts per table against the merged
    node's counts.  ``source_counts``: ``(node, table_name, n)``;
    ``merged_counts``: ``(table_name, n)``."""
    s = source_counts.groupBy("table_name").agg(F.sum("n").cast("long").alias("n"))
    return count_check(s, merged_counts, left="source_rows", right="merged_rows") \
        .withColumnRenamed("match", "valid")


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source file must exist on the target with the same size;
    extra target files are fine.  Inputs: ``(rel_path, length)``.  Returns the
    offending source files with ``problem`` = missing / size."""
    t = target.select("rel_path", F.col("length").alias("target_length"))
    j = source.join(t, "rel_path", "left")
    return (j.filter(F.col("target_length").isNull() | (F.col("target_length") != F.col("length")))
            .withColumn("problem", F.when(F.col("target_length").isNull(), "missing")
                        .otherwise("size")))


def row_hash(cols) -> F.Column:
    """64-bit hash of a row.  A NULL leaves xxhash64's running seed as it is,
    so every column also puts in whether it is NULL: a value that moves from
    one column to another changes the hash."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def with_chunk(df: DataFrame, key: str, lo: int, hi: int, chunks: int) -> DataFrame:
    """Adds ``chunk_min``/``chunk_max``.  No row is without a chunk: keys below
    the range are in (NULL, lo - 1), keys above it in (hi + 1, NULL), and rows
    without a key in (NULL, NULL)."""
    k, width = F.col(key), max((hi - lo + 1) // chunks, 1)
    start = chunk_of(k, lo, hi, chunks)
    first = F.when(k > hi, F.lit(hi + 1)).otherwise(start).cast("long")
    last = (F.when(k < lo, F.lit(lo - 1))
            .when(k <= hi, F.least(start + (width - 1), F.lit(hi)))).cast("long")
    return df.withColumn("chunk_min", first).withColumn("chunk_max", last)


def chunk_checksums(df: DataFrame, key: str, lo: int, hi: int, chunks: int, cols) -> DataFrame:
    """C10 per chunk: row count and an order-independent checksum
    ``bit_xor(hash(row))`` plus ``sum`` of the hashes (xor alone cancels
    pairs of equal rows).  One aggregation keyed by chunk."""
    h = row_hash(cols)
    return (with_chunk(df, key, lo, hi, chunks).groupBy("chunk_min", "chunk_max")
            .agg(F.count(F.lit(1)).cast("long").alias("rows"),
                 F.bit_xor(h).alias("xor_hash"),
                 F.sum(h.cast("decimal(38,0)")).alias("sum_hash")))


def compare_chunks(a: DataFrame, b: DataFrame, key: str, lo: int, hi: int, chunks: int, cols) -> DataFrame:
    """``(chunk_min, chunk_max, a_rows, b_rows, same)`` of every chunk that
    holds rows in either copy.  Both copies' checksums are tagged and meet in
    one aggregation, so the NULL bounds of the outer chunks need no care."""
    side = lambda d, i: chunk_checksums(d, key, lo, hi, chunks, cols).withColumn("side", F.lit(i))
    of = lambda c, i: F.max(F.when(F.col("side") == i, F.col(c)))
    both = side(a, 0).unionByName(side(b, 1)).groupBy("chunk_min", "chunk_max").agg(
        *[of(c, i).alias(f"{c}{i}") for c in ("rows", "xor_hash", "sum_hash") for i in (0, 1)])
    same = F.lit(True)
    for c in ("rows", "xor_hash", "sum_hash"):
        same = same & F.col(f"{c}0").eqNullSafe(F.col(f"{c}1"))
    return both.select("chunk_min", "chunk_max", F.coalesce("rows0", F.lit(0)).cast("long").alias("a_rows"),
                       F.coalesce("rows1", F.lit(0)).cast("long").alias("b_rows"), same.alias("same"))


def checksum_diff(a: DataFrame, b: DataFrame, key: str, lo: int, hi: int, chunks: int,
                  cols) -> DataFrame:
    """Chunks whose count or checksum differ between two copies (a
    chunk missing on one side differs too).  Only these chunks need a row
    diff (G3) afterwards."""
    return compare_chunks(a, b, key, lo, hi, chunks, cols).filter(~F.col("same")).drop("same")


def result_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` missing from ``b`` and the reverse, with
    multiplicity (``exceptAll``), tagged ``side`` = only_a / only_b."""
    return (a.exceptAll(b).withColumn("side", F.lit("only_a"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b"))))
