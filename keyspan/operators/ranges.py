"""Key ranges: predicates (B1-B3), even and explicit splits (B8, B9), chunk
generation (B11) and export file naming (A5).

Range tables are DataFrames ``(min_id, max_id)``; generators use
``sequence``/``explode`` so nothing is built on the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_range_predicate(keys, lo=None, hi=None) -> Column:
    """B1/B2: closed range, min-only or max-only, OR-ed over several keys.
    Plain comparisons, so Parquet row-group filters apply."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if lo is None and hi is None:
        return F.lit(True)
    parts = []
    for k in keys:
        c = F.col(k)
        if lo is not None and hi is not None:
            parts.append((c >= lo) & (c <= hi))
        elif lo is not None:
            parts.append(c >= lo)
        else:
            parts.append(c <= hi)
    return reduce(or_, parts)


def range_check_predicate(key: Column, lo, hi) -> Column:
    """``key > max OR key < min``; an open shard (``hi`` None) has no
    upper violation."""
    below = key < F.lit(lo)
    return below if hi is None else ((key > F.lit(hi)) | below)


def even_split(ranges: DataFrame, n: int, lo: str = "min_id", hi: str = "max_id") -> DataFrame:
    """Split each finite range into ``n`` contiguous pieces; the first
    ``(total % n)`` pieces get one extra id.  An open range raises."""
    total = (F.col(hi) - F.col(lo) + 1)
    base = F.expr(f"({hi} - {lo} + 1) div {int(n)}")
    extra = F.pmod(total, F.lit(n))
    checked = ranges.withColumn(
        "__ok", F.when(F.col(hi).isNull(),
                       F.raise_error(F.lit("an open range has no even split; give explicit ranges")))
        .otherwise(F.lit(True)))
    pieces = checked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i = F.col("piece")
    start = F.col(lo) + i * base + F.least(i, extra)
    size = base + F.when(i < extra, 1).otherwise(0)
    return (pieces.withColumn("piece_min", start.cast("long"))
            .withColumn("piece_max", (start + size - 1).cast("long"))
            .drop("__ok"))


def check_contiguous(pieces: DataFrame, parent_lo: int, parent_hi: int | None,
                     lo: str = "min_id", hi: str = "max_id") -> DataFrame:
    """Explicit split ranges must be gap-free and cover the parent (an
    open parent needs an open last piece).  Returns one row of flags
    ``(has_gaps, covers_start, covers_end, ok)``.  The window runs over the
    pieces of one split, a handful of rows."""
    w = Window.orderBy(lo)
    gap = (F.col("__row") > 1) & (F.col("__prev").isNull() | (F.col("__prev") + 1 != F.col(lo)))
    d = pieces.withColumn("__prev", F.lag(hi).over(w)).withColumn("__row", F.row_number().over(w))
    open_end = F.coalesce(F.max(F.col(hi).isNull()), F.lit(False))
    end = open_end if parent_hi is None else ~open_end & (F.max(hi) == parent_hi)
    flags = d.agg(F.coalesce(F.max(gap), F.lit(False)).alias("has_gaps"),
                  F.coalesce(F.min(lo) == parent_lo, F.lit(False)).alias("covers_start"),
                  F.coalesce(end, F.lit(False)).alias("covers_end"))
    return flags.withColumn("ok", ~F.col("has_gaps") & F.col("covers_start") & F.col("covers_end"))


def chunk_ranges(spark_or_df, lo: int, hi: int, chunks: int, min_per_chunk: int = 1) -> DataFrame:
    """Chunk ``[lo, hi]`` the way the reference does: width =
    ``floor((hi - lo + 1) / chunks)`` (at least ``min_per_chunk``), starts
    every ``width`` ids, the last chunk clipped at ``hi``.  Floors, so it may
    yield *more* than ``chunks`` chunks."""
    width = max((hi - lo + 1) // chunks, min_per_chunk)
    spark = spark_or_df.sparkSession if isinstance(spark_or_df, DataFrame) else spark_or_df
    n = (hi - lo) // width + 1
    return (spark.range(0, n, numPartitions=max(1, min(n // 100_000, 1000)) or 1)
            .select((F.lit(lo) + F.col("id") * width).cast("long").alias("chunk_min"))
            .withColumn("chunk_max", F.least(F.col("chunk_min") + (width - 1), F.lit(hi)).cast("long")))


def chunk_ranges_from_bounds(bounds: DataFrame, chunks: int, lo: str = "lo", hi: str = "hi",
                             min_per_chunk: int = 1) -> DataFrame:
    """B11 over data-derived bounds (one row per table / shard): same rule,
    expressed as columns so the bounds never visit the driver."""
    width = F.greatest(F.expr(f"({hi} - {lo} + 1) div {int(chunks)}"), F.lit(min_per_chunk))
    # an empty range (hi < lo) has no chunk; sequence() would raise on it
    starts = F.when(F.col(hi) >= F.col(lo), F.sequence(F.col(lo), F.col(hi), width)) \
        .otherwise(F.array().cast("array<bigint>"))
    out = bounds.withColumn("__w", width).withColumn("chunk_min", F.explode(starts))
    return out.withColumn("chunk_max", F.least(F.col("chunk_min") + F.col("__w") - 1, F.col(hi))) \
        .drop("__w")


def chunk_of(key: Column, lo: int, hi: int, chunks: int, min_per_chunk: int = 1) -> Column:
    """Start of the B11 chunk holding ``key`` (NULL outside ``[lo, hi]``)."""
    width = max((hi - lo + 1) // chunks, min_per_chunk)
    off = (key - F.lit(lo)).cast("long")
    # off >= 0 inside the range, so truncating integer division is a floor
    start = F.lit(lo) + (off - F.pmod(off, F.lit(width).cast("long"))) if width > 1 else key
    return F.when(key.between(lo, hi), start.cast("long"))


def export_file_name(table: Column, lo: Column, hi: Column) -> Column:
    """A5: export file names: ``{t}{a}-{b}.out``, ``{t}{a}-and-up.out``,
    ``{t}start-{b}.out`` and ``{t}-full.out``."""
    return (F.when(lo.isNotNull() & hi.isNotNull(),
                   F.format_string("%s%d-%d.out", table, lo, hi))
            .when(lo.isNotNull(), F.format_string("%s%d-and-up.out", table, lo))
            .when(hi.isNotNull(), F.format_string("%sstart-%d.out", table, hi))
            .otherwise(F.format_string("%s-full.out", table)))
