"""Row counts: chunked counts (D1), global row count rollup (D2), range counts
(B6), key bounds (D3, D4) and range-violation audits (B3, D5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.operators.ranges import chunk_of, key_range_predicate, range_check_predicate
from keyspan.operators.route import route_all_keys
from keyspan.spec import TableSpec


def shard_counts(df: DataFrame, spec: TableSpec, shard_map: DataFrame) -> DataFrame:
    """Rows per shard of one sharded table: ``(table_name, shard, n)``.

    A row counts for every shard that holds one of its sharding keys; rows
    whose keys are all NULL or outside every shard are not counted.  The
    data meets the map once per key; the count is a partial
    aggregate per task followed by a tiny shuffle of (shard, n) pairs."""
    routed = route_all_keys(df.select(*spec.keys), spec.keys, shard_map, spec.pool)
    return routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(spec.name).alias("table_name"), "shard", "n")


def functional_counts(df: DataFrame, spec: TableSpec, label: str = "functional") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(spec.name).alias("table_name"), F.lit(label).alias("shard"), "n")


def global_rowcount(counts: list[DataFrame]) -> DataFrame:
    """D2/D12 (and the A15 "query every shard and reduce" idiom): union of
    per-(table, shard) counts rolled up to per-table totals and one grand
    total.  ``lvl`` is ``grouping_id``: 0 detail, 1 table total,
    3 grand total."""
    u = reduce(lambda a, b: a.unionByName(b), counts)
    return (u.rollup("table_name", "shard")
            .agg(F.sum("n").cast("long").alias("row_count"),
                 F.grouping_id().cast("int").alias("lvl")))


def chunk_rowcounts(df: DataFrame, key: str, lo: int | None, hi: int | None, chunks: int) -> DataFrame:
    """Row count per chunk of ``[lo, hi]`` (B11 chunking), computed as one
    aggregate keyed by the chunk index instead of one query per chunk.
    Empty chunks are absent (a count of 0 contributes nothing to the sum)."""
    c = chunk_of(F.col(key), lo, hi, chunks)
    return (df.select(key).filter(F.col(key).between(lo, hi))
            .groupBy(c.alias("chunk_min")).agg(F.count(F.lit(1)).alias("n"))
            .select("chunk_min",
                    F.least(F.col("chunk_min") + chunk_width(lo, hi, chunks) - 1, F.lit(hi))
                    .cast("long").alias("chunk_max"), "n"))


def chunk_width(lo: int, hi: int, chunks: int, min_per_chunk: int = 1) -> int:
    # integer division before ceil in the reference, i.e. a floor
    return max((hi - lo + 1) // chunks, min_per_chunk)


def range_count(df: DataFrame, spec: TableSpec, lo=None, hi=None) -> DataFrame:
    """Rows in ``[lo, hi]``: OR over the sharding keys, or the first pk
    column when there is none; no bounds counts everything.  Also reports the
    per-chunk-sum variant the reference's chunked counting yields on
    multi-key tables (a row whose keys fall in two chunks counts twice)."""
    if lo is None or hi is None:
        return df.agg(F.count(F.lit(1)).cast("long").alias("n"),
                      F.count(F.lit(1)).cast("long").alias("chunk_sum"))
    cols = spec.keys or ((spec.first_pk_col,) if spec.first_pk_col else ())
    if not cols:
        return df.agg(F.count(F.lit(1)).cast("long").alias("n"),
                      F.count(F.lit(1)).cast("long").alias("chunk_sum"))
    pred = key_range_predicate(cols, lo, hi)
    if spec.chunks > 1:
        w = chunk_width(lo, hi, spec.chunks)
        idx = [F.when(F.col(k).between(lo, hi), F.expr(f"(`{k}` - {int(lo)}L) div {w}L"))
               for k in cols]
        n_chunks = F.size(F.array_distinct(F.filter(F.array(*idx), lambda x: x.isNotNull())))
    else:
        n_chunks = F.lit(1)
    return df.filter(pred).agg(F.count(F.lit(1)).cast("long").alias("n"),
                               F.sum(n_chunks).cast("long").alias("chunk_sum"))


def key_bounds(dfs: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Global min and max of the key over several tables."""
    parts = [d.agg(F.min(keys[t]).cast("long").alias("lo"), F.max(keys[t]).cast("long").alias("hi"))
             for t, d in dfs.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.agg(F.min("lo").alias("min_key"), F.max("hi").alias("max_key"))


def max_composite_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """D3/F2: the greatest value of a composite key (``ORDER BY all DESC
    LIMIT 1`` semantics) as one aggregate: ``max(struct(...))``."""
    m = F.max(F.struct(*[F.col(c) for c in cols])).alias("__m")
    return df.agg(m).select([F.col(f"__m.{c}").alias(c) for c in cols])


def range_violations(df: DataFrame, spec: TableSpec, lo: int, hi: int | None) -> DataFrame:
    """Per sharding key, rows whose key is outside ``[lo, hi]``
    (``key > hi OR key < lo``; NULL keys are not violations), with a status.
    Table status is ``invalid`` when any key is invalid (the reference lets
    the last key tested overwrite it; documented divergence)."""
    aggs = [F.count_if(F.coalesce(range_check_predicate(F.col(k), lo, hi), F.lit(False)))
            .cast("long").alias(k) for k in spec.keys]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{k}', `{k}`" for k in spec.keys)
    long_ = wide.selectExpr(f"stack({len(spec.keys)}, {stack}) AS (key_col, violations)")
    return long_.select(F.lit(spec.name).alias("table_name"), "key_col", "violations",
                        F.when(F.col("violations") > 0, "invalid").otherwise("valid").alias("status"))
