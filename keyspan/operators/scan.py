"""Ordered scans per group that never put a whole group into one task.

A window ``partitionBy(group).orderBy(...)`` sends every row of a group to a
single task; with one pool holding a third of the history that task holds a
third of the data.  These helpers do the classic two-pass parallel scan
instead:

1. ``repartitionByRange(group, order)`` and a sort inside the partitions: Spark
   samples the keys and cuts the ordered key space into balanced partitions,
   so a hot group spans many.  This is the only exchange of the rows;
2. one vectorised pass over each sorted partition gives the running value (or
   the lag) inside it, batch by batch, carrying only the last row's state;
3. one summary row per ``(partition, group)`` -- at most partitions + groups
   rows -- and a window over that small table for each partition's carry-in;
4. a join of the carry-in back onto the rows (the summary is small; AQE
   broadcasts it when its measured size is under the broadcast threshold).

The scanned frame is checkpointed (into the shared checkpoint dir) before it
is used twice: two separate range exchanges would each sample their own
bounds, and partition ids would then disagree between the local pass and the
summary.  The checkpoint also makes the scan restartable without recomputing
its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}
_RUNNING = {"sum": np.cumsum, "min": np.minimum.accumulate, "max": np.maximum.accumulate}
_JOINED = {"sum": np.add, "min": np.minimum, "max": np.maximum}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _combine(fn: str, local: Column, carry: Column) -> Column:
    if fn == "sum":
        # a NULL on either side is "no value yet", as in a running SUM
        return F.coalesce(local + F.coalesce(carry, F.lit(0)), carry)
    if fn == "min":
        return F.least(local, carry)  # least/greatest skip NULLs
    return F.greatest(local, carry)


def _ranged(df: DataFrame, cols: list[str], partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[F.col(c) for c in cols]).withColumn("__pid", F.spark_partition_id())


def range_chunks(df: DataFrame, cols: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``cols`` with its partition id in
    ``__pid``, checkpointed so every later use sees the same assignment."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return _ranged(df, cols, partitions).checkpoint(eager=True)


def _starts(batch: pa.RecordBatch, group: list[str], last: list | None) -> np.ndarray:
    """Whether each row begins a group: it differs from the row before it
    (``last``: the group of the row before the batch)."""
    new = np.zeros(batch.num_rows, bool)
    for i, g in enumerate(group):
        col = batch.column(batch.schema.get_field_index(g))
        codes = pc.fill_null(col.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
        new[0] |= last is None or last[i] != col[0].as_py()
    if last is None:
        new[0] = True
    return new


def _group_at_end(batch: pa.RecordBatch, group: list[str]) -> list:
    return [batch.column(batch.schema.get_field_index(g))[-1].as_py() for g in group]


def _run_scan(group: list[str], values: list[str], outs: list[str], fn: str):
    """Sorted batches -> the same with the running value of each group."""
    def run(batches):
        last, held = None, [None] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _starts(batch, group, last)
            begins = np.flatnonzero(new | (np.arange(n) == 0))
            ends = np.r_[begins[1:], n]
            columns = []
            for k, name in enumerate(values):
                col = batch.column(batch.schema.get_field_index(name))
                kind = np.int64 if pa.types.is_integer(col.type) else np.float64
                null = col.is_null().to_numpy(zero_copy_only=False)
                neutral = 0 if fn == "sum" else pc.min_max(col).as_py()["max" if fn == "min" else "min"]
                filled = col if neutral is None else pc.fill_null(col, neutral)
                x = np.zeros(n, kind) if neutral is None else filled.to_numpy(zero_copy_only=False).astype(kind)
                out, seen = np.empty(n, kind), np.empty(n, bool)
                for a, b in zip(begins, ends):
                    out[a:b] = _RUNNING[fn](x[a:b])
                    seen[a:b] = np.logical_or.accumulate(~null[a:b])
                    if a == 0 and not new[0] and held[k] is not None:
                        out[:b] = np.where(seen[:b], _JOINED[fn](out[:b], held[k]), held[k])
                        seen[:b] = True
                held[k] = out[-1] if seen[-1] else None
                columns.append(pa.array(out, mask=~seen))
            last = _group_at_end(batch, group)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *outs])
    return run


def _run_lag(group: list[str], value: str, out: str):
    """Sorted batches -> the same with the previous row's value in the group;
    ``<out>_first`` marks each group's first row in the partition."""
    def run(batches):
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, group, last)
            col = batch.column(batch.schema.get_field_index(value))
            before = pa.concat_arrays([pa.nulls(1, col.type) if held is None else held, col.slice(0, batch.num_rows - 1)])
            lag = pc.if_else(pa.array(new), pa.scalar(None, col.type), before)
            last, held = _group_at_end(batch, group), col.slice(batch.num_rows - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, lag, pa.array(new)],
                                             names=[*batch.schema.names, out, f"{out}_first"])
    return run


def grouped_scan(df: DataFrame, group: list[str], order: list[str], value, fn: str,
                 out, backward: bool = False, partitions: int | None = None) -> DataFrame:
    """Running ``fn`` (sum / min / max) of ``value`` per ``group`` in ``order``
    (ascending, ties must be broken by ``order`` itself).  ``backward`` scans
    from the end (suffix aggregate, current row included).  ``value`` and
    ``out`` may be lists to scan several columns in the same pass.  Values are
    integers (scanned as longs) or doubles."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    kinds = [T.LongType() if isinstance(df.schema[v].dataType, _INTEGRAL) else T.DoubleType() for v in values]
    sort = [*group, *order]
    local_names = [f"__loc{i}" for i in range(len(values))]
    ranged = _ranged(df, sort, partitions).sortWithinPartitions(
        *[F.col(c).desc() if backward else F.col(c) for c in sort])
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(n, k) for n, k in zip(local_names, kinds)]])
    local = ranged.mapInArrow(_run_scan(group, values, local_names, fn), schema).checkpoint(eager=True)
    totals = local.groupBy("__pid", *group).agg(*[_AGG[fn](v).alias(f"__tot{i}") for i, v in enumerate(values)])
    psort = F.col("__pid").desc() if backward else F.col("__pid")
    wt = Window.partitionBy(*group).orderBy(psort).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__pid", *group, *[_AGG[fn](f"__tot{i}").over(wt).alias(f"__carry{i}")
                                             for i in range(len(values))])
    res = local.join(carry.select(F.col("__pid").alias("__cpid"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                                  *[f"__carry{i}" for i in range(len(values))]), _same(group), "left")
    return res.select(*[F.col(c) for c in df.columns if c not in outs],
                      *[_combine(fn, F.col(f"__loc{i}"), F.col(f"__carry{i}")).alias(o) for i, o in enumerate(outs)])


def _same(group: list[str]) -> Column:
    """Rows and carries of one partition and group (NULL groups included)."""
    cond = F.col("__pid") == F.col("__cpid")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return cond


def next_at_or_after(points: DataFrame, queries: DataFrame, group: list[str], point: str,
                     query: str, key: str, out: str) -> DataFrame:
    """For every query row, the smallest ``point`` >= its ``query`` value in
    the same group (NULL if none).  ``key`` is a long column unique per group
    among the queries (a natural key, so a recomputed task yields the same
    rows).  Both sets are unioned and ordered by value with queries first on
    ties; a backward running minimum of the points answers every query."""
    p = points.select(*group, F.col(point).cast("long").alias("__v"), F.lit(1).alias("__kind"),
                      F.col(point).cast("long").alias("__pt"), F.lit(None).cast("long").alias("__qk"))
    q = queries.select(*group, F.col(query).cast("long").alias("__v"), F.lit(0).alias("__kind"),
                       F.lit(None).cast("long").alias("__pt"), F.col(key).cast("long").alias("__qk"))
    scanned = grouped_scan(p.unionByName(q), group, ["__v", "__kind", "__qk"], "__pt", "min",
                           "__nxt", backward=True)
    ans = scanned.filter(F.col("__kind") == 0).select(*group, F.col("__qk").alias(key),
                                                     F.col("__nxt").alias(out))
    return queries.join(ans, [*group, key], "left")


def grouped_lag(df: DataFrame, group: list[str], order: list[str], value: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """``lag(value)`` per ``group`` in ``order`` without a per-group task: a
    local lag inside each range partition, and for a partition's first row
    of a group the last value of that group in the previous partition."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    ranged = _ranged(df, [*group, *order], partitions).sortWithinPartitions(*group, *order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("__lag", df.schema[value].dataType),
                           T.StructField("__lag_first", T.BooleanType())])
    local = ranged.mapInArrow(_run_lag(group, value, "__lag"), schema).checkpoint(eager=True)
    lasts = local.groupBy("__pid", *group).agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("__last"))
    wt = Window.partitionBy(*group).orderBy("__pid")
    carry = lasts.select(F.col("__pid").alias("__cpid"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                         F.lag("__last").over(wt).alias("__carry"))
    res = local.join(carry, _same(group), "left")
    return res.select(*[F.col(c) for c in df.columns if c != out],
                      F.when(F.col("__lag_first"), F.col("__carry")).otherwise(F.col("__lag")).alias(out))
