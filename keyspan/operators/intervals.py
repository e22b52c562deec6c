"""Integer interval sets per source (G4, G5): parse ``uuid:lo-hi[:lo-hi]``
text, merge, subset tests and set difference.

All set algebra is one sweep over interval boundaries in range partitions, so a
source with billions of ids or intervals is spread over many tasks; ids are
never expanded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_interval_sets(df: DataFrame, text: str, set_col: str | None = None) -> DataFrame:
    """``uuid:1-5:7:9-12,uuid2:1-100`` -> rows ``(set?, source, lo, hi)``.
    A single number ``n`` is the interval ``[n, n]``."""
    keep = [set_col] if set_col else []
    per_src = df.select(*keep, F.explode(F.split(F.regexp_replace(F.col(text), r"\s+", ""), ","))
                        .alias("__s")).filter(F.col("__s") != "")
    parts = per_src.select(*keep, F.split("__s", ":").alias("__p"))
    iv = parts.select(*keep, F.element_at("__p", 1).alias("source"),
                      F.explode(F.slice("__p", 2, 1 << 30)).alias("__iv"))
    b = F.split("__iv", "-")
    return iv.select(*keep, "source", F.element_at(b, 1).cast("long").alias("lo"),
                     F.coalesce(F.try_element_at(b, F.lit(2)), F.element_at(b, 1)).cast("long").alias("hi"))


def _events(iv: DataFrame, group: list[str], side: int) -> DataFrame:
    """+1 at ``lo`` and -1 at ``hi + 1`` (closed intervals as half-open) for set
    0 or 1, as two counters."""
    point = F.explode(F.array(F.struct(F.col("lo").cast("long").alias("p"), F.lit(1).cast("long").alias("d")),
                              F.struct((F.col("hi") + 1).cast("long").alias("p"), F.lit(-1).cast("long").alias("d"))))
    e = iv.select(*group, point.alias("__e"))
    zero = F.lit(0).cast("long")
    return e.select(*group, "__e.p", F.col("__e.d").alias("da") if side == 0 else zero.alias("da"),
                    F.col("__e.d").alias("db") if side == 1 else zero.alias("db"))


def _sweep(events: DataFrame, group: list[str]) -> DataFrame:
    """Per group the maximal intervals that set 0 covers and set 1 does not.

    The boundaries are exchanged and sorted once (equal points of a group meet
    in one partition).  Each partition's totals give the two coverage numbers
    with which its first group begins; then one pass over the partitions as they
    lie turns coverage into intervals.  Only an interval that is open at a
    partition's edge, two a partition at most, is put together afterwards."""
    from keyspan.session import checkpoint_dir
    spark = events.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(g) for g in group], F.col("p")]
    rows = (events.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))
    name = F.struct(*[F.col(g) for g in group]) if group else F.lit(0)
    totals = rows.groupBy("pid", name.alias("g")).agg(F.sum("da").alias("a"), F.sum("db").alias("b"))
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("pid", "g", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"c{c}") for c in "ab"])
    # one row for each partition: that of its first group
    first = F.broadcast(carried.groupBy("pid").agg(F.min_by(F.struct("ca", "cb"), "g").alias("c")).select("pid", "c.*"))
    kind = T.StructType([*[rows.schema[g] for g in group], T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
                         T.StructField("pid", T.IntegerType())])
    found = rows.join(first, "pid", "left").select(*group, "p", "da", "db", "pid", "ca", "cb").mapInArrow(_uncovered(group), kind)
    # read for whole and for open intervals, and once more where a range exchange samples the result
    found = found.checkpoint(eager=True)
    whole = found.where("lo is not null and hi is not null").select(*group, "lo", "hi")
    # in order an interval's left part is followed by its right part
    w = Window.partitionBy(*group).orderBy("pid", F.col("hi").asc_nulls_last())
    across = (found.where("lo is null or hi is null").withColumn("__lo", F.lag("lo").over(w))
              .where("hi is not null").select(*group, F.col("__lo").alias("lo"), "hi"))
    return whole.unionByName(across)


def _uncovered(group: list[str]):
    """A partition's sorted boundaries -> its intervals; ``hi`` NULL: open at
    the partition's end, ``lo`` NULL: open since before it."""
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        p, da, db = (t.column(c).to_numpy() for c in ("p", "da", "db"))
        new = np.zeros(len(p), bool)
        new[0] = True
        for g in group:
            codes = pc.fill_null(t.column(g).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        rows, los, his = [], [], []
        for i, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(p)])):
            ca, cb = (t.column("ca")[0].as_py(), t.column("cb")[0].as_py()) if i == 0 else (0, 0)
            last = np.flatnonzero(np.r_[p[a + 1:b] != p[a:b - 1], True])         # the state once all of a point counts
            inside = ((ca + np.cumsum(da[a:b])[last]) > 0) & ((cb + np.cumsum(db[a:b])[last]) <= 0)
            was = np.r_[ca > 0 and cb <= 0, inside[:-1]]
            edges = p[a:b][last][inside != was].tolist()
            if was[0]:
                edges.insert(0, None)
            if len(edges) % 2:
                edges.append(None)
            if edges == [None, None]:                                            # covered from edge to edge: no edge here
                continue
            rows += [a] * (len(edges) // 2)
            los += edges[::2]
            his += [None if x is None else x - 1 for x in edges[1::2]]
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[t.column(g).combine_chunks().take(at) for g in group], pa.array(los, pa.int64()), pa.array(his, pa.int64()),
             pa.array([t.column("pid")[0].as_py()] * len(rows), pa.int32())], names=[*group, "lo", "hi", "pid"])
    return run


def merge_intervals(iv: DataFrame, group: list[str]) -> DataFrame:
    """Union of intervals per group as maximal disjoint ``[lo, hi]``;
    touching intervals (``hi + 1 == lo``) merge."""
    return _sweep(_events(iv, group, 0), group)


def interval_difference(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """G4 "extra": ids in ``a`` that ``b`` lacks, as maximal intervals per
    group (``gtid_subset(a, b)`` is false exactly when this is non-empty)."""
    return _sweep(_events(a, group, 0).unionByName(_events(b, group, 1)), group)


def is_subset(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """One row: ``subset`` = every id of ``a`` is in ``b``."""
    d = interval_difference(a, b, group)
    return d.agg((F.count(F.lit(1)) == 0).alias("subset"))


def subset_by(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """``(group, missing, subset)`` for every group of ``a``: how many of its ids
    ``b`` lacks, and whether that is none."""
    extra = interval_difference(a, b, group).select(*group, (F.col("hi") - F.col("lo") + 1).alias("n"))
    every = a.select(*group).distinct().withColumn("n", F.lit(0).cast("long"))
    found = extra.unionByName(every).groupBy(*group).agg(F.sum("n").cast("long").alias("missing"))
    return found.withColumn("subset", F.col("missing") == 0)


def pick_source(iv: DataFrame, source: str) -> DataFrame:
    """One source's part of an interval set."""
    return iv.filter(F.col("source") == source)


def ids_to_intervals(ids: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """Maximal runs of consecutive integers per group."""
    one = F.col(id_col).cast("long")
    return merge_intervals(ids.where(one.isNotNull()).select(*group, one.alias("lo"), one.alias("hi")), group)


def render_interval_set(iv: DataFrame, group: list[str]) -> DataFrame:
    """``source:lo-hi:lo-hi`` text per source (intervals sorted).  Collects the
    intervals of one source into one row: only for reporting bounded sets."""
    s = iv.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__iv"))
    txt = F.array_join(F.transform("__iv", lambda x: F.when(
        x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(
        F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string")))), ":")
    return s.select(*group, txt.alias("intervals"))
