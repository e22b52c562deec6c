"""Composite jobs (K1-K10).  These are the only places that run actions:
they write tables, verify them and return small reports.

A job that replaces a table writes a new folder beside it, verifies that, and
only then renames: the live folder to ``<path>.old``, the new one to the live
path.  The old folder is kept.  A rename is one metadata operation on a file
system; on an object store it is a copy and not atomic, so there let readers
follow the new path instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.audit import (checksum_diff, count_check, duplicate_keys, merge_count_validation,
                                     result_set_diff, row_hash, union_shards, with_chunk)
from keyspan.operators.capacity import (current_usage, day_over_day, days_left, decaying_growth,
                                        dedup_history, outlier_blocks, outlier_runs, outlier_spikes,
                                        segmentify, threshold_buckets, top_exhaustion, total_consumed)
from keyspan.operators.counts import global_rowcount, shard_counts
from keyspan.operators.ranges import check_contiguous, even_split, key_range_predicate
from keyspan.operators.route import cutover, route_all_keys
from keyspan.operators.transfer import prune_to_range
from keyspan.plans.hooks import NO_HOOKS, Hooks, step
from keyspan.session import scratch_path
from keyspan.sources.files import exists, names_in
from keyspan.sources.schema import store_snapshot
from keyspan.spec import TableSpec, shard_name_col


class JobError(RuntimeError):
    pass


@dataclass
class SplitResult:
    shard_map: DataFrame
    counts: DataFrame


def child_ranges(shard_map: DataFrame, parent: str, n: int | None = None,
                 ranges: list[tuple[int, int | None]] | None = None, state: str = "child") -> DataFrame:
    """K1 step 1: the children of ``parent``: an even split into ``n``
    or explicit ``ranges`` checked for gaps and cover (B9; a last range up to
    None is open).  Children get ``state`` and the parent's name as
    ``parent``."""
    p = shard_map.filter(F.col("name") == parent)
    if ranges is not None:
        row = p.select("pool", "min_id", "max_id").first()
        if row is None:
            raise JobError(f"no shard {parent} in the map")
        sql = ", ".join(f"(CAST({int(a)} AS BIGINT), CAST({'NULL' if b is None else int(b)} AS BIGINT))" for a, b in ranges)
        r = shard_map.sparkSession.sql(f"SELECT * FROM VALUES {sql} AS r(min_id, max_id)")
        chk = check_contiguous(r, row["min_id"], row["max_id"]).first()
        if not chk["ok"]:
            raise JobError(f"split ranges invalid: {chk.asDict()}")
        pieces = r.withColumn("pool", F.lit(row["pool"])).withColumn("seq", F.lit(0))
    else:
        pieces = even_split(p, n).select("pool", "seq", F.col("piece_min").alias("min_id"),
                                         F.col("piece_max").alias("max_id"))
    return pieces.select("pool", "min_id", "max_id", F.lit(state).alias("state"),
                         F.lit(parent).alias("parent"),
                         shard_name_col(F.col("pool"), F.col("min_id"), F.col("max_id")).alias("name"),
                         (F.lit(1000) + F.col("seq")).cast("int").alias("seq"))


def split(df: DataFrame, spec: TableSpec, shard_map: DataFrame, parent: str, out_path: str,
          n: int | None = 2, ranges=None, hooks: Hooks = NO_HOOKS) -> SplitResult:
    """K1: split a shard that is ``ready``.

    Every row that has any sharding key in the parent goes to each child that
    holds one of its keys, written partitioned by child.  The rows that a child
    must have are counted by its range predicate on the table itself, apart
    from the routing, and compared with what was written (C7).  Children are
    added to the map as ``replicating``: the parent serves until
    ``transitions.move_reads_to_children``.  The ``split_write`` hook wraps the
    write: a *before* callback may change the routed rows or abort the split."""
    prow = shard_map.filter(F.col("name") == parent).select("min_id", "max_id", "state").first()
    if prow is None or prow["state"] != "ready":
        raise JobError(f"cannot split {parent}: " + ("not in the map" if prow is None else f"it is {prow['state']}"))
    children = child_ranges(shard_map, parent, n, ranges, state="replicating")
    parent_rows = df.filter(key_range_predicate(spec.keys, prow["min_id"], prow["max_id"]))
    routed = route_all_keys(parent_rows, spec.keys, children.withColumn("state", F.lit("child")), spec.pool)

    def write(rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").partitionBy("shard").parquet(out_path)
        return rows.sparkSession.read.schema(rows.schema).parquet(out_path)

    written = step(hooks, "split_write", write, routed)
    got = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    kids = children.select("name", "min_id", "max_id").collect()      # one row per child
    wanted = df.agg(*[F.count_if(key_range_predicate(spec.keys, k["min_id"], k["max_id"])).alias(k["name"])
                      for k in kids]).first()
    found = {r["shard"]: r["n"] for r in got.collect()}
    off = {k["name"]: (wanted[k["name"]], found.get(k["name"], 0)) for k in kids
           if wanted[k["name"]] != found.get(k["name"], 0)}
    if off or set(found) - {k["name"] for k in kids}:
        raise JobError(f"split count mismatch (expected, written): {off}")
    return SplitResult(shard_map.unionByName(children), got)


def merge(shards: dict[str, DataFrame], spec: TableSpec, out_path: str, tables_allowed=None,
          hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K2/K3: merge shards, write, and compare the sources' rows with the
    merged ones (C8).  Returns the validation report.

    With one sharding key no primary key may be on two shards (C5).  A row of
    a multi-key table may stand on several shards; its copies count once (as
    often as on the shard that has it most often).  Shards that hold
    *different* rows under one primary key are refused."""
    if tables_allowed is not None and spec.name not in tables_allowed:
        raise JobError(f"table {spec.name} not in the allow-list")
    pk = list(spec.pk)
    cols = next(iter(shards.values())).columns
    source = reduce(lambda a, b: a.unionByName(b), [
        d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("node"),
                                                   F.lit(spec.name).alias("table_name"), "n")
        for name, d in shards.items()])
    if len(spec.keys) > 1:
        # rows with the shards they stand on by number; stored, as three steps read them
        tagged = union_shards({i: d for i, d in enumerate(shards.values())}, tag="__s")
        # one exchange serves both counts (not by fractions, which are normalised when they are grouped)
        spread = [c for c, kind in tagged.dtypes if c != "__s" and not any(x in kind for x in ("float", "double"))] or cols
        per = tagged.repartition(*spread).groupBy(*cols, "__s").agg(F.count(F.lit(1)).alias("__n"))
        most = per.groupBy(*cols).agg(F.max("__n").alias("__most"), F.sum("__n").alias("__all"),
                                      F.min("__s").alias("__first"), F.max("__s").alias("__last"))
        held = scratch_path(most.sparkSession, f"merge-{spec.name}-rows")
        most.write.parquet(held)
        most = most.sparkSession.read.schema(most.schema).parquet(held)
        h = row_hash(cols)
        clash = (most.groupBy(*pk).agg(F.min(h).alias("h0"), F.max(h).alias("h1"), F.min("__first").alias("s0"),
                                       F.max("__last").alias("s1")).filter("h0 <> h1 and s0 <> s1"))
        if not clash.isEmpty():
            raise JobError("shards hold different rows under one primary key")
        u = most.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__most").cast("int")))).select(*cols)
        shared = most.agg(F.coalesce(F.sum(F.col("__most") - F.col("__all")), F.lit(0)).alias("n")).select(
            F.lit("(shared rows)").alias("node"), F.lit(spec.name).alias("table_name"), "n")
        source = source.unionByName(shared)
    else:
        if not duplicate_keys(shards, pk).isEmpty():
            raise JobError("duplicate keys between shards; resolve before merging")
        u = reduce(lambda a, b: a.unionByName(b), shards.values())

    def write(rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(out_path)
        return rows.sparkSession.read.schema(rows.schema).parquet(out_path)

    merged = step(hooks, "merge_write", write, u).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(spec.name).alias("table_name"), "n")
    return merge_count_validation(source, merged)


def rename(spark: SparkSession, a: str, b: str) -> None:
    """One rename through Hadoop's file system; it must succeed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(a).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(a), path(b)):
        raise JobError(f"cannot rename {a} to {b}")


def swap_in(spark: SparkSession, live: str) -> None:
    """``<live>.new`` becomes the live table, which is kept as ``<live>.old``."""
    if not exists(spark, f"{live}.new"):
        raise JobError(f"nothing to swap in for {live}")
    if exists(spark, f"{live}.old"):
        raise JobError(f"{live}.old is still there: remove the table kept by the last job first")
    rename(spark, live, f"{live}.old")
    rename(spark, f"{live}.new", live)


def do_cutover(shard_map: DataFrame, cutover_id: int, pool: str, df: DataFrame | None = None,
               schema_path: str | None = None, hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K4: B10 on the map, plus the schema copy for the new last shard (A9:
    an empty table with the same schema)."""
    if df is not None and schema_path is not None:
        df.limit(0).write.mode("overwrite").parquet(schema_path)
    return step(hooks, "cutover_map", lambda m: cutover(m, cutover_id, pool), shard_map)


def split_cleanup(shard_map: DataFrame, parent: str, children_data: dict[str, DataFrame],
                  spec: TableSpec, hooks: Hooks = NO_HOOKS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """K5: prune each child to its range (B4) and move the states: children
    needs_cleanup -> ready, the deprecated parent -> recycle.  Guard: the
    parent must be deprecated and every child needs_cleanup."""
    kids = shard_map.filter(F.col("parent") == parent)
    bad = kids.filter(F.col("state") != "needs_cleanup").count() + \
        shard_map.filter((F.col("name") == parent) & (F.col("state") != "deprecated")).count()
    if bad:
        raise JobError("cleanup needs a deprecated parent and needs_cleanup children")
    pruned = {}
    for r in kids.select("name", "min_id", "max_id").collect():  # one row per child shard
        prune = lambda d, r=r: prune_to_range(d, spec.keys, r["min_id"], r["max_id"])
        pruned[r["name"]] = step(hooks, "cleanup_prune", prune, children_data[r["name"]])
    st = (F.when(F.col("name") == parent, F.lit("recycle"))
          .when(F.col("parent") == parent, F.lit("ready")).otherwise(F.col("state")))
    par = F.when(F.col("parent") == parent, F.lit(None).cast("string")).otherwise(F.col("parent"))
    return shard_map.withColumn("state", st).withColumn("parent", par), pruned


def rebuild(df: DataFrame, spec: TableSpec, out_path: str, partitions: int | None = None,
            hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K6: compaction: range-partition by the sharding key, sort within
    partitions, write a new folder and verify the count (C7)."""
    key = spec.keys[0] if spec.keys else spec.first_pk_col
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the primary key breaks ties, so one hot key value still spreads over
    # several range partitions
    cols = [key, *[c for c in spec.pk if c != key]]

    def write(rows: DataFrame) -> DataFrame:
        rows.repartitionByRange(n, *cols).sortWithinPartitions(*(spec.order_by or cols)).write.mode("overwrite").parquet(out_path)
        return rows.sparkSession.read.schema(df.schema).parquet(out_path)

    written = step(hooks, "rebuild_write", write, df)
    exp = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(spec.name).alias("table_name"), "n")
    got = written.agg(F.count(F.lit(1)).alias("n")).select(F.lit(spec.name).alias("table_name"), "n")
    return count_check(exp, got)


def rebuild_table(spark: SparkSession, live: str, spec: TableSpec, partitions: int | None = None,
                  hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K6 on a stored table: :func:`rebuild` into ``<live>.new`` and, if the
    counts match, the swap."""
    df = spark.read.parquet(live)
    report = rebuild(df, spec, f"{live}.new", partitions, hooks).collect()   # one row
    if not all(r["match"] for r in report):
        raise JobError(f"rebuild of {live} lost rows; the live table is unchanged")
    swap_in(spark, live)
    return spark.createDataFrame(report)


def schema_change(table: DataFrame, alter, out_path: str, shard_col: str = "shard",
                  preflight: str | None = None, dry_run: bool = False,
                  shards: DataFrame | None = None, hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K7: apply ``alter`` (DataFrame -> DataFrame, column-level) to a
    sharded table.  The preflight shard is altered and verified first; if it
    passes, the rest follow in one pass.  Verification per shard: row count
    and a checksum of the columns ``alter`` left unchanged, before against what
    was written (``dry_run``: what would be), as one grouped aggregate (not one
    scan per shard).  Written partitioned by shard.  Returns one row per shard;
    with ``shards`` (a one-column list of names) shards holding no rows are
    reported too, and shards that are not in the list still are.  A shard that
    is empty on one side only is never ``ok``.  A folder that holds anything is
    refused: a second run would write the rows again."""
    if not dry_run and names_in(table.sparkSession, out_path):
        raise JobError(f"{out_path} is not empty")
    new_all = alter(table)
    kept = [c for c in table.columns if c != shard_col and c in new_all.columns and
            table.schema[c].dataType == new_all.schema[c].dataType]

    def verify(before: DataFrame, after: DataFrame) -> DataFrame:
        def side(d, i):
            h = row_hash(kept).cast("decimal(38,0)") if kept else F.lit(0).cast("decimal(38,0)")
            return d.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).withColumn("i", F.lit(i))

        of = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
        j = side(before, 0).unionByName(side(after, 1)).groupBy(shard_col).agg(
            F.coalesce(of("n", 0), F.lit(0)).cast("long").alias("rows_before"),
            F.coalesce(of("n", 1), F.lit(0)).cast("long").alias("rows_after"),
            of("h", 0).alias("h0"), of("h", 1).alias("h1"))
        return j.select(shard_col, "rows_before", "rows_after",
                        ((F.col("rows_before") == F.col("rows_after")) & F.col("h0").eqNullSafe(F.col("h1"))).alias("ok"))

    def run(mine, phase: str) -> DataFrame:
        part = table.filter(mine)

        def write(rows: DataFrame) -> DataFrame:
            if dry_run:
                return rows
            rows.write.mode("append").partitionBy(shard_col).parquet(out_path)
            return part.sparkSession.read.schema(rows.schema).parquet(out_path).filter(mine)

        new = step(hooks, "alter_shards", write, alter(part))
        return verify(part, new).withColumn("phase", F.lit(phase))

    if preflight is None:
        preflight = table.select(F.min(shard_col)).first()[0]
    is_first = F.col(shard_col).eqNullSafe(F.lit(preflight))
    report = [shard_col, "phase", "rows_before", "rows_after", "ok"]
    first = run(is_first, "preflight").select(*report)
    if not first.filter(~F.col("ok")).isEmpty():
        return first
    out = first.unionByName(run(~is_first, "rest").select(*report))
    if shards is None:
        return out
    names = shards.select(F.col(shards.columns[0]).alias(shard_col)).distinct()
    found = names.join(out.withColumn("__seen", F.lit(True)), shard_col, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    # a name without any row on either side is empty and unchanged
    return found.select(shard_col, F.coalesce("phase", F.when(is_first, "preflight").otherwise("rest")).alias("phase"),
                        zero("rows_before"), zero("rows_after"),
                        F.when(F.col("__seen"), F.col("ok")).otherwise(F.lit(True)).alias("ok"))


class TableAlter:
    """K7 on a stored table, with the states of an alter: ``idle`` ->
    ``being_altered`` -> (``needs_rename`` when the rename is delayed) ->
    ``idle``.  The altered copy is ``<live>.new``; a failed verification leaves
    the live table as it is and drops back to ``idle`` with the copy kept for
    inspection.  After the rename the former table is ``<live>.old``."""

    def __init__(self, spark: SparkSession, live: str, shard_col: str = "shard"):
        self.spark, self.live, self.shard_col, self.state = spark, live, shard_col, "idle"

    def run(self, alter, delayed_rename: bool = False, preflight: str | None = None, hooks: Hooks = NO_HOOKS) -> DataFrame:
        if self.state != "idle":
            raise JobError(f"{self.live} cannot be altered: it is {self.state}")
        if exists(self.spark, f"{self.live}.new"):
            raise JobError(f"{self.live}.new of an earlier alter is still there")
        self.state = "being_altered"
        try:
            table = self.spark.read.parquet(self.live)
            report = schema_change(table, alter, f"{self.live}.new", self.shard_col, preflight, hooks=hooks).collect()  # per shard
        finally:
            self.state = "idle"
        if not all(r["ok"] for r in report):
            raise JobError("schema change failed its verification: " + ", ".join(
                f"{r[self.shard_col]} {r['rows_before']} -> {r['rows_after']}" for r in report if not r["ok"]))
        self.state = "needs_rename"
        if not delayed_rename:
            self.rename()
        return self.spark.createDataFrame(report, f"{self.shard_col} string, phase string, rows_before long, "
                                                  "rows_after long, ok boolean")

    def rename(self) -> None:
        """Swap the verified copy in."""
        if self.state != "needs_rename":
            raise JobError(f"{self.live} has no altered copy to rename: it is {self.state}")
        swap_in(self.spark, self.live)
        self.state = "idle"


def capacity_plan(hist: DataFrame, now: int, autoinc: DataFrame | None = None,
                  day: str | None = None, snapshot: DataFrame | None = None, history_path: str | None = None,
                  hooks: Hooks = NO_HOOKS) -> dict[str, DataFrame]:
    """K8: the capacity report as named DataFrames.

    ``snapshot`` is the usage just measured: it is appended to the stored
    history at ``history_path`` first (A12), which is then the history of the
    report (``hist`` fills a store that is still empty)."""
    if snapshot is not None:
        spark = hist.sparkSession
        if not exists(spark, history_path):
            store_snapshot(hist, history_path)
        store_snapshot(snapshot, history_path)
        hist = spark.read.schema(hist.schema).parquet(history_path)
    hist = step(hooks, "plan_history", lambda d: d, hist)
    h = dedup_history(hist)
    seg = segmentify(h, deduped=True)
    growth = decaying_growth(seg)
    usage = current_usage(hist)
    blocks = outlier_blocks(h, now)
    out = {"segments": seg, "growth": growth, "days_left": days_left(usage, growth),
           "day_over_day": day_over_day(seg), "total": total_consumed(usage, growth),
           "thresholds": threshold_buckets(usage), "outlier_blocks": blocks,
           "outlier_runs": outlier_runs(blocks), "outlier_spikes": outlier_spikes(blocks)}
    if autoinc is not None and day is not None:
        out["autoinc_top5"] = top_exhaustion(autoinc, day)
    return out


def consistency_check(a: DataFrame, b: DataFrame, key: str, lo: int, hi: int, chunks: int,
                      hooks: Hooks = NO_HOOKS) -> DataFrame:
    """K9: chunk checksums of two copies (C10); only the differing chunks get
    a row-level diff (G3).  Rows outside ``[lo, hi]`` and rows without a key
    have chunks of their own, so nothing escapes the check."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(a.sparkSession)
    cols = a.columns
    b = step(hooks, "check_copy", lambda d: d, b)
    # the differing chunks are few; materialise them once (both sides read them)
    bad = checksum_diff(a, b, key, lo, hi, chunks, cols).select(
        F.col("chunk_min").alias("__lo"), F.col("chunk_max").alias("__hi")).checkpoint(eager=True)

    def only_bad(d):
        c = with_chunk(d, key, lo, hi, chunks)
        same = c["chunk_min"].eqNullSafe(bad["__lo"]) & c["chunk_max"].eqNullSafe(bad["__hi"])
        return c.join(bad, same, "left_semi").select(*cols)
    return result_set_diff(only_bad(a), only_bad(b))


def global_rowcount_report(tables: dict[str, tuple[DataFrame, TableSpec]], shard_map: DataFrame,
                           functional: dict[str, tuple[DataFrame, TableSpec]], hooks: Hooks = NO_HOOKS) -> DataFrame:
    """D2 over sharded and functional tables."""
    from keyspan.operators.counts import functional_counts
    parts = [shard_counts(d, s, shard_map) for d, s in tables.values()]
    parts += [functional_counts(d, s) for d, s in functional.values()]
    return step(hooks, "count_rows", lambda d: d, global_rowcount(parts))
