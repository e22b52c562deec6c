"""Many ordered change streams merged into one table.

Each source is a directory of Parquet change files read by its own
Structured Streaming query (file source, available-now trigger) with its own
checkpoint, so sources can be added, removed, paused and resumed one at a
time -- Spark does not allow changing the set of sources of one running
query against the same checkpoint.

What has been merged outlives the process: a manifest of sources, positions
and stop point is versioned beside the sinks (:mod:`keyspan.streaming.manifest`).

Sinks are append-only and exactly-once (file sink + checkpoint), one folder
per source.  The merged table is *merge-on-read*: the latest change per key
(largest sequence) over all source folders, one ``max_by`` aggregate with
map-side combine.  No batch rewrites the whole target, so the cost per batch
is the batch, not the table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keyspan.operators.audit import row_hash
from keyspan.sources.files import exists
from keyspan.streaming.manifest import ACTIVE, PAUSED, REMOVED, Manifest, Source

# --- Fixed values ---------------------------------------------------------------
REPLAY_TIMEOUT_S = 3600
# ---------------------------------------------------------------------------------


class UnknownSource(KeyError):
    pass


class DuplicateSource(ValueError):
    pass


class PositionsDiffer(RuntimeError):
    """Sources that were to stop at one position stand at different ones."""


@dataclass
class StreamMerger:
    """All state lives under ``root``: the sinks and checkpoints of Spark, and a
    versioned manifest of the sources (paths, active / paused / removed,
    positions) and of the stop point.  A new object on the same folder, in any
    process, goes on where the last one stopped; every change of the manifest is
    a new version, so of two writers one fails instead of undoing the other."""
    spark: SparkSession
    schema: T.StructType
    pk: list[str]
    seq: str
    root: str                                   # shared folder: sinks, checkpoints, manifest
    _queries: dict[str, StreamingQuery] = field(default_factory=dict)

    # --- state ---------------------------------------------------------------
    def manifest(self) -> Manifest:
        """The newest version."""
        return Manifest.load(self.spark, self.root)

    @property
    def sources(self) -> dict[str, str]:
        """The sources that still send, active or paused."""
        return {n: s.path for n, s in self.manifest().sources.items() if s.state != REMOVED}

    @property
    def paused(self) -> set[str]:
        return {n for n, s in self.manifest().sources.items() if s.state == PAUSED}

    @property
    def stop_at(self):
        """I4: readers see changes up to this sequence (None: all)."""
        return self.manifest().stop_at

    def positions(self) -> dict[str, object]:
        """The last committed position of every source, removed ones too."""
        return {n: s.position for n, s in self.manifest().sources.items()}

    # --- source management -------------------------------------------------
    def add_source(self, name: str, path: str) -> None:
        """A removed source may be added again; it goes on behind what it sent."""
        m = self.manifest()
        if name in m.sources and m.sources[name].state != REMOVED:
            raise DuplicateSource(f"source {name} already merged")
        before = m.sources.get(name)
        m.sources[name] = Source(path, ACTIVE, before.position if before else None)
        m.commit(self.spark, self.root)

    def remove_source(self, name: str) -> None:
        """The source sends no more; what it has applied stays."""
        self._set(name, REMOVED)

    def pause(self, name: str) -> None:
        self._set(name, PAUSED)

    def resume(self, name: str) -> None:
        self._set(name, ACTIVE)

    def _set(self, name: str, state: str) -> None:
        m = self.manifest()
        if name not in m.sources or m.sources[name].state == REMOVED:
            raise UnknownSource(name)
        if state != ACTIVE:
            self._stop(name)
        m.sources[name].state = state
        m.commit(self.spark, self.root)

    def _stop(self, name: str) -> None:
        q = self._queries.pop(name, None)
        if q is not None and q.isActive:
            q.stop()

    def sink_path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/sink/source={name}"

    def checkpoint_path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/checkpoints/{name}"

    # --- running ---------------------------------------------------------------
    def stream(self, name: str) -> DataFrame:
        """The change stream of one source."""
        return self.spark.readStream.schema(self.schema).parquet(self.sources[name]).withColumn("source", F.lit(name))

    def run_available_now(self, until_seq=None, timeout_s: float | None = None) -> dict[str, dict]:
        """Process everything currently in every active source, then stop and
        commit the positions.  Returns the last progress of each source's query.

        ``until_seq`` stops all sources at one position (I4).  The changes
        behind it are taken in as well, as a file may straddle it, but
        ``changes`` and ``merged`` only show those up to the position until
        the next run without one.  The stop point is committed before any
        change is taken in, so a run that dies shows nothing behind it.  After
        ``timeout_s`` the queries are stopped and ``TimeoutError`` is raised;
        what they have committed stays."""
        m = self.manifest()
        names = [n for n, s in m.sources.items() if s.state == ACTIVE]
        if m.stop_at != until_seq:
            m.stop_at = until_seq
            m.commit(self.spark, self.root)
        for name in names:
            self._queries[name] = (self.stream(name).writeStream.format("parquet")
                                   .option("path", self.sink_path(name))
                                   .option("checkpointLocation", self.checkpoint_path(name))
                                   .trigger(availableNow=True).start())
        out, late = {}, []
        ends = None if timeout_s is None else time.monotonic() + timeout_s
        for name in names:
            q = self._queries[name]
            if ends is None:
                q.awaitTermination()
            elif not q.awaitTermination(max(0.001, ends - time.monotonic())):
                late.append(name)
            out[name] = q.lastProgress or {}
            self._stop(name)
        self._commit_positions(names)
        if late:
            raise TimeoutError(f"sources {late} did not finish within {timeout_s} s")
        return out

    def _commit_positions(self, names: list[str]) -> None:
        found = self._applied(self._sinks(names)).groupBy("source").agg(F.max(self.seq).alias("p")).collect()   # a row a source
        m = self.manifest()
        for r in found:
            m.sources[r["source"]].position = r["p"]
        if m.changed:
            m.commit(self.spark, self.root)

    def replay_together(self, names: list[str] | None = None, until=None, timeout_s: float = REPLAY_TIMEOUT_S) -> object:
        """I4: stops sources at the same position and pauses them there.

        ``names`` default to all that still send, paused ones too; ``until``
        to the furthest position that one of them has committed.  Each runs up
        to there (``TimeoutError`` after ``timeout_s``); then every source must
        have taken in whatever its input holds up to that position, or
        ``PositionsDiffer`` is raised.  Returns the position."""
        m = self.manifest()
        names = sorted(names or self.sources)
        if missing := [n for n in names if n not in m.sources or m.sources[n].state == REMOVED]:
            raise UnknownSource(missing)
        reached = [m.sources[n].position for n in names if m.sources[n].position is not None]
        until = max(reached, default=None) if until is None else until
        if until is None:
            raise ValueError("no source has a position yet: name one")
        for n, s in m.sources.items():
            if s.state != REMOVED:
                s.state = ACTIVE if n in names else PAUSED
        m.commit(self.spark, self.root)
        try:
            self.run_available_now(until, timeout_s)
        finally:
            m = self.manifest()
            for n in names:
                m.sources[n].state = PAUSED
            m.commit(self.spark, self.root)
        if behind := self.behind(names, until):
            raise PositionsDiffer(f"not at {until}: {behind}")
        return until

    def behind(self, names: list[str], until) -> dict[str, int]:
        """How many changes up to a position the sources' inputs hold beyond
        those taken in: {} if all stand there.  One aggregate over the sequence
        column of inputs and sinks."""
        here = F.col(self.seq) <= until
        read = reduce(lambda a, b: a.unionByName(b), [
            self.spark.read.schema(self.schema).parquet(self.manifest().sources[n].path).where(here)
            .select(F.lit(n).alias("source"), F.lit(1).alias("n")) for n in names])
        done = self._sinks(names)
        if done is not None:
            read = read.unionByName(done.where(here).select("source", F.lit(-1).alias("n")))
        return {r["source"]: r["n"] for r in read.groupBy("source").agg(F.sum("n").alias("n")).where("n <> 0").collect()}

    # --- reading -----------------------------------------------------------------
    @property
    def sink_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("source", T.StringType())])

    def _sinks(self, names) -> DataFrame | None:
        """The committed changes of sources, each sink folder read through its
        own commit log, so partial files are never seen."""
        parts = [self.spark.read.schema(self.sink_schema).parquet(self.sink_path(n))
                 for n in names if exists(self.spark, self.sink_path(n))]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else None

    def _applied(self, found: DataFrame | None) -> DataFrame:
        return self.spark.createDataFrame([], self.sink_schema) if found is None else found

    def changes(self) -> DataFrame:
        """Every committed change of every source, removed ones too, up to the
        position of a bounded replay."""
        m = self.manifest()
        found = self._applied(self._sinks(m.sources))
        return found if m.stop_at is None else found.filter(F.col(self.seq) <= m.stop_at)

    def merged(self) -> DataFrame:
        """The latest change per key (largest ``seq``; of equal ones the
        largest source name, then the largest row hash; a re-delivered change
        is the same row and collapses).  Exactly one row per key, the same
        whatever the order in which the changes came."""
        return latest_per_key(self.changes(), self.pk, self.seq, ["source"])

    def progress(self, now_ts=None) -> DataFrame:
        """Per source, rows applied, last sequence, last event time and
        lag (seconds behind ``now_ts``)."""
        return source_progress(self.changes(), "source", self.seq, "ts", now_ts)

    def status(self) -> dict[str, bool]:
        """All / any source query running (driver-side metadata)."""
        active = [q.isActive for q in self._queries.values()]
        return {"all_running": bool(active) and all(active), "any_running": any(active)}


def latest_per_key(changes: DataFrame, pk: list[str], seq: str, ties: list[str] | None = None) -> DataFrame:
    """The row of the largest ``seq`` of each key.  Equal sequences are decided
    by the columns ``ties`` and then by the row's hash, never by arrival."""
    cols = [c for c in changes.columns if c not in pk]
    order = F.struct(F.col(seq), *[F.col(c) for c in ties or ()], row_hash(cols))
    pick = F.max_by(F.struct(*[F.col(c) for c in cols]), order)
    return changes.groupBy(*pk).agg(pick.alias("__r")).select(*pk, *[F.col(f"__r.{c}").alias(c) for c in cols])


def source_progress(changes: DataFrame, source: str, seq: str, ts: str, now_ts=None) -> DataFrame:
    g = changes.groupBy(source).agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                    F.max(seq).alias("position"), F.max(ts).alias("last_ts"))
    if now_ts is not None:
        g = g.withColumn("lag_seconds", F.lit(now_ts).cast("long") -
                         F.unix_seconds(F.col("last_ts").cast("timestamp")))
    return g


def write_change_sources(df: DataFrame, by, root: str, order: str) -> dict[str, str]:
    """Fixture helper: lay out one Parquet directory per source value of the
    ``by`` expression (e.g. ``user_id % 3``), rows ordered by ``order``.
    One write, partitioned by the source column."""
    tagged = df.withColumn("__src", by.cast("string"))
    # every task writes its own slice of each source (no per-source task)
    tagged.sortWithinPartitions("__src", order).write.mode("overwrite").partitionBy("__src").parquet(root)
    # the sources are the folders that the write made, a handful of names
    jvm = df.sparkSession.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    folders = [x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory()]
    names = sorted(f.removeprefix("__src=") for f in folders if f.startswith("__src="))
    return {n: f"{root.rstrip('/')}/__src={n}" for n in names}


def furthest_position(positions: DataFrame, pool: str, node: str, fileno: str, pos: str) -> DataFrame:
    """I4/I8: per pool the node with the furthest ``(file number, position)``
    and that position -- the target the others replay to.  One aggregate."""
    key = F.struct(F.col(fileno), F.col(pos))
    return positions.groupBy(pool).agg(F.max_by(F.col(node), key).alias("furthest_node"),
                                       F.max(key).alias("__p")) \
        .select(pool, "furthest_node", F.col(f"__p.{fileno}").alias(fileno), F.col(f"__p.{pos}").alias(pos))


def replica_roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, root)``: the top of every node's chain of parents, by pointer
    doubling (log2 of the longest chain).  A node without a parent is its own
    root; a parent that is no node itself ends the chain.  A circle raises
    ``ValueError``: no chain is longer than there are nodes."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(nodes.sparkSession)
    at = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).distinct()
    below = F.col("up").isNotNull() & (F.col("up") != F.col("node"))
    at = at.select("node", F.coalesce("up", "node").alias("root"), below.alias("moving"), below.alias("below")).checkpoint(eager=True)
    for _ in range(at.count().bit_length() + 2):
        if at.where("moving").isEmpty():
            if not at.where("below and node = root").isEmpty():       # a pointer that came round to its own node
                break
            return at.select("node", "root")
        on = at.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("__up"))
        at = at.join(on, "root", "left").select("node", F.coalesce("__up", "root").alias("root"),
                                                F.col("__up").isNotNull().alias("moving"), "below").checkpoint(eager=True)
    raise ValueError("the parents run in a circle")


def furthest_replicas(nodes: DataFrame, pool: str, node: str, parent: str, fileno: str, pos: str) -> DataFrame:
    """I8: per pool and root the node with the furthest ``(file number,
    position)``, the number of nodes that stand there and of those behind, and
    whether the pool's positions are ``comparable`` at all: positions count
    within one root only, so a pool with nodes under several roots has a row for
    each and none of them is the furthest of the pool.  Nodes without a position
    are counted as ``unknown``."""
    roots = replica_roots(nodes, node, parent)
    at = nodes.join(roots.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node")).drop("__node")
    known = F.col(fileno).isNotNull() & F.col(pos).isNotNull()
    key = F.when(known, F.struct(F.col(fileno), F.col(pos)))
    most = at.groupBy(pool, "root").agg(
        F.max(key).alias("__p"), F.min(F.when(known, F.struct((-F.col(fileno)).alias("f"), (-F.col(pos)).alias("p"), F.col(node).alias("n"))))
        .alias("__best"), F.count(F.lit(1)).alias("nodes"), F.count_if(~known).alias("unknown"))
    per = at.select(pool, "root", key.alias("__k")).groupBy(pool, "root", "__k").agg(F.count(F.lit(1)).alias("equal"))
    top = most.join(per.where("__k is not null").select(F.col(pool).alias("__pool"), F.col("root").alias("__root"),
                                                        F.col("__k"), "equal"),
                    F.col(pool).eqNullSafe(F.col("__pool")) & (F.col("root") == F.col("__root")) & (F.col("__p") == F.col("__k")), "left")
    several = most.groupBy(pool).agg(F.count(F.lit(1)).alias("__roots")).withColumnRenamed(pool, "__in")
    out = top.join(several, F.col(pool).eqNullSafe(F.col("__in")))
    return out.select(pool, "root", F.col("__best.n").alias("furthest_node"), F.col(f"__p.{fileno}").alias(fileno),
                      F.col(f"__p.{pos}").alias(pos), F.coalesce("equal", F.lit(0)).alias("there"),
                      (F.col("nodes") - F.col("unknown") - F.coalesce("equal", F.lit(0))).alias("behind"), "unknown",
                      (F.col("__roots") == 1).alias("comparable"))


def stream_backfill(snapshot: DataFrame, changes: DataFrame, pk: list[str], seq: str, snapshot_seq, root: str,
                    keep=None) -> DataFrame:
    """I6 as a stream: the changes after the offset that the snapshot recorded
    are taken from a streaming source and applied to it batch by batch, each
    batch's last change per key in a folder of its batch number, written over
    if the batch runs again.  A second call on the same ``root`` goes on behind
    the last committed batch.  Returns the table as it stands: the snapshot with
    the changes, pruned by ``keep`` (B4)."""
    spark = snapshot.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, pk, seq).write.mode("overwrite").parquet(f"{root.rstrip('/')}/applied/batch={number}")

    q = (changes.where(F.col(seq) > snapshot_seq).writeStream.foreachBatch(upsert)
         .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    applied = f"{root.rstrip('/')}/applied"
    tail = (spark.read.schema(changes.schema).parquet(applied).select(*changes.columns) if exists(spark, applied)
            else spark.createDataFrame([], changes.schema))
    merged = latest_per_key(snapshot.unionByName(tail, allowMissingColumns=True), pk, seq)
    return merged if keep is None else merged.filter(keep)


def backfill_and_tail(snapshot: DataFrame, changes: DataFrame, pk: list[str], seq: str,
                      snapshot_seq, keep=None) -> DataFrame:
    """The snapshot taken at ``snapshot_seq`` plus every change after it,
    merged on key (later wins), then pruned with ``keep`` (a Column, e.g. B4's
    range predicate) to drop rows that came to the wrong shard."""
    tail = changes.filter(F.col(seq) > snapshot_seq)
    merged = latest_per_key(snapshot.unionByName(tail, allowMissingColumns=True), pk, seq)
    return merged if keep is None else merged.filter(keep)
