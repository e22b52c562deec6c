"""Capacity analytics on a storage-usage history.

History rows: ``(pool, ts epoch-seconds, id, total, used, available,
db_sizes)``.  ``now`` is always an explicit parameter.

* E1 ``dedup_history``      -- the later ``id`` wins per (pool, ts)
* E2 ``segmentify``         -- greedy anchor segmentation, by pointer doubling
* E3 ``decaying_growth``    -- 0.5/0.5 decaying average (closed form)
* E4 ``days_left``          -- days until the critical threshold
* E5 ``day_over_day``       -- n-th most recent segment rates
* E6-E9 ``outlier_blocks`` / ``outlier_runs`` / ``outlier_spikes``
* D6 ``total_consumed``, D7 block growth, D9 ``smallest_replica``,
  D10 ``threshold_buckets``, D8/F1 ``key_exhaustion`` / ``top_exhaustion``

Only E1/E2 touch every history row; everything after works on segments or
blocks, whose count is bounded by time span / period (days, 2-hour blocks),
not by data volume, so small per-pool windows there are safe.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.operators.rangejoin import BucketPlan, range_join
from keyspan.operators.scan import grouped_scan

# --- Fixed values (must equal the reference) ---------------------------------
GB_DIVISOR = 1024.0 * 1049000.0      # bytes_to_gb divides by 1024 * 1049000
MB_DIVISOR = 1024.0 * 1024.0
DAY = 60 * 60 * 24
CRITICAL_MOUNT = 0.85
WARNING_MOUNT = 0.80
DECAY = 0.5
SEGMENT_SLACK = 60                    # a segment closes at ts > anchor + period - 60
OUTLIER_DAYS = 3                      # look back 3 days
BLOCK_STEP = 60 * 60 * 2              # blocks start every 2 hours
BLOCK_WIDTH = 60 * 60 * 2 + 120       # and span 7320 s, closed at both ends
BLOCK_MIN_TAIL = 60 * 62              # last block starts before now - 3720 s
BASELINE_DAYS = (7, 14, 21, 28)
BASELINE_DROP = 5.0
SUSTAINED_FACTOR = 2.2
SPIKE_FACTOR = 5.0
ZERO_MEAN_RATE = 1048576              # 1 MiB/s when the baseline mean is 0
RUN_MIN_BLOCKS = 3                    # a run needs more than 3 blocks
DOD_OFFSETS = (0, 1, 2, 7, 14)
TYPE_MAX = {"tinyint": 2 ** 8, "smallint": 2 ** 16, "mediumint": 2 ** 24,
            "int": 2 ** 32, "bigint": 2 ** 64}
# ------------------------------------------------------------------------------

SPARK_INT_TYPES = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int",
                   T.LongType: "bigint"}


def bytes_to_gb(c: Column) -> Column:
    return c.cast("double") / F.lit(GB_DIVISOR)


def bytes_to_mb(c: Column) -> Column:
    return c.cast("double") / F.lit(MB_DIVISOR)


def per_day(c: Column) -> Column:
    return c * F.lit(DAY)


def per_week(c: Column) -> Column:
    return c * F.lit(DAY * 7)


def per_month(c: Column) -> Column:
    return c * F.lit(DAY * 30)


BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def humanize_bytes(c: Column) -> Column:
    """Binary-prefixed size as ``"<value> <unit>"``, value with 2 decimals."""
    x = F.abs(c.cast("double"))
    out = F.format_string("%.2f " + BYTE_UNITS[0], c.cast("double"))
    for i in range(1, len(BYTE_UNITS)):
        out = F.when(x >= F.lit(float(1024 ** i)),
                     F.format_string("%.2f " + BYTE_UNITS[i],
                                     c.cast("double") / F.lit(float(1024 ** i)))).otherwise(out)
    return out


# --- sources -----------------------------------------------------------------

def history_from_events(events: DataFrame, total=None) -> DataFrame:
    """The capacity-history fixture derived from ``events``: pool =
    event_type, ts = epoch seconds, id = event_id, used = running sum of
    ``round(value*100) * 10000`` in (ts, event_id) order per pool (exact
    integers).  ``total`` defaults to 115 % of the largest final usage (a
    scalar subquery, so it scales with the data)."""
    e = events.select(F.col("event_type").alias("pool"), F.col("ts").alias("__ts"),
                      F.col("event_id").alias("id"),
                      (F.round(F.col("value") * 100).cast("long") * 10000).alias("__inc"))
    h = grouped_scan(e, ["pool"], ["__ts", "id"], "__inc", "sum", "used")
    if total is None:
        total = e.groupBy("pool").agg(F.sum("__inc").alias("s")) \
            .select((F.max("s") * 115).cast("long") / 100).scalar()
        total = F.floor(total).cast("long")
    else:
        total = F.lit(int(total))
    out = h.select("pool", F.unix_seconds(F.col("__ts").cast("timestamp")).alias("ts"), "id",
                   total.alias("total"), F.col("used").cast("long").alias("used"),
                   (total - F.col("used")).cast("long").alias("available"),
                   F.col("used").cast("long").alias("db_sizes"))
    # a derived table read by several steps: materialise it once in the
    # shared checkpoint folder
    return out.checkpoint(eager=True)


# --- E1 -----------------------------------------------------------------------

def dedup_history(hist: DataFrame) -> DataFrame:
    """One row per (pool, ts); the row with the largest ``id`` supplies
    the values, ``first_id`` keeps the smallest id (insertion position).
    An aggregate with map-side combine, so a hot pool is spread out."""
    vals = [c for c in hist.columns if c not in ("pool", "ts", "id")]
    s = F.max_by(F.struct(*[F.col(c) for c in vals]), F.col("id"))
    return (hist.groupBy("pool", "ts")
            .agg(F.min("id").alias("first_id"), F.max("id").alias("id"), s.alias("__v"))
            .select("pool", "ts", "first_id", "id", *[F.col(f"__v.{c}").alias(c) for c in vals]))


# --- E2 -----------------------------------------------------------------------

PIECE = "pool string, entry long, last long, lo long, first boolean"
ANCHOR = "pool string, ts long, used long"
BLOCK_PERIODS = 8            # periods of a pool that always lie in one partition


def _runs(batches, names: list[str]):
    """Sorted record batches -> (pool, column arrays) of each pool's rows."""
    rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if rows is None or not rows.num_rows:
        return
    pools = rows.column("pool").combine_chunks().dictionary_encode()
    codes = pools.indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    arrays = [rows.column(n).to_numpy() for n in names]
    for a, b in zip(starts, np.r_[starts[1:], len(codes)]):
        yield pools.dictionary[codes[a]].as_py(), [x[a:b] for x in arrays]


def _last_anchors(ts: np.ndarray, at: np.ndarray, gap: int) -> np.ndarray:
    """Where the chains that start at the positions ``at`` have their last anchors."""
    while True:
        nxt = np.searchsorted(ts, ts[at] + gap, side="right")
        inside = nxt < len(ts)
        if not inside.any():
            return at
        at = np.where(inside, nxt, at)


def _entry_pieces(gap: int):
    """A partition's rows -> what it does to a chain that comes in: a step
    function from the time from which the chain looks for its next anchor to the
    last anchor that it reaches inside, one row (``entry``: the last time of
    the step) for each step.

    Only the first pool of a partition can come from another one, by a row of
    its first period; all other pools start at their first row, and only the
    last one of them goes on elsewhere."""
    def run(batches):
        out = [[] for _ in range(5)]
        runs = [(pool, ts) for pool, (ts,) in _runs(batches, ["ts"])]
        for i, (pool, ts) in enumerate(runs):
            if i not in (0, len(runs) - 1):
                continue
            # a chain that comes from outside enters no later than at the first row a whole gap behind the first one
            n = 1 if i else min(int(np.searchsorted(ts, ts[0] + gap, side="right")), len(ts) - 1) + 1
            last = _last_anchors(ts, np.arange(n), gap)
            ends = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
            for x, v in zip(out, (np.repeat(pool, len(ends)).tolist(), ts[ends], ts[last[ends]], np.repeat(ts[0], len(ends)),
                                  np.repeat(i == 0, len(ends)))):
                x.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (
            pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["pool", "entry", "last", "lo", "first"])
    return run


def _anchors_inside(gap: int):
    """A partition's rows, with the time (``entry``) from which the chain of
    its first pool looks for an anchor, NULL if it passes by -> the anchors."""
    def run(batches):
        out = [[], [], []]
        for i, (pool, (ts, used, entry)) in enumerate(_runs(batches, ["ts", "used", "entry"])):
            at = 0
            if i == 0:
                if not np.isfinite(float(entry[0])):
                    continue
                at = int(np.searchsorted(ts, int(entry[0])))
            found = []
            while at < len(ts):
                found.append(at)
                at = int(np.searchsorted(ts, ts[at] + gap, side="right"))
            for x, v in zip(out, ([pool] * len(found), ts[found], used[found])):
                x.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                                          pa.array(out[2], pa.int64())], names=["pool", "ts", "used"])
    return run


def entry_pieces(ordered: DataFrame, gap: int) -> DataFrame:
    """The steps of every partition (see :func:`_entry_pieces`), with its id."""
    rows = ordered.select("pool", "ts").mapInArrow(_entry_pieces(gap), PIECE)
    return rows.withColumn("pid", F.spark_partition_id()).checkpoint(eager=True)


def _entered(pieces: DataFrame, gap: int) -> DataFrame:
    """(pid, entry): from when the chain that comes into a partition's first
    pool looks for an anchor; no row if it passes by.  The steps are composed
    by pointer doubling, log2 of the partitions that a pool lies on."""
    none = F.lit(None).cast("long")
    points = pieces.select("pool", F.col("entry").alias("v"), F.lit(1).alias("kind"), none.alias("entry"), F.col("entry").alias("to"))
    looks = pieces.select("pool", (F.col("last") + F.lit(gap + 1)).alias("v"), F.lit(0).alias("kind"), "entry", none.alias("to"))
    # the steps of a pool: a few a partition, whatever its rows
    w = Window.partitionBy("pool").orderBy(F.col("v").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    jump = (points.unionByName(looks).withColumn("to", F.min("to").over(w)).where("kind = 0 and to is not null")
            .select("pool", "entry", "to", F.col("v").alias("q")))
    start = pieces.groupBy("pool").agg(F.min("entry").alias("to"), F.min("lo").alias("q"))
    # one table for both, so that a round is one job: steps (entry -> to, q) and what is reached (entry NULL)
    both = jump.unionByName(start.withColumn("entry", none)).checkpoint(eager=True)
    for _ in range(64):
        jump = both.where("entry is not null")
        if jump.isEmpty():
            break
        on = jump.select("pool", F.col("entry").alias("to"), F.col("to").alias("to2"), F.col("q").alias("q2"))
        further = both.join(on, ["pool", "to"]).select("pool", "entry", F.col("to2").alias("to"), F.col("q2").alias("q"))
        both = both.where("entry is null").unionByName(further).checkpoint(eager=True)
    else:
        raise RuntimeError("segment chains longer than 2^64")
    reached = both.select("pool", F.col("to").alias("entry"), "q")
    return reached.join(pieces.where("first").select("pool", "entry", "pid"), ["pool", "entry"]).select("pid", F.col("q").alias("entry"))


def segment_anchors(h: DataFrame, period: int = DAY) -> DataFrame:
    """Anchors of the greedy segmentation with their ``used``: the first ts of
    a pool, then repeatedly the first ts > anchor + period - 60.

    The history (one row per pool and second) is range-partitioned by pool and
    blocks of ``BLOCK_PERIODS`` periods and sorted once; that is the only
    exchange of the rows.  Inside a partition chains are followed in memory.
    Across partitions only step functions travel: for the partition's first
    pool, which last anchor is reached by a chain that comes in during its first
    period.  Their steps are bounded by the seconds of a period and merge as
    chains do, so they do not grow with a partition's rows.  The second pass
    reads the partitions as they lie, with one number each."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(h.sparkSession)
    gap = period - SEGMENT_SLACK
    n = int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (h.select("pool", F.col("ts").cast("long").alias("ts"), F.col("used").cast("long").alias("used"))
               .repartitionByRange(n, F.col("pool"), F.floor(F.col("ts") / (BLOCK_PERIODS * period)))
               .sortWithinPartitions("pool", "ts").withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))
    # at most one row for each of the n partitions
    entered = F.broadcast(_entered(entry_pieces(ordered, gap), gap))
    return ordered.join(entered, "pid", "left").select("pool", "ts", "used", "entry").mapInArrow(_anchors_inside(gap), ANCHOR)


def segmentify(hist: DataFrame, period: int = DAY, deduped: bool = False) -> DataFrame:
    """Growth segments per pool ``(pool, seg_start, seg_end, seg_key,
    rate, seg_no)`` with rate = delta used / delta t (bytes per second).

    A trailing partial segment (last anchor to the pool's last ts) is
    emitted when it holds more than one row.  Only the anchors, one per
    period and pool, meet in a window."""
    from keyspan.session import checkpoint_dir
    checkpoint_dir(hist.sparkSession)
    h = (hist if deduped else dedup_history(hist)).checkpoint(eager=True)
    anchors = segment_anchors(h, period)
    last = h.groupBy("pool").agg(F.max(F.struct("ts", "used")).alias("__last"))
    w = Window.partitionBy("pool").orderBy("ts")
    end = F.coalesce(F.lead(F.struct("ts", "used")).over(w), F.when(F.col("__last.ts") > F.col("ts"), F.col("__last")))
    seg = anchors.join(last, "pool").withColumn("__end", end).withColumn("seg_no", F.row_number().over(w)) \
        .filter(F.col("__end").isNotNull())
    return seg.select(
        "pool", F.col("ts").alias("seg_start"), F.col("__end.ts").alias("seg_end"),
        F.concat_ws("-", F.col("ts").cast("string"), F.col("__end.ts").cast("string")).alias("seg_key"),
        ((F.col("__end.used") - F.col("used")).cast("double") /
         (F.col("__end.ts") - F.col("ts")).cast("double")).alias("rate"),
        "seg_no")


# --- E3 / E4 / E5 / D6 ----------------------------------------------------------

def decaying_growth(segments: DataFrame) -> DataFrame:
    """Per pool, the fold ``avg = 0.5*v + 0.5*avg`` seeded with the first
    value, in closed form: the k-th newest segment weighs 0.5^k and the
    oldest 0.5^(n-1).  Also the cumulative mean (the ``count`` variant)."""
    w = Window.partitionBy("pool").orderBy(F.col("seg_start").desc())
    s = segments.withColumn("__k", F.row_number().over(w)) \
        .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("pool")))
    weight = F.when(F.col("__k") == F.col("__n"), F.pow(F.lit(DECAY), F.col("__n") - 1)) \
        .otherwise(F.pow(F.lit(DECAY), F.col("__k")))
    return s.groupBy("pool").agg(F.sum(F.col("rate") * weight).alias("growth_rate"),
                                 F.avg("rate").alias("mean_rate"),
                                 F.count(F.lit(1)).alias("segments"))


def current_usage(hist: DataFrame) -> DataFrame:
    """Latest snapshot per pool (largest ts, then largest id)."""
    s = F.max_by(F.struct("total", "used", "available"), F.struct("ts", "id"))
    return hist.groupBy("pool").agg(s.alias("__c")) \
        .select("pool", "__c.total", "__c.used", "__c.available")


def smallest_replica(mounts: DataFrame) -> DataFrame:
    """Per pool, the mount stats of the copy with the smallest total
    (ties: the first listed).  ``mounts``: ``(pool, node, seq, total, used,
    available)``."""
    s = F.min_by(F.struct("total", "used", "available", "node"), F.struct("total", "seq"))
    return mounts.groupBy("pool").agg(s.alias("__m")) \
        .select("pool", "__m.node", "__m.total", "__m.used", "__m.available")


def days_left(usage: DataFrame, growth: DataFrame, critical: float = CRITICAL_MOUNT) -> DataFrame:
    """``(critical*total - used) / growth per day``; NULL (N/A) when the
    growth is not positive or the result exceeds 999 days."""
    j = usage.join(growth, "pool", "left")
    g = F.col("growth_rate")
    per_day_growth = per_day(g)
    dl = (F.lit(critical) * F.col("total").cast("double") - F.col("used").cast("double")) / per_day_growth
    na = (per_day(bytes_to_gb(g)) <= 0) | (dl > 999)
    return j.select("pool", bytes_to_gb(F.col("used")).alias("used_gb"),
                    per_day(bytes_to_gb(g)).alias("gb_per_day"),
                    F.when(g.isNull() | na, F.lit(None)).otherwise(dl).alias("days_left"))


def day_over_day(segments: DataFrame, offsets=DOD_OFFSETS) -> DataFrame:
    """E5: GB/day of the n-th most recent segment, for n in 0,1,2,7,14."""
    w = Window.partitionBy("pool").orderBy(F.col("seg_start").desc())
    s = segments.withColumn("__r", F.row_number().over(w) - 1)
    v = per_day(bytes_to_gb(F.col("rate")))
    return s.groupBy("pool").agg(*[F.max(F.when(F.col("__r") == n, v)).alias(f"d{n}") for n in offsets])


def total_consumed(usage: DataFrame, growth: DataFrame) -> DataFrame:
    """Site-wide used bytes and growth per day (the decaying average is
    reset per pool; the reference carries it from one pool into the next)."""
    j = usage.join(growth, "pool", "left")
    return j.agg(F.sum("used").cast("long").alias("total_used"),
                 F.sum(per_day(F.col("growth_rate"))).alias("total_growth_per_day")) \
        .withColumn("total_used_h", humanize_bytes(F.col("total_used"))) \
        .withColumn("growth_h", humanize_bytes(F.col("total_growth_per_day")))


def threshold_buckets(usage: DataFrame, critical: float = CRITICAL_MOUNT,
                      warning: float = WARNING_MOUNT) -> DataFrame:
    """used/total above critical, else above warning, else none."""
    r = F.col("used").cast("double") / F.col("total").cast("double")
    return usage.select("pool", r.alias("fill"),
                        F.when(r > critical, "critical").when(r > warning, "warning")
                        .otherwise("none").alias("bucket"))


# --- E6-E9 outliers ------------------------------------------------------------

def outlier_blocks(h: DataFrame, now: int, pools: DataFrame | None = None) -> DataFrame:
    """E6/E7 (with C6, the same block 7/14/21/28 days earlier): the 2-hour
    blocks of the last 3 days per pool (start every
    7200 s from now - 3 days while start + 3720 < now, each [start, start +
    7320] closed), the current rate and the baseline rates of the same block
    7/14/21/28 days earlier (blocks with >= 2 timestamps).

    Baselines are dropped one at a time, in lag order, when > 5x or < -5x the
    mean of those still kept (mean recomputed after each drop).  First/last
    of a block follow insertion id order (``first_id``).  One range join of
    the (deduplicated) history against the small block table."""
    start0 = now - OUTLIER_DAYS * DAY
    n_blocks = 0
    while start0 + n_blocks * BLOCK_STEP + BLOCK_MIN_TAIL < now:
        n_blocks += 1
    pools = pools if pools is not None else h.select("pool").distinct()
    lags = F.array(*[F.lit(d) for d in (0, *BASELINE_DAYS)])
    blocks = (pools.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
              .withColumn("lag", F.explode(lags))
              .withColumn("start", (F.lit(start0) + F.col("block") * BLOCK_STEP).cast("long"))
              .withColumn("lo", (F.col("start") - F.col("lag") * DAY).cast("long"))
              .withColumn("hi", (F.col("lo") + BLOCK_WIDTH).cast("long"))
              .withColumnRenamed("pool", "b_pool"))
    lo_all = start0 - max(BASELINE_DAYS) * DAY
    hh = h.filter((F.col("ts") >= lo_all) & (F.col("ts") <= now + BLOCK_WIDTH)) \
        .select("pool", "ts", "first_id", "used")
    # the block layout is known from ``now`` alone: hour-wide buckets hold at
    # most a few blocks per lag; the block table is pools x blocks x 5 rows
    plan = BucketPlan(width=3600, cap_bucket=(now + BLOCK_WIDTH) // 3600 + 1, exploded_rows=0)
    j = range_join(hh, "ts", blocks.withColumnRenamed("b_pool", "pool"), lo="lo", hi="hi",
                   on=("pool",), plan=plan, broadcast=False)
    first = F.min_by(F.struct("ts", "used"), "first_id")
    last = F.max_by(F.struct("ts", "used"), "first_id")
    per = j.groupBy("pool", "block", "start", "lag").agg(
        F.count(F.lit(1)).alias("n"), first.alias("f"), last.alias("l"))
    # 0.0/0.0 is NaN in the reference (one-timestamp block); try_divide -> NULL
    rate = F.try_divide((F.col("f.used") - F.col("l.used")).cast("double"),
                        (F.col("f.ts") - F.col("l.ts")).cast("double"))
    per = per.withColumn("rate", rate)
    cur = per.filter("lag = 0").select("pool", "block", "start", F.col("n").alias("now_n"),
                                       F.col("rate").alias("now_rate"))
    base = per.filter("lag > 0 AND n >= 2").groupBy("pool", "block").agg(
        *[F.max(F.when(F.col("lag") == d, F.col("rate"))).alias(f"b{d}") for d in BASELINE_DAYS],
        *[F.max(F.when(F.col("lag") == d, F.lit(True))).alias(f"has{d}") for d in BASELINE_DAYS])
    out = cur.join(base, ["pool", "block"], "left")
    return _drop_baseline_outliers(out)


def _drop_baseline_outliers(df: DataFrame) -> DataFrame:
    """E7 sequential drop as one fold over the (at most four) baselines in
    lag order 7, 14, 21, 28: at step i the mean of the baselines still kept
    is recomputed and baseline i is dropped when it is above 5x or below -5x
    that mean.  A constant-size higher-order expression (``aggregate`` over
    a 4-slot keep mask), so the plan does not grow with the unrolling."""
    n = len(BASELINE_DAYS)
    vals = F.array(*[F.col(f"b{d}").cast("double") for d in BASELINE_DAYS])
    present = F.array(*[F.coalesce(F.col(f"has{d}"), F.lit(False)) for d in BASELINE_DAYS])
    kept_sum = "aggregate(zip_with(acc, __vals, (a, v) -> IF(a, v, 0D)), 0D, (x, y) -> x + y)"
    kept_n = "size(filter(acc, a -> a))"
    mean = f"try_divide({kept_sum}, {kept_n})"
    step = (f"(acc, i) -> transform(acc, (k, j) -> CASE WHEN j = i THEN k AND NOT coalesce("
            f"__vals[i] > {mean} * {BASELINE_DROP} OR __vals[i] < {mean} * -{BASELINE_DROP}, false) "
            f"ELSE k END)")
    out = df.withColumn("__vals", vals).withColumn("__present", present)
    out = out.withColumn("__keep", F.expr(f"aggregate(sequence(0, {n - 1}), __present, {step})"))
    out = out.withColumn("baseline_n", F.expr("size(filter(__keep, a -> a))")) \
        .withColumn("baseline_mean", F.expr(
            "try_divide(aggregate(zip_with(__keep, __vals, (a, v) -> IF(a, v, 0D)), 0D, (x, y) -> x + y), "
            "size(filter(__keep, a -> a)))"))
    return out.select("pool", "block", "start", "now_n", "now_rate", "baseline_n", "baseline_mean")


def _flags(blocks: DataFrame) -> DataFrame:
    m, r = F.col("baseline_mean"), F.col("now_rate")
    evaluated = (F.col("now_n") > 0) & (F.col("baseline_n") > 0)
    sustained = ((r > m * SUSTAINED_FACTOR) & (m != 0)) | ((m == 0) & (r > ZERO_MEAN_RATE))
    spike = ((r > m * SPIKE_FACTOR) & (m != 0)) | ((m == 0) & (r > ZERO_MEAN_RATE))
    return blocks.withColumn("evaluated", evaluated) \
        .withColumn("sustained", F.coalesce(sustained, F.lit(False))) \
        .withColumn("spike", F.coalesce(spike, F.lit(False)))


def outlier_spikes(blocks: DataFrame) -> DataFrame:
    """Single evaluated blocks above 5x the baseline mean (or the zero
    rule), with GB/day values."""
    from keyspan.functions.dates import epoch_report_time
    f = _flags(blocks)
    return f.filter("evaluated AND spike").select(
        "pool", "start", (F.col("start") + BLOCK_WIDTH).alias("end"),
        epoch_report_time(F.col("start")).alias("start_time"),
        epoch_report_time(F.col("start") + BLOCK_WIDTH).alias("end_time"),
        per_day(bytes_to_gb(F.col("now_rate"))).alias("usage_gb_day"),
        per_day(bytes_to_gb(F.col("baseline_mean"))).alias("prev_weeks_gb_day"))


def outlier_runs(blocks: DataFrame) -> DataFrame:
    """Runs of more than 3 consecutive evaluated blocks above 2.2x the
    baseline mean; a run is reported only once a later evaluated block ends
    it (an open run is discarded).  One row per run: the start of its first
    block, the end and values of its last block.  Gaps and islands over the
    (bounded) evaluated blocks of each pool."""
    f = _flags(blocks).filter("evaluated")
    w = Window.partitionBy("pool").orderBy("block")
    f = f.withColumn("__isl", F.sum(F.when(F.col("sustained"), 0).otherwise(1))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    resets = f.groupBy("pool").agg(F.sum(F.when(F.col("sustained"), 0).otherwise(1)).alias("__resets"))
    runs = f.filter("sustained").groupBy("pool", "__isl").agg(
        F.count(F.lit(1)).alias("blocks"), F.min("start").alias("run_start"),
        F.max_by(F.struct("start", "now_rate", "baseline_mean"), "block").alias("__last"))
    runs = runs.join(resets, "pool").filter(
        (F.col("blocks") > RUN_MIN_BLOCKS) & (F.col("__resets") > F.col("__isl")))
    return runs.select("pool", "run_start", (F.col("__last.start") + BLOCK_WIDTH).alias("run_end"),
                       "blocks",
                       per_day(bytes_to_gb(F.col("__last.now_rate"))).alias("usage_gb_day"),
                       per_day(bytes_to_gb(F.col("__last.baseline_mean"))).alias("prev_weeks_gb_day"))


def block_growth_by_pool(blk: DataFrame) -> DataFrame:
    """A13/D7 for every pool of an already-filtered history block: its growth
    rate (first vs last in insertion order)."""
    first = F.min_by(F.struct("ts", "used"), "first_id")
    last = F.max_by(F.struct("ts", "used"), "first_id")
    return blk.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), first.alias("f"), last.alias("l")).select(
        "pool", "n", F.try_divide((F.col("f.used") - F.col("l.used")).cast("double"),
                                  (F.col("f.ts") - F.col("l.ts")).cast("double")).alias("rate"))


# --- D8 / F1 key exhaustion -------------------------------------------------------

def type_max(type_name: str, unsigned: bool = False) -> int:
    """Largest value of a MySQL integer type: unsigned 2^bits (as the
    reference has it, not minus one), signed half of that minus one."""
    m = TYPE_MAX[type_name.lower()]
    return m if unsigned else m // 2 - 1


def key_exhaustion(tables: dict[str, DataFrame], pools: dict[str, str], now: int,
                   key_filter=None) -> DataFrame:
    """For every integer key column of every table: max value, type
    limit (from the Spark type; all signed) and fill ratio.  One aggregate
    per table over only its key columns (column pruning), unioned."""
    parts = []
    for t, df in tables.items():
        cols = [(f.name, SPARK_INT_TYPES[type(f.dataType)]) for f in df.schema.fields
                if type(f.dataType) in SPARK_INT_TYPES and (key_filter is None or key_filter(f.name))]
        if not cols:
            continue
        wide = df.agg(*[F.max(c).cast("decimal(20,0)").alias(c) for c, _ in cols])
        stack = ", ".join(f"'{c}', '{ty}', `{c}`, CAST({type_max(ty)} AS DECIMAL(20,0))"
                          for c, ty in cols)
        long_ = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, column_type, max_val, "
                                "data_type_max)")
        parts.append(long_.select(F.lit(now).cast("long").alias("timestamp"),
                                  F.lit(pools.get(t, "functional")).alias("pool"),
                                  F.lit(t).alias("table_name"), "*"))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    frac = F.col("max_val").cast("double") / F.col("data_type_max").cast("double")
    return u.withColumn("fraction", frac).withColumn("ratio", F.round(frac, 2))


def top_exhaustion(samples: DataFrame, day: str, k: int = 5) -> DataFrame:
    """today's samples, the fullest column per (pool, table), top ``k``
    by ratio (ties: unrounded fraction, then names)."""
    s = samples.filter(F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd") == day)
    best = s.groupBy("pool", "table_name").agg(
        F.max_by(F.struct("column_name", "column_type", "max_val", "data_type_max", "ratio", "fraction"),
                 F.struct("fraction", F.col("column_name"))).alias("__b"))
    return best.select("pool", "table_name", "__b.*") \
        .orderBy(F.col("ratio").desc(), F.col("fraction").desc(), "pool", "table_name").limit(k)
