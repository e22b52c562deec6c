"""Range join: attach to every row the range(s) ``[lo, hi]`` holding its key.

Spark has no range-join strategy; a plain ``key BETWEEN lo AND hi`` join plans
as a broadcast nested-loop join, i.e. (rows x ranges) comparisons.  Instead the
key space is cut into buckets of width ``W`` and each range is exploded into
the buckets it touches.  The join is then an equi-join on ``bucket`` (hash
join) plus the exact range test as a residual condition, so each row is
compared with only the handful of ranges sharing its bucket.

``W`` is picked so that the exploded side stays a small multiple of the number
of ranges.  Open ranges (``hi`` NULL = infinity) are clamped to one bucket past
the largest finite bound, and keys beyond it fall into that last bucket.

The exploded side is broadcast only when its row count, counted exactly on the
range table before the join (overlaps included), is under ``broadcast_max_rows``.  Above that the join shuffles on
``bucket`` and AQE's skew handling splits any hot bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_RANGE = 4
BROADCAST_MAX_ROWS = 250_000   # ~25 MB of (range, bucket) rows


@dataclass(frozen=True)
class BucketPlan:
    width: int
    cap_bucket: int
    exploded_rows: int


def floor_div(name: str, width: int) -> Column:
    """Exact floor division of an integral column by a positive constant
    (integer ``div``, no float round trip, correct for negative keys)."""
    c = f"CAST(`{name}` AS BIGINT)"
    if width == 1:
        return F.expr(c)
    return F.expr(f"({c} - pmod({c}, {int(width)}L)) div {int(width)}L")


def plan_buckets(ranges: DataFrame, lo: str = "min_id", hi: str = "max_id",
                 disjoint_factor: int | None = None) -> BucketPlan:
    """Aggregates over the range table (never the data) size the buckets and
    count the exploded rows.  ``disjoint_factor``: the ranges that will be
    joined are *disjoint* ones derived from these, at most so many times as
    many (2n effective intervals from n shards); their exploded rows are then
    bounded by span / width + 2n without a second aggregate."""
    s = ranges.agg(
        F.min(lo).alias("lo"),
        F.max(F.greatest(F.col(lo), F.coalesce(F.col(hi), F.col(lo)))).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if s is None or s["n"] == 0 or s["lo"] is None:
        return BucketPlan(1, 0, 0)
    span = int(s["hi"]) - int(s["lo"]) + 1
    n = int(s["n"]) * (disjoint_factor or 1)
    width = max(1, -(-span // (BUCKETS_PER_RANGE * n)))
    plan = BucketPlan(width, (int(s["hi"]) // width) + 1, 0)
    if disjoint_factor:
        rows = (plan.cap_bucket - int(s["lo"]) // width + 1) + 2 * n
    else:
        b_lo, b_hi = _touched(plan, lo, hi)
        rows = ranges.agg(F.sum(b_hi - b_lo + 1)).first()[0]
    return BucketPlan(width, plan.cap_bucket, int(rows))


def _touched(plan: BucketPlan, lo: str, hi: str) -> tuple[Column, Column]:
    """First and last bucket of a range."""
    cap = F.lit(plan.cap_bucket).cast("long")
    b_lo = floor_div(lo, plan.width)
    return b_lo, F.greatest(b_lo, F.coalesce(F.least(floor_div(hi, plan.width), cap), cap))


def explode_ranges(ranges: DataFrame, plan: BucketPlan, lo: str = "min_id",
                   hi: str = "max_id") -> DataFrame:
    return ranges.withColumn("__bucket", F.explode(F.sequence(*_touched(plan, lo, hi))))


def range_join(df: DataFrame, key: str, ranges: DataFrame, *, lo: str = "min_id",
               hi: str = "max_id", how: str = "inner", on: tuple[str, ...] = (),
               broadcast_max_rows: int = BROADCAST_MAX_ROWS,
               plan: BucketPlan | None = None, broadcast: bool | None = None) -> DataFrame:
    """Join ``df`` with every row of ``ranges`` whose ``[lo, hi]`` holds ``key``.

    ``on`` lists extra equality columns present on both sides (e.g. ``pool``).
    ``how`` is ``inner`` or ``left``.  The output has ``df``'s columns plus the
    range columns (the internal bucket column is dropped).  ``plan`` may be
    given when the ranges are derived from a table already sized.
    ``broadcast``: None = hint when the counted exploded size is under
    ``broadcast_max_rows``; False = no hint, Spark (AQE) decides from the
    measured size at run time; True = always hint.
    """
    if how not in ("inner", "left"):
        raise ValueError("range_join supports inner and left joins")
    plan = plan or plan_buckets(ranges, lo, hi)
    right = explode_ranges(ranges, plan, lo, hi)
    left = df.withColumn("__bucket", F.least(floor_div(key, plan.width),
                                             F.lit(plan.cap_bucket).cast("long")))
    # qualify through aliases so equal names on both sides stay unambiguous
    lq, rq = left.alias("__l"), right.alias("__r")
    if broadcast or (broadcast is None and plan.exploded_rows <= broadcast_max_rows):
        rq = F.broadcast(rq)
    lkey = F.col(f"__l.{key}")
    cond = (F.col("__l.__bucket") == F.col("__r.__bucket")) & (lkey >= F.col(f"__r.{lo}")) & \
        (F.col(f"__r.{hi}").isNull() | (lkey <= F.col(f"__r.{hi}")))
    for c in on:
        cond = cond & (F.col(f"__l.{c}") == F.col(f"__r.{c}"))
    joined = lq.join(rq, cond, how)
    right_cols = [c for c in ranges.columns if c not in on]
    left_cols = [c for c in df.columns]
    clash = set(left_cols) & set(right_cols)
    if clash:
        raise ValueError(f"range_join: columns on both sides: {sorted(clash)}")
    return joined.select([F.col(f"__l.{c}") for c in left_cols] +
                         [F.col(f"__r.{c}") for c in right_cols])
