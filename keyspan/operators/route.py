"""Routing rows to shards and shard-map transforms.

All shard-map work happens on the small map; data rows meet the map exactly
once, through a bucketed range join against a *disjoint* effective map, so no
per-row window or deduplication is ever needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.operators.rangejoin import plan_buckets, range_join
from keyspan.spec import IN_PRODUCTION_STATES, shard_name_col

MAP_COLS = ("pool", "min_id", "max_id", "state", "parent", "name", "seq")


def in_production(state_col="state"):
    return F.col(state_col).isin(*IN_PRODUCTION_STATES)


def select_shards(shard_map: DataFrame, pool: str | None = None, *, min_id=None,
                  max_id=None, in_prod: bool | None = None,
                  being_split: bool | None = None) -> DataFrame:
    """Shards of a pool (case-insensitive), by exact ``(min, max)``, in
    production, or being split (a parent with at least one child)."""
    m = shard_map
    if pool is not None:
        m = m.filter(F.lower("pool") == pool.lower())
    if min_id is not None:
        m = m.filter(F.col("min_id") == int(min_id))
    if max_id is not None:
        m = m.filter(F.col("max_id") == int(max_id) if max_id != "INFINITY"
                     else F.col("max_id").isNull())
    if in_prod is not None:
        m = m.filter(in_production() if in_prod else ~in_production())
    if being_split is not None:
        parents = shard_map.filter(F.col("parent").isNotNull()) \
            .select(F.col("parent").alias("name")).distinct()
        m = m.join(parents, "name", "left_semi" if being_split else "left_anti")
    return m


def check_parents(shard_map: DataFrame) -> DataFrame:
    """Children whose parent name is not in the map (an error in the
    reference).  Returns the offending rows; empty means the map is sound."""
    names = shard_map.select(F.col("name").alias("parent"))
    return shard_map.filter(F.col("parent").isNotNull()).join(names, "parent", "left_anti")


def effective_map(shard_map: DataFrame, plan=None) -> DataFrame:
    """Resolve overlapping shards into disjoint routing intervals.

    Rule (per id): among shards holding it, drop children that are not in
    production; prefer a child; otherwise the first in list order (``seq``).
    The key line is cut at every shard boundary into elementary intervals, each
    gets its preferred shard, and neighbours with the same shard are merged.
    Output columns: the map's columns with ``min_id``/``max_id`` narrowed.
    """
    # the map is small (one row per shard): one partition up front, and every
    # window / aggregate below needs no further shuffle
    cand = shard_map.filter(~(F.col("parent").isNotNull() & ~in_production())).repartition(1)
    points = (cand.select("pool", F.col("min_id").alias("p"))
              .union(cand.filter(F.col("max_id").isNotNull())
                     .select("pool", (F.col("max_id") + 1).alias("p")))
              .distinct())
    wp = Window.partitionBy("pool").orderBy("p")
    elem = points.withColumn("e_hi", F.lead("p").over(wp) - 1)
    # elementary intervals only meet the shards of their own pool; no hint, the map's size decides
    hits = range_join(elem, "p", cand, plan=plan, on=("pool",), broadcast=False)
    pick = Window.partitionBy("pool", "p").orderBy(F.col("parent").isNull(), "seq")
    best = (hits.withColumn("__rk", F.row_number().over(pick)).filter("__rk = 1")
            .select("pool", "p", "e_hi", "name", "state", "parent", "seq",
                    F.col("max_id").alias("s_max")))
    # an open elementary interval only exists past the last finite boundary,
    # where the chosen shard must itself be open
    best = best.filter(F.col("e_hi").isNotNull() | F.col("s_max").isNull())
    wo = Window.partitionBy("pool").orderBy("p")
    isl = best.withColumn(
        "__new",
        F.when((F.lag("name").over(wo) == F.col("name")) &
               (F.lag("e_hi").over(wo) + 1 == F.col("p")), 0).otherwise(1))
    isl = isl.withColumn("__isl", F.sum("__new").over(wo.rowsBetween(Window.unboundedPreceding, 0)))
    return (isl.groupBy("pool", "__isl", "name", "state", "parent", "seq")
            .agg(F.min("p").alias("min_id"),
                 F.when(F.max(F.col("e_hi").isNull().cast("int")) == 1, F.lit(None))
                 .otherwise(F.max("e_hi")).cast("long").alias("max_id"))
            .select(*MAP_COLS))


def route(df: DataFrame, key: str, shard_map: DataFrame, pool: str | None = None,
          *, how: str = "left", shard_col: str = "shard") -> DataFrame:
    """Add the owning shard's name to every row (NULL when no shard holds
    the key, or the key is NULL).  ``how='inner'`` drops unowned rows."""
    m = shard_map if pool is None else shard_map.filter(F.lower("pool") == pool.lower())
    if pool is None and m.select("pool").distinct().limit(2).count() > 1:
        raise ValueError("the map holds several pools and their ranges overlap: name the pool to route to")
    # effective intervals are disjoint, at most 2n of them over the map's span;
    # one tiny sizing job on the map serves both joins
    plan = plan_buckets(m, disjoint_factor=2)
    eff = effective_map(m, plan).select(F.col("name").alias(shard_col),
                                        F.col("min_id").alias("__lo"),
                                        F.col("max_id").alias("__hi"))
    out = range_join(df, key, eff, lo="__lo", hi="__hi", how=how, plan=plan)
    return out.drop("__lo", "__hi")


def route_all_keys(df: DataFrame, keys, shard_map: DataFrame, pool: str | None = None,
                   shard_col: str = "shard") -> DataFrame:
    """A row once for every shard that holds any of its sharding keys (the
    owner of each key; two keys in one shard count once).  Effective ranges
    are disjoint, so each join adds at most one match to a row and repeated
    rows stay repeated."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = [f"__shard{i}" for i in range(len(keys))]
    for key, name in zip(keys, names):
        df = route(df, key, shard_map, pool, shard_col=name)
    held = F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull()))
    return df.withColumn(shard_col, F.explode(held)).drop(*names)


def route_targets(df: DataFrame, key: str, shard_map: DataFrame, pool: str | None = None) -> DataFrame:
    """Read and write target per row, from the owning shard's state.

    ready / needs_cleanup -> itself for both; child -> reads itself, writes to
    its parent; read_only -> reads itself, no writes; merging -> reads from the
    merged shard that covers it, writes to itself; anything else -> none."""
    routed = route(df, key, shard_map, pool, shard_col="__shard")
    tgt = shard_targets(shard_map).withColumnRenamed("name", "__shard")
    # one row per shard: Spark broadcasts it by its measured size
    return routed.join(tgt, "__shard", "left") \
        .withColumnRenamed("__shard", "shard")


def shard_targets(shard_map: DataFrame) -> DataFrame:
    """Per shard read/write target names (B13) on the map alone."""
    merged = merged_cover(shard_map).select(F.col("name"), F.col("merged_name"))
    m = shard_map.join(merged, "name", "left")
    st = F.col("state")
    read = (F.when(st.isin("ready", "needs_cleanup", "child", "read_only"), F.col("name"))
            .when(st == "merging", F.col("merged_name")))
    write = (F.when(st.isin("ready", "needs_cleanup", "merging"), F.col("name"))
             .when(st == "child", F.col("parent")))
    return m.filter(in_production()).select("name", "state", read.alias("read_target"),
                                             write.alias("write_target"))


def merged_cover(shard_map: DataFrame) -> DataFrame:
    """For each shard, the merged shard covering it: a different shard in
    state initialized/ready whose range contains it; infinite ranges are
    excluded on both sides, of several covers the first in the list counts.

    A cover holds the shard's first id, so shards meet their possible covers in
    the bucketed range join of that id, not in pairs of all shards of a pool."""
    a = shard_map.filter(F.col("max_id").isNotNull()).select("pool", "name", "min_id", "max_id")
    b = (shard_map.filter(F.col("max_id").isNotNull() & F.col("state").isin("initialized", "ready"))
         .select("pool", F.col("name").alias("merged_name"), F.col("min_id").alias("__lo"), F.col("max_id").alias("__hi"),
                 F.col("seq").alias("__seq")))
    held = range_join(a, "min_id", b, lo="__lo", hi="__hi", on=("pool",))
    covers = held.filter((F.col("__hi") >= F.col("max_id")) & (F.col("name") != F.col("merged_name")))
    # names are unique in a map, and a pool's list numbers too
    return covers.groupBy("name").agg(F.min_by("merged_name", F.struct("__seq", "merged_name")).alias("merged_name"))


def shards_within(shard_map: DataFrame, lo: int, hi: int, pool: str | None = None) -> DataFrame:
    """C2 candidate selection: shards with ``min >= lo AND max <= hi``."""
    m = shard_map if pool is None else shard_map.filter(F.lower("pool") == pool.lower())
    return m.filter((F.col("min_id") >= lo) & F.col("max_id").isNotNull() & (F.col("max_id") <= hi))


def cutover(shard_map: DataFrame, cutover_id, pool: str) -> DataFrame:
    """Replace the open last shard ``[a, inf)`` of ``pool`` by ``[a, id-1]``
    plus a new ``[id, inf)``; ``id`` must be greater than ``a`` (checked at
    execution with ``raise_error``).  The old entry stays, in state
    ``recycle``; the two new shards follow it in list order.  ``cutover_id``
    is an int or a one-value Column expression usable on the map rows."""
    cid = (F.lit(cutover_id) if isinstance(cutover_id, int) else cutover_id).cast("long")
    is_last = (F.lower("pool") == pool.lower()) & F.col("max_id").isNull() & in_production()
    checked = shard_map.filter(is_last).withColumn(
        "__cid", F.when(cid > F.col("min_id"), cid)
        .otherwise(F.raise_error(F.lit("the cutover id must lie above the start of the last shard")).cast("long")))
    base = shard_map.withColumn("state", F.when(is_last, F.lit("recycle")).otherwise(F.col("state"))) \
        .withColumn("__sub", F.lit(0))
    replace = checked.select("pool", "min_id", (F.col("__cid") - 1).alias("max_id"),
                             F.lit(1).alias("__sub"), "seq")
    new_last = checked.select("pool", F.col("__cid").alias("min_id"),
                              F.lit(None).cast("long").alias("max_id"), F.lit(2).alias("__sub"), "seq")
    added = (replace.unionByName(new_last)
             .withColumn("state", F.lit("ready"))
             .withColumn("parent", F.lit(None).cast("string"))
             .withColumn("name", shard_name_col(F.col("pool"), F.col("min_id"), F.col("max_id"))))
    out = base.select(*MAP_COLS, "__sub").unionByName(added.select(*MAP_COLS, "__sub"))
    # renumber list order; the map is small (one row per shard), so a single
    # ordered window over it is cheap
    order = Window.orderBy(F.when(F.col("__sub") == 0, F.col("seq")).otherwise(F.lit(1 << 30)),
                           "__sub", "pool")
    return out.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).select(*MAP_COLS)
