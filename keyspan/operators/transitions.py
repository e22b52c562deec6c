"""Shard state changes with their guards (B14), as shard-map transforms.

Each step checks its guard on the (small) map -- the offending rows come
back as a DataFrame, and :func:`apply` raises when it is not empty -- and
returns the map with the new states.  Used by the split, merge and cleanup
jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: states a manual command may set ---------------------------
MANUAL_STATES = ("read_only", "offline", "ready")
# -------------------------------------------------------------------------------


class TransitionError(RuntimeError):
    pass


def _set(m: DataFrame, cond: Column, state: str) -> DataFrame:
    return m.withColumn("state", F.when(cond, F.lit(state)).otherwise(F.col("state")))


def apply(m: DataFrame, violations: DataFrame, new_map: DataFrame, what: str) -> DataFrame:
    bad = violations.select("name", "state").collect()  # guard failures: bounded by the map
    if bad:
        raise TransitionError(f"{what}: " + ", ".join(f"{r.name} is {r.state}" for r in bad))
    return new_map


def move_reads_to_children(m: DataFrame, parent: str) -> DataFrame:
    """Children must all be ``replicating``; parent -> deprecated, children ->
    child."""
    kids = F.col("parent") == parent
    viol = m.filter(kids & (F.col("state") != "replicating"))
    new = _set(_set(m, F.col("name") == parent, "deprecated"), kids, "child")
    return apply(m, viol, new, "move reads")


def move_writes_to_children(m: DataFrame, parent: str) -> DataFrame:
    """Children -> needs_cleanup."""
    return _set(m, F.col("parent") == parent, "needs_cleanup")


def merge_reads(m: DataFrame, shards: list[str], combined: str) -> DataFrame:
    """Combined shard must be ``initialized`` and each shard ``ready``; the
    shards go to ``merging`` (reads served by the combined shard)."""
    viol = m.filter(((F.col("name") == combined) & (F.col("state") != "initialized")) |
                    (F.col("name").isin(*shards) & (F.col("state") != "ready")))
    return apply(m, viol, _set(m, F.col("name").isin(*shards), "merging"), "merge reads")


def merge_writes(m: DataFrame, shards: list[str], combined: str) -> DataFrame:
    """Combined ``initialized`` and shards ``merging``: shards -> deprecated,
    combined -> ready."""
    viol = m.filter(((F.col("name") == combined) & (F.col("state") != "initialized")) |
                    (F.col("name").isin(*shards) & (F.col("state") != "merging")))
    new = _set(_set(m, F.col("name").isin(*shards), "deprecated"), F.col("name") == combined, "ready")
    return apply(m, viol, new, "merge writes")


def merge_cleanup(m: DataFrame, shards: list[str], combined: str) -> DataFrame:
    """Combined ``ready`` and shards ``deprecated``: shards -> recycle."""
    viol = m.filter(((F.col("name") == combined) & (F.col("state") != "ready")) |
                    (F.col("name").isin(*shards) & (F.col("state") != "deprecated")))
    return apply(m, viol, _set(m, F.col("name").isin(*shards), "recycle"), "merge cleanup")


def set_manual(m: DataFrame, shard: str, state: str) -> DataFrame:
    """Manual read_only / offline / ready."""
    if state not in MANUAL_STATES:
        raise TransitionError(f"cannot set {state} by hand")
    return _set(m, F.col("name") == shard, state)
