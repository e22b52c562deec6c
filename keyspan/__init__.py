"""keyspan: range-sharded table analytics on Spark.

One logical DataFrame per table plus a small shard-map DataFrame replaces a
fleet of range-sharded databases; ``shard`` becomes a column.  Every public
function takes DataFrames and returns DataFrames; actions only happen in
``keyspan.plans.jobs`` (and in tiny, bounded lookups on the shard map).
"""

from keyspan.session import get_spark, checkpoint_dir, load_table  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "load_table"]
