"""Table specs, the shard-map schema and fixed values.

A *shard* is a closed integer range ``[min_id, max_id]`` of the sharding key;
``max_id`` NULL stands for infinity.  The shard map is a small DataFrame with
one row per shard::

    pool string, min_id long, max_id long (NULL = infinity), state string,
    parent string (name of the parent shard while a split is open),
    name string (``pool-min-max`` lower case), seq int (list order)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """A logical table: sharding keys (zero, one or several columns), primary
    key, number of export chunks and an optional export sort order.

    A table without sharding keys has ``chunks`` forced to 0 and is always
    handled as a whole (unchunked path)."""

    name: str
    keys: tuple[str, ...] = ()
    pk: tuple[str, ...] = ()
    chunks: int = 0
    order_by: tuple[str, ...] = ()
    pool: str | None = None

    def __post_init__(self):
        if not self.keys and self.chunks:
            object.__setattr__(self, "chunks", 0)

    @property
    def first_pk_col(self) -> str | None:
        return self.pk[0] if self.pk else None

    @property
    def count_key(self) -> str | None:
        """Column used by range counts: first sharding key, else first pk column."""
        return self.keys[0] if self.keys else self.first_pk_col


SHARD_MAP_SCHEMA = T.StructType([
    T.StructField("pool", T.StringType(), False),
    T.StructField("min_id", T.LongType(), False),
    T.StructField("max_id", T.LongType(), True),
    T.StructField("state", T.StringType(), False),
    T.StructField("parent", T.StringType(), True),
    T.StructField("name", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
])

# --- Fixed values (must equal the reference for identical results) ---------
# Shard states that count as "in production" (the merge-capable superset).
IN_PRODUCTION_STATES = ("merging", "ready", "child", "needs_cleanup", "read_only", "offline")
# All documented shard states.
ALL_STATES = (
    "ready", "read_only", "offline", "initializing", "exporting", "importing",
    "replicating", "child", "needs_cleanup", "deprecated", "recycle",
    "merging", "initialized",
)
# Default chunk counts from the sample configuration.
DEFAULT_LARGE_CHUNKS = 200
DEFAULT_MEDIUM_CHUNKS = 100
# Upper bound multiplier for the open-ended last shard when exporting.
MAX_TABLE_MULTIPLIER = 1.2
# ---------------------------------------------------------------------------


def shard_name(pool: str, min_id: int, max_id: int | None) -> str:
    hi = "infinity" if max_id is None else str(max_id)
    return f"{pool.lower()}-{min_id}-{hi}"


def shard_name_col(pool: Column, min_id: Column, max_id: Column) -> Column:
    """Column version of :func:`shard_name`."""
    hi = F.coalesce(max_id.cast("string"), F.lit("infinity"))
    return F.lower(F.concat_ws("-", pool, min_id.cast("string"), hi))


def _sql_str(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("'", "''") + "'"


def shard_map_from_rows(spark: SparkSession, rows) -> DataFrame:
    """Build a shard map from ``(pool, min_id, max_id, state[, parent])``
    tuples; names and list order are derived.  Built as an inline VALUES
    relation so it lives in the JVM (a LocalRelation: no Python workers, and
    Catalyst sees its size)."""
    vals = []
    for i, r in enumerate(rows):
        pool, lo, hi, state = r[0], int(r[1]), (None if r[2] is None else int(r[2])), r[3]
        parent = r[4] if len(r) > 4 else None
        hi_sql = "CAST(NULL AS BIGINT)" if hi is None else f"CAST({hi} AS BIGINT)"
        vals.append(f"({_sql_str(pool)}, CAST({lo} AS BIGINT), {hi_sql}, {_sql_str(state)}, "
                    f"{_sql_str(parent)}, {_sql_str(shard_name(pool, lo, hi))}, {i})")
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(vals) +
                   " AS m(pool, min_id, max_id, state, parent, name, seq)")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SHARD_MAP_SCHEMA])


def shard_map_sql_values(rows) -> str:
    """Same shard map as an inline SQL relation (for the DuckDB oracle)."""
    parts = []
    for i, r in enumerate(rows):
        pool, lo, hi, state = r[0], int(r[1]), r[2], r[3]
        parent = r[4] if len(r) > 4 else None
        hi_sql = "CAST(NULL AS BIGINT)" if hi is None else f"CAST({int(hi)} AS BIGINT)"
        par_sql = "CAST(NULL AS VARCHAR)" if parent is None else f"'{parent}'"
        parts.append(
            f"('{pool}', CAST({lo} AS BIGINT), {hi_sql}, '{state}', {par_sql}, "
            f"'{shard_name(pool, lo, hi)}', {i})")
    return ("(VALUES " + ", ".join(parts) +
            ") AS m(pool, min_id, max_id, state, parent, name, seq)")


# --- Fixture bindings onto the driver tables (see FIXTURES.md) -------------
CUSTS_MAP = [
    ("custs", 0, 39, "ready"),
    ("custs", 40, 99, "ready"),
    ("custs", 100, 999, "ready"),
    ("custs", 1000, None, "ready"),
]
CUSTS_SPLIT_MAP = CUSTS_MAP + [
    ("custs", 100, 549, "child", "custs-100-999"),
    ("custs", 550, 999, "child", "custs-100-999"),
]

ORDERS = TableSpec("orders", keys=("o_custkey",), pk=("o_orderkey",),
                   chunks=DEFAULT_LARGE_CHUNKS, pool="custs")
CUSTOMER = TableSpec("customer", keys=("c_custkey",), pk=("c_custkey",),
                     chunks=1, pool="custs")
LINEITEM = TableSpec("lineitem", keys=("l_partkey", "l_suppkey"),
                     pk=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
                     chunks=DEFAULT_MEDIUM_CHUNKS, pool="parts")
UNSHARDED = (
    TableSpec("nation", pk=("n_nationkey",)),
    TableSpec("region", pk=("r_regionkey",)),
    TableSpec("part", pk=("p_partkey",)),
    TableSpec("supplier", pk=("s_suppkey",)),
)
