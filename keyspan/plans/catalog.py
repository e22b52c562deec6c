"""Registered queries: one per operator of the inventory, each with a DuckDB
SQL twin where SQL can express it.

Every query reads the driver tables (or what Spark derives from them) in
full, so its work grows with the data.  Fixture bindings follow FIXTURES.md:
``orders`` is the single-key sharded table (key ``o_custkey``), ``lineitem``
the multi-key one (``l_partkey``, ``l_suppkey``), ``customer`` the small
table, ``nation/region/part/supplier`` the unsharded pool, ``events`` the
capacity history / query log / change streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.session import load_table
from keyspan.spec import CUSTOMER, LINEITEM, MAX_TABLE_MULTIPLIER, ORDERS, UNSHARDED, shard_map_from_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark, sf_dir, name):
    return load_table(spark, sf_dir, name)



# The pool of orders and customers: four shards that share the span of the
# keys in use, and the same with the third one split in two.
def custs_map(spark, sf_dir):
    return shard_map_from_rows(spark, _custs_rows(spark, sf_dir))


def custs_split_map(spark, sf_dir):
    rows = _custs_rows(spark, sf_dir)
    _, lo, hi, _ = rows[2]
    cut = lo + (hi - lo + 1) // 2
    parent = f"custs-{lo}-{hi}"
    return shard_map_from_rows(spark, [*rows, ("custs", lo, cut - 1, "child", parent), ("custs", cut, hi, "child", parent)])


def _custs_rows(spark, sf_dir):
    q = int(_t(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0]) // 4
    return [("custs", i * q, (i + 1) * q - 1 if i < 3 else None, "ready") for i in range(4)]


_ROWS_SQL = """SELECT 'custs' AS pool, i * q AS min_id, CASE WHEN i < 3 THEN (i + 1) * q - 1 END AS max_id,
  'ready' AS state, CAST(NULL AS VARCHAR) AS parent, i AS seq
  FROM (SELECT max(o_custkey) // 4 AS q FROM orders), range(4) AS r(i)"""
_NAMED_SQL = "*, pool || '-' || min_id || '-' || coalesce(CAST(max_id AS VARCHAR), 'infinity') AS name"
MAP_SQL = f"(SELECT {_NAMED_SQL} FROM ({_ROWS_SQL})) AS m"
SPLIT_MAP_SQL = f"""(SELECT {_NAMED_SQL} FROM ({_ROWS_SQL}
  UNION ALL SELECT 'custs', CASE WHEN j = 0 THEN 2 * q ELSE 2 * q + q // 2 END, CASE WHEN j = 0 THEN 2 * q + q // 2 - 1 ELSE 3 * q - 1 END,
  'child', 'custs-' || (2 * q) || '-' || (3 * q - 1), 4 + j
  FROM (SELECT max(o_custkey) // 4 AS q FROM orders), range(2) AS r(j))) AS m"""
IN_PROD_SQL = "('merging', 'ready', 'child', 'needs_cleanup', 'read_only', 'offline')"

# ---------------------------------------------------------------------------
# C1 routing
# ---------------------------------------------------------------------------


@register("route_orders_to_shards", f"""
WITH m AS (SELECT * FROM {SPLIT_MAP_SQL}),
cand AS (SELECT * FROM m WHERE NOT (parent IS NOT NULL AND state NOT IN {IN_PROD_SQL})),
hits AS (
  SELECT o.o_orderkey, o.o_custkey, c.name,
         row_number() OVER (PARTITION BY o.o_orderkey ORDER BY (c.parent IS NULL), c.seq) AS rk
  FROM orders o LEFT JOIN cand c
    ON o.o_custkey >= c.min_id AND (c.max_id IS NULL OR o.o_custkey <= c.max_id))
SELECT o_orderkey, o_custkey, name AS shard FROM hits WHERE rk = 1
""")
def q_route_orders(spark, sf_dir):
    from keyspan.operators.route import route
    m = custs_split_map(spark, sf_dir)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return route(o, "o_custkey", m, "custs")


# ---------------------------------------------------------------------------
# D2 / D12 global row count with rollup
# ---------------------------------------------------------------------------


@register("shard_rowcounts_rollup", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
c AS (
  SELECT 'orders' AS table_name, m.name AS shard, count(*) AS n
  FROM orders o JOIN m ON o.o_custkey >= m.min_id AND (m.max_id IS NULL OR o.o_custkey <= m.max_id)
  GROUP BY m.name
  UNION ALL
  SELECT 'customer', m.name, count(*)
  FROM customer c JOIN m ON c.c_custkey >= m.min_id AND (m.max_id IS NULL OR c.c_custkey <= m.max_id)
  GROUP BY m.name
  UNION ALL SELECT 'nation', 'functional', count(*) FROM nation
  UNION ALL SELECT 'region', 'functional', count(*) FROM region
  UNION ALL SELECT 'part', 'functional', count(*) FROM part
  UNION ALL SELECT 'supplier', 'functional', count(*) FROM supplier)
SELECT table_name, shard, CAST(sum(n) AS BIGINT) AS row_count,
       CAST(GROUPING(table_name, shard) AS INTEGER) AS lvl
FROM c GROUP BY ROLLUP (table_name, shard)
""")
def q_rowcount_rollup(spark, sf_dir):
    from keyspan.operators.counts import functional_counts, global_rowcount, shard_counts
    m = custs_map(spark, sf_dir)
    parts = [shard_counts(_t(spark, sf_dir, s.name), s, m) for s in (ORDERS, CUSTOMER)]
    parts += [functional_counts(_t(spark, sf_dir, s.name), s) for s in UNSHARDED]
    return global_rowcount(parts)


# ---------------------------------------------------------------------------
# B1 / B2 range filters
# ---------------------------------------------------------------------------


@register("range_filter_multi_key", """
WITH b AS (SELECT max(l_suppkey) // 4 AS lo, max(l_partkey) // 2 AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem, b
WHERE (l_partkey >= lo AND l_partkey <= hi) OR (l_suppkey >= lo AND l_suppkey <= hi)
""")
def q_range_filter_multi(spark, sf_dir):
    from keyspan.operators.ranges import key_range_predicate
    li = _t(spark, sf_dir, "lineitem")
    supp, part = li.agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    return li.filter(key_range_predicate(LINEITEM.keys, supp // 4, part // 2)) \
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("range_filter_open_ends", """
WITH b AS (SELECT max(o_custkey) // 3 AS t FROM orders)
SELECT 'min_only' AS kind, count(*) AS n FROM orders, b WHERE o_custkey >= 2 * t
UNION ALL SELECT 'max_only', count(*) FROM orders, b WHERE o_custkey <= t - 1
UNION ALL SELECT 'closed', count(*) FROM orders, b WHERE o_custkey >= t AND o_custkey <= 2 * t - 1
""")
def q_range_filter_open(spark, sf_dir):
    from keyspan.operators.ranges import key_range_predicate
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    t = int(o.agg(F.max("o_custkey")).first()[0]) // 3
    kinds = [("min_only", 2 * t, None), ("max_only", None, t - 1), ("closed", t, 2 * t - 1)]
    aggs = [F.count_if(key_range_predicate("o_custkey", lo, hi)).cast("long").alias(k)
            for k, lo, hi in kinds]
    wide = o.agg(*aggs)
    return wide.selectExpr("stack(3, 'min_only', min_only, 'max_only', max_only, 'closed', closed) "
                           "AS (kind, n)")


# ---------------------------------------------------------------------------
# B3 / D5 range violations
# ---------------------------------------------------------------------------


@register("out_of_range_counts", """
SELECT 'orders' AS table_name, 'o_custkey' AS key_col,
       CAST(count(*) FILTER (WHERE o_custkey > 999 OR o_custkey < 100) AS BIGINT) AS violations
FROM orders
UNION ALL
SELECT 'lineitem', 'l_partkey', CAST(count(*) FILTER (WHERE l_partkey > 99 OR l_partkey < 0) AS BIGINT)
FROM lineitem
UNION ALL
SELECT 'lineitem', 'l_suppkey', CAST(count(*) FILTER (WHERE l_suppkey > 99 OR l_suppkey < 0) AS BIGINT)
FROM lineitem
""")
def q_out_of_range(spark, sf_dir):
    from keyspan.operators.counts import range_violations
    a = range_violations(_t(spark, sf_dir, "orders"), ORDERS, 100, 999)
    b = range_violations(_t(spark, sf_dir, "lineitem"), LINEITEM, 0, 99)
    return a.unionByName(b).drop("status")


@register("shard_validity", """
WITH v AS (
  SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_custkey > 999 OR o_custkey < 100) AS bad
  FROM orders
  UNION ALL
  SELECT 'lineitem', count(*) FILTER (WHERE l_partkey > 99 OR l_partkey < 0) FROM lineitem
  UNION ALL
  SELECT 'lineitem', count(*) FILTER (WHERE l_suppkey > 99 OR l_suppkey < 0) FROM lineitem)
SELECT table_name, CASE WHEN max(bad) > 0 THEN 'invalid' ELSE 'valid' END AS status
FROM v GROUP BY table_name
""")
def q_shard_validity(spark, sf_dir):
    from keyspan.operators.counts import range_violations
    a = range_violations(_t(spark, sf_dir, "orders"), ORDERS, 100, 999)
    b = range_violations(_t(spark, sf_dir, "lineitem"), LINEITEM, 0, 99)
    return a.unionByName(b).groupBy("table_name").agg(
        F.when(F.max(F.col("violations")) > 0, "invalid").otherwise("valid").alias("status"))


# ---------------------------------------------------------------------------
# B4 prune (rows with a NULL key are kept)
# ---------------------------------------------------------------------------

# lineitem with l_suppkey blanked on line 7: gives rows with one NULL key
NULLED_SUPP_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey,
   CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem)"""


def _lineitem_nulled(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_suppkey"))
        .alias("l_suppkey"))


@register("prune_multi_key", f"""
WITH b AS (SELECT max(l_suppkey) // 2 AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {NULLED_SUPP_SQL} t, b
WHERE NOT (l_partkey IS NOT NULL AND l_suppkey IS NOT NULL
           AND NOT (l_partkey BETWEEN 0 AND hi) AND NOT (l_suppkey BETWEEN 0 AND hi))
""")
def q_prune_multi(spark, sf_dir):
    from keyspan.operators.transfer import prune_to_range
    li = _lineitem_nulled(spark, sf_dir)
    # the lower half of the supplier keys
    return prune_to_range(li, LINEITEM.keys, 0, int(_t(spark, sf_dir, "lineitem").agg(F.max("l_suppkey")).first()[0]) // 2)


# ---------------------------------------------------------------------------
# B11 / A4 / A5 chunk ranges and file names; D1 chunk counts
# ---------------------------------------------------------------------------


@register("chunk_ranges", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
mx AS (SELECT CAST(floor(max(k) * {MAX_TABLE_MULTIPLIER}) AS BIGINT) AS top FROM (
         SELECT max(o_custkey) AS k FROM orders UNION ALL SELECT max(c_custkey) FROM customer)),
b AS (SELECT m.name AS shard, m.min_id AS lo, coalesce(m.max_id, greatest(mx.top, m.min_id - 1)) AS hi,
             m.max_id IS NULL AS open FROM m, mx),
w AS (SELECT *, greatest((hi - lo + 1) // 200, 1) AS width FROM b),
c AS (SELECT shard, CAST(s AS BIGINT) AS chunk_min, CAST(least(s + width - 1, hi) AS BIGINT) AS chunk_max
      FROM w, unnest(generate_series(lo, hi, width)) AS t(s)
      UNION ALL
      SELECT shard, CAST(hi + 1 AS BIGINT), CAST(NULL AS BIGINT) FROM w WHERE open)
SELECT shard, chunk_min, chunk_max,
       CASE WHEN chunk_max IS NULL THEN 'orders' || chunk_min || '-and-up.out'
            ELSE 'orders' || chunk_min || '-' || chunk_max || '.out' END AS file_name
FROM c
""")
def q_chunk_ranges(spark, sf_dir):
    from keyspan.operators.transfer import export_chunks
    m = custs_map(spark, sf_dir)
    tables = {"orders": (_t(spark, sf_dir, "orders"), "o_custkey"),
              "customer": (_t(spark, sf_dir, "customer"), "c_custkey")}
    ch = export_chunks(m, tables, "orders", ORDERS.chunks)
    return ch.select("shard", "chunk_min", "chunk_max", "file_name")


@register("chunk_rowcounts", """
WITH b AS (SELECT max(o_custkey) AS hi, greatest((max(o_custkey) + 1) // 200, 1) AS w FROM orders)
SELECT CAST((o_custkey // w) * w AS BIGINT) AS chunk_min, CAST(least((o_custkey // w) * w + w - 1, hi) AS BIGINT) AS chunk_max,
       CAST(count(*) AS BIGINT) AS n
FROM orders, b GROUP BY 1, 2
""")
def q_chunk_rowcounts(spark, sf_dir):
    from keyspan.operators.counts import chunk_rowcounts
    # 200 chunks over the whole key span
    o = _t(spark, sf_dir, "orders")
    return chunk_rowcounts(o, "o_custkey", 0, int(o.agg(F.max("o_custkey")).first()[0]), ORDERS.chunks)


# ---------------------------------------------------------------------------
# B8 even split, B10 cutover
# ---------------------------------------------------------------------------


@register("even_split_ranges", """
WITH b AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders),
p AS (SELECT lo, hi, (hi - lo + 1) // 3 AS base, (hi - lo + 1) % 3 AS extra, i
      FROM b, range(0, 3) AS r(i))
SELECT CAST(i AS INTEGER) AS piece,
       CAST(lo + i * base + least(i, extra) AS BIGINT) AS piece_min,
       CAST(lo + i * base + least(i, extra) + base + (CASE WHEN i < extra THEN 1 ELSE 0 END) - 1 AS BIGINT)
         AS piece_max,
       CAST((SELECT count(*) FROM orders o WHERE o.o_custkey BETWEEN
              lo + i * base + least(i, extra) AND
              lo + i * base + least(i, extra) + base + (CASE WHEN i < extra THEN 1 ELSE 0 END) - 1)
            AS BIGINT) AS n_rows
FROM p
""")
def q_even_split(spark, sf_dir):
    from keyspan.operators.ranges import even_split
    from keyspan.operators.rangejoin import range_join
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    bounds = o.agg(F.min("o_custkey").alias("min_id"), F.max("o_custkey").alias("max_id"))
    pieces = even_split(bounds, 3).select(F.col("piece").cast("int"), "piece_min", "piece_max")
    counted = range_join(o, "o_custkey", pieces, lo="piece_min", hi="piece_max") \
        .groupBy("piece").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return pieces.join(counted, "piece", "left") \
        .select("piece", "piece_min", "piece_max",
                F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@register("cutover_map", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
cid AS (SELECT max(o_custkey) + 1 AS c FROM orders),
nm AS (
  SELECT pool, min_id, max_id, CASE WHEN max_id IS NULL THEN 'recycle' ELSE state END AS state, name
  FROM m
  UNION ALL SELECT pool, min_id, c - 1, 'ready', pool || '-' || min_id || '-' || (c - 1)
  FROM m, cid WHERE max_id IS NULL
  UNION ALL SELECT pool, c, NULL, 'ready', pool || '-' || c || '-infinity' FROM m, cid WHERE max_id IS NULL)
SELECT nm.name AS shard, nm.min_id, nm.max_id, nm.state,
       CAST((SELECT count(*) FROM orders o WHERE nm.state <> 'recycle' AND o.o_custkey >= nm.min_id
             AND (nm.max_id IS NULL OR o.o_custkey <= nm.max_id)) AS BIGINT) AS n_rows
FROM nm
""")
def q_cutover(spark, sf_dir):
    from keyspan.operators.route import cutover
    o = _t(spark, sf_dir, "orders")
    m = custs_map(spark, sf_dir)
    # the new last shard starts after every key in use
    cid = int(o.select(F.max("o_custkey") + 1).first()[0])
    new_map = cutover(m, cid, "custs")
    from keyspan.operators.counts import shard_counts
    live = new_map.filter(F.col("state") != "recycle")
    counts = shard_counts(o, ORDERS, live).select(F.col("shard").alias("name"), "n")
    return (new_map.join(counts, "name", "left")
            .select(F.col("name").alias("shard"), "min_id", "max_id", "state",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_rows")))


# ---------------------------------------------------------------------------
# B5 next-key seek, D3 composite max, D4 global bounds
# ---------------------------------------------------------------------------


@register("next_key_seek", """
WITH k AS (SELECT DISTINCT o_custkey FROM orders)
SELECT o_custkey,
       lead(o_custkey) OVER (ORDER BY o_custkey) AS next_key,
       lag(o_custkey) OVER (ORDER BY o_custkey) AS prev_key
FROM k
""")
def q_next_key(spark, sf_dir):
    from keyspan.operators.transfer import next_keys
    return next_keys(_t(spark, sf_dir, "orders"), "o_custkey")


@register("max_composite_key", """
SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1
""")
def q_max_composite(spark, sf_dir):
    from keyspan.operators.counts import max_composite_key
    return max_composite_key(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("global_key_bounds", """
SELECT CAST(min(lo) AS BIGINT) AS min_key, CAST(max(hi) AS BIGINT) AS max_key FROM (
  SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders
  UNION ALL SELECT min(c_custkey), max(c_custkey) FROM customer)
""")
def q_global_bounds(spark, sf_dir):
    from keyspan.operators.counts import key_bounds
    return key_bounds({"orders": _t(spark, sf_dir, "orders"),
                       "customer": _t(spark, sf_dir, "customer")},
                      {"orders": "o_custkey", "customer": "c_custkey"})


@register("range_count_multi_key", """
WITH b AS (SELECT greatest(max(l_partkey), max(l_suppkey)) // 2 AS hi FROM lineitem), w AS (SELECT hi, greatest((hi + 1) // 100, 1) AS w FROM b)
SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN (l_partkey BETWEEN 0 AND hi) AND (l_suppkey BETWEEN 0 AND hi)
                      AND (l_partkey // w) <> (l_suppkey // w) THEN 2 ELSE 1 END) AS BIGINT) AS chunk_sum
FROM lineitem, w WHERE (l_partkey BETWEEN 0 AND hi) OR (l_suppkey BETWEEN 0 AND hi)
""")
def q_range_count(spark, sf_dir):
    from keyspan.operators.counts import range_count
    # the lower half of the key space in 100 chunks: a row counts twice when
    # both keys are in range and in different chunks
    li = _t(spark, sf_dir, "lineitem")
    top = int(li.agg(F.greatest(F.max("l_partkey"), F.max("l_suppkey"))).first()[0])
    return range_count(li, LINEITEM, 0, top // 2)


# ---------------------------------------------------------------------------
# Overlapping copies, drifted copy (FIXTURES.md) -- built over the whole table:
# copy A holds keys up to 60 % of the largest key, copy B from 40 %, so every
# row is in at least one copy and the middle fifth is in both.
# ---------------------------------------------------------------------------

OVERLAP_SQL = """
mx AS (SELECT max(o_orderkey) AS m FROM orders),
a AS (SELECT o.* FROM orders o, mx WHERE o.o_orderkey <= (mx.m * 6) // 10),
b AS (SELECT o.* FROM orders o, mx WHERE o.o_orderkey >= (mx.m * 4) // 10)"""

DRIFT_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders WHERE o_orderkey <> 42)"""


def _max_orderkey(o) -> int:
    """The copies' boundaries are parameters derived once from the data (one
    tiny aggregate), so each copy's filter is a literal the scan can push."""
    return int(o.select(F.max("o_orderkey")).first()[0])


def _overlap(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    m = _max_orderkey(o)
    a = o.filter(F.col("o_orderkey") <= (m * 6) // 10)
    b = o.filter(F.col("o_orderkey") >= (m * 4) // 10)
    return a, b


def _drifted(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderkey") != 42).withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")))


@register("duplicate_keys_between_shards", f"""
WITH {OVERLAP_SQL},
u AS (SELECT o_orderkey, 'a' AS s FROM a UNION ALL SELECT o_orderkey, 'b' FROM b)
SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n_rows, string_agg(s, ',' ORDER BY s) AS shards
FROM u GROUP BY o_orderkey HAVING count(DISTINCT s) > 1
""")
def q_duplicate_keys(spark, sf_dir):
    from keyspan.operators.audit import duplicate_keys
    a, b = _overlap(spark, sf_dir)
    return duplicate_keys({"a": a, "b": b}, "o_orderkey")


@register("duplicate_rows_all_pairs", """
WITH mx AS (SELECT max(o_orderkey) AS m FROM orders),
u AS (
  SELECT o_orderkey, o_custkey, o_totalprice, 's1' AS shard FROM orders, mx WHERE o_orderkey <= (m * 5) // 10
  UNION ALL
  SELECT o_orderkey, o_custkey, o_totalprice, 's2' FROM orders, mx
  WHERE o_orderkey >= (m * 4) // 10 AND o_orderkey <= (m * 8) // 10
  UNION ALL
  SELECT o_orderkey, o_custkey, o_totalprice, 's3' FROM orders, mx WHERE o_orderkey >= (m * 7) // 10),
d AS (SELECT o_orderkey, string_agg(shard, ',' ORDER BY shard) AS shards FROM u
      GROUP BY o_orderkey HAVING count(DISTINCT shard) > 1)
SELECT u.o_orderkey, u.o_custkey, u.o_totalprice, u.shard, d.shards FROM u JOIN d USING (o_orderkey)
""")
def q_duplicate_rows(spark, sf_dir):
    from keyspan.operators.audit import duplicate_rows
    o = _t(spark, sf_dir, "orders")
    m = _max_orderkey(o)
    k = F.col("o_orderkey")
    shards = {"s1": o.filter(k <= (m * 5) // 10),
              "s2": o.filter((k >= (m * 4) // 10) & (k <= (m * 8) // 10)),
              "s3": o.filter(k >= (m * 7) // 10)}
    return duplicate_rows(shards, "o_orderkey", ["o_custkey", "o_totalprice"])


@register("merge_count_validation", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
src AS (
  SELECT 'orders' AS table_name, count(*) AS n FROM orders o JOIN m
    ON o.o_custkey >= m.min_id AND (m.max_id IS NULL OR o.o_custkey <= m.max_id)
  UNION ALL
  SELECT 'customer', count(*) FROM customer c JOIN m
    ON c.c_custkey >= m.min_id AND (m.max_id IS NULL OR c.c_custkey <= m.max_id)),
mer AS (SELECT 'orders' AS table_name, count(*) AS n FROM orders
        UNION ALL SELECT 'customer', count(*) FROM customer)
SELECT s.table_name, CAST(s.n AS BIGINT) AS source_rows, CAST(mer.n AS BIGINT) AS merged_rows,
       s.n = mer.n AS valid
FROM src s JOIN mer USING (table_name)
""")
def q_merge_validation(spark, sf_dir):
    from keyspan.operators.audit import merge_count_validation
    from keyspan.operators.counts import shard_counts
    m = custs_map(spark, sf_dir)
    src = [shard_counts(_t(spark, sf_dir, s.name), s, m).select(
        F.col("shard").alias("node"), "table_name", "n") for s in (ORDERS, CUSTOMER)]
    merged = [_t(spark, sf_dir, s.name).agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit(s.name).alias("table_name"), "n") for s in (ORDERS, CUSTOMER)]
    u = src[0].unionByName(src[1])
    mu = merged[0].unionByName(merged[1])
    return merge_count_validation(u, mu)


@register("chunk_checksum_diff", f"""
WITH d AS {DRIFT_SQL},
b AS (SELECT max(o_custkey) AS hi, greatest((max(o_custkey) + 1) // 200, 1) AS w FROM orders),
only_a AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM d),
only_b AS (SELECT * FROM d EXCEPT ALL SELECT * FROM orders),
bad AS (SELECT DISTINCT (o_custkey // b.w) * b.w AS chunk_min FROM (
          SELECT o_custkey FROM only_a UNION ALL SELECT o_custkey FROM only_b), b),
ca AS (SELECT (o_custkey // b.w) * b.w AS chunk_min, count(*) AS n FROM orders, b GROUP BY 1),
cb AS (SELECT (o_custkey // b.w) * b.w AS chunk_min, count(*) AS n FROM d, b GROUP BY 1)
SELECT CAST(bad.chunk_min AS BIGINT) AS chunk_min,
       CAST(least(bad.chunk_min + b.w - 1, b.hi) AS BIGINT) AS chunk_max,
       CAST(coalesce(ca.n, 0) AS BIGINT) AS a_rows, CAST(coalesce(cb.n, 0) AS BIGINT) AS b_rows
FROM bad CROSS JOIN b LEFT JOIN ca USING (chunk_min) LEFT JOIN cb USING (chunk_min)
""")
def q_checksum_diff(spark, sf_dir):
    # chunks of the whole key span of orders, 200 of them (width floor(n/200))
    from keyspan.operators.audit import checksum_diff
    o = _t(spark, sf_dir, "orders")
    lo, hi = 0, o.select(F.max("o_custkey")).first()[0]
    cols = o.columns
    return checksum_diff(o, _drifted(spark, sf_dir), "o_custkey", lo, hi, ORDERS.chunks, cols)


@register("result_set_diff", f"""
WITH d AS {DRIFT_SQL},
qa AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
qb AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM d)
SELECT *, 'only_a' AS side FROM (SELECT * FROM qa EXCEPT ALL SELECT * FROM qb)
UNION ALL
SELECT *, 'only_b' FROM (SELECT * FROM qb EXCEPT ALL SELECT * FROM qa)
""")
def q_result_diff(spark, sf_dir):
    from keyspan.operators.audit import result_set_diff
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return result_set_diff(_t(spark, sf_dir, "orders").select(*cols),
                           _drifted(spark, sf_dir).select(*cols))


@register("import_ignore", f"""
WITH {OVERLAP_SQL},
inc AS (SELECT d.* FROM {DRIFT_SQL} d, mx WHERE d.o_orderkey >= (mx.m * 4) // 10)
SELECT o_orderkey, o_totalprice FROM a
UNION ALL
SELECT o_orderkey, o_totalprice FROM inc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
""")
def q_import_ignore(spark, sf_dir):
    from keyspan.operators.transfer import import_rows
    a, _ = _overlap(spark, sf_dir)
    m = _max_orderkey(_t(spark, sf_dir, "orders"))
    inc = _drifted(spark, sf_dir).filter(F.col("o_orderkey") >= (m * 4) // 10)
    return import_rows(a, inc, ["o_orderkey"], "ignore").select("o_orderkey", "o_totalprice")


@register("import_replace", f"""
WITH {OVERLAP_SQL},
inc AS (SELECT d.* FROM {DRIFT_SQL} d, mx WHERE d.o_orderkey >= (mx.m * 4) // 10)
SELECT o_orderkey, o_totalprice FROM inc
UNION ALL
SELECT o_orderkey, o_totalprice FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM inc)
""")
def q_import_replace(spark, sf_dir):
    from keyspan.operators.transfer import import_rows
    a, _ = _overlap(spark, sf_dir)
    m = _max_orderkey(_t(spark, sf_dir, "orders"))
    inc = _drifted(spark, sf_dir).filter(F.col("o_orderkey") >= (m * 4) // 10)
    return import_rows(a, inc, ["o_orderkey"], "replace").select("o_orderkey", "o_totalprice")


@register("multi_key_export_dedup", """
WITH b AS (SELECT greatest(max(l_partkey), max(l_suppkey)) AS hi FROM lineitem), w AS (SELECT greatest((hi + 1) // 100, 1) AS w FROM b),
c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey // w AS ch FROM lineitem, w
  UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey // w FROM lineitem, w),
files AS (SELECT DISTINCT * FROM c)
SELECT CAST(count(*) AS BIGINT) AS exported_rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM files))
            AS BIGINT) AS imported_rows
FROM files
""")
def q_multi_key_export(spark, sf_dir):
    # 100 chunks of the whole key space over both keys; a row
    # lands in one file per distinct chunk its keys hit; import dedups on pk
    from keyspan.operators.ranges import chunk_ranges, export_file_name
    from keyspan.operators.transfer import chunk_files
    li = _t(spark, sf_dir, "lineitem").select(*LINEITEM.pk)
    top = int(li.agg(F.greatest(F.max("l_partkey"), F.max("l_suppkey"))).first()[0])
    ch = chunk_ranges(spark, 0, top, LINEITEM.chunks)
    files = chunk_files(li, LINEITEM.keys, ch.withColumn(
        "file_name", export_file_name(F.lit("lineitem"), F.col("chunk_min"), F.col("chunk_max"))))
    exported = files.agg(F.count(F.lit(1)).cast("long").alias("exported_rows"))
    imported = files.select(*LINEITEM.pk).distinct().agg(
        F.count(F.lit(1)).cast("long").alias("imported_rows"))
    return exported.select("exported_rows",
                           imported.select("imported_rows").scalar().alias("imported_rows"))
