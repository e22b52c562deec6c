"""Registered report, interval-set and text queries (D11-D18, B15, E10, E11,
G4, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyspan.functions.text import WS_CLASS, parse_vertical
from keyspan.operators import intervals as iv
from keyspan.operators import report as rp
from keyspan.plans.catalog import MAP_SQL, _t, custs_map, register

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_COLS = ["p1_urgent", "p2_high", "p3_medium", "p4_not_specified", "p5_low"]


@register("order_stats", """
SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 4) AS total,
       round(var_samp(o_totalprice), 4) AS variance, round(stddev_samp(o_totalprice), 4) AS stddev,
       count(o_totalprice) AS n
FROM orders GROUP BY o_orderstatus
""")
def q_order_stats(spark, sf_dir):
    d = rp.describe(_t(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return d.select("o_orderstatus", *[F.round(c, 4).alias(c) for c in ("mean", "total", "variance", "stddev")],
                    "n")


@register("status_priority_rollup", """
SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n,
       CAST(GROUPING(o_orderstatus, o_orderpriority) AS INTEGER) AS lvl
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def q_status_rollup(spark, sf_dir):
    return rp.count_rollup(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("status_matrix", "SELECT s AS o_orderstatus, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE k = '{p}') AS BIGINT) AS {c}"
    for p, c in zip(PRIORITIES[:4], PRIORITY_COLS)) + """, CAST(count(*) AS BIGINT) AS total
FROM (SELECT CASE WHEN o_orderkey % 20 <> 3 THEN o_orderstatus END AS s,
             CASE WHEN o_orderkey % 10 <> 4 THEN o_orderpriority END AS k FROM orders)
WHERE s IS DISTINCT FROM 'P' GROUP BY s
""")
def q_status_matrix(spark, sf_dir):
    # some statuses and classes are NULL and one class is not listed: all count in the totals
    o = _t(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 20 != 3, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 10 != 4, F.col("o_orderpriority")).alias("o_orderpriority"))
    m, _ = rp.status_matrix(o, "o_orderstatus", "o_orderpriority", PRIORITIES[:4], PRIORITY_COLS[:4], "P")
    return m


@register("status_excluded", """
SELECT 'P' AS o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P'
""")
def q_status_excluded(spark, sf_dir):
    _, apart = rp.status_matrix(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority",
                                PRIORITIES, PRIORITY_COLS, "P")
    return apart


@register("location_tree", """
WITH c AS (
  SELECT r.r_name, n.n_name, cu.c_mktsegment, count(*) AS k
  FROM customer cu JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY ALL),
l AS (SELECT r_name, n_name, string_agg(c_mktsegment || '=' || CAST(k AS VARCHAR), ',' ORDER BY c_mktsegment) AS leaf
      FROM c GROUP BY ALL)
SELECT r_name, string_agg(n_name || '{' || leaf || '}', ';' ORDER BY n_name) AS tree FROM l GROUP BY r_name
""")
def q_location_tree(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    # nation and region are dimension tables; Spark broadcasts them by size
    d = c.join(n, c.c_nationkey == n.n_nationkey) \
        .join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "c_mktsegment")
    t = rp.nested_counts(d, ["r_name", "n_name"], "c_mktsegment")
    return t.select("r_name", rp.render_tree(F.col("tree")).alias("tree"))


@register("invert_shard_results", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
r AS (SELECT m.name AS shard, o.o_orderpriority, count(*) AS k
      FROM orders o JOIN m ON o.o_custkey >= m.min_id AND (m.max_id IS NULL OR o.o_custkey <= m.max_id)
      GROUP BY ALL),
t AS (SELECT shard, o_orderpriority,
             row_number() OVER (PARTITION BY shard ORDER BY k DESC, o_orderpriority) AS rk FROM r)
SELECT o_orderpriority, string_agg(shard, ',' ORDER BY shard) AS keys, CAST(count(*) AS BIGINT) AS n
FROM t WHERE rk = 1 GROUP BY o_orderpriority
""")
def q_invert_results(spark, sf_dir):
    from keyspan.operators.route import route
    m = custs_map(spark, sf_dir)
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    per = route(o, "o_custkey", m, "custs", how="inner").groupBy("shard", "o_orderpriority") \
        .agg(F.count(F.lit(1)).alias("k"))
    # one row per (shard, priority): bounded by shards x priorities
    w = Window.partitionBy("shard").orderBy(F.col("k").desc(), "o_orderpriority")
    top = per.withColumn("rk", F.row_number().over(w)).filter("rk = 1")
    return rp.invert_results(top, "shard", "o_orderpriority")


@register("first_by_priority", """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view') DESC, event_id DESC) AS rk
  FROM events) WHERE rk = 1
""")
def q_first_by_priority(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return rp.first_by_priority(e, "user_id", F.col("event_type") == "view", "event_id",
                                ["event_id", "event_type"])


DIGEST_FP_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(event_type || ' ' || props), '''[^'']*''', '?', 'g'), '"[^"]*"', '?', 'g'),
  '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g'))"""


@register("slow_query_digest", f"""
SELECT {DIGEST_FP_SQL} AS fingerprint, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total_ms,
       round(avg(value), 4) AS mean_ms, max(value) AS max_ms
FROM events GROUP BY 1 ORDER BY total_ms DESC, fingerprint LIMIT 30
""")
def q_query_digest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("stmt", F.concat_ws(" ", "event_type", "props"))
    d = rp.query_digest(e, "stmt", "value")
    return d.select("fingerprint", "calls", F.round("total_ms", 4).alias("total_ms"),
                    F.round("mean_ms", 4).alias("mean_ms"), "max_ms")


@register("poll_stats", """
SELECT event_type, greatest(max(CAST(trunc(value) AS BIGINT)), 0) AS max_value,
       sum(CAST(trunc(value) AS BIGINT)) / 8.0 AS avg_value
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 8 GROUP BY event_type
""")
def q_poll_stats(spark, sf_dir):
    return rp.poll_stats(_t(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")


@register("sample_keys", """
SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey & 7) = 2
""")
def q_sample_keys(spark, sf_dir):
    return rp.deterministic_sample(_t(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_custkey")


POLLS_SQL = """p AS (SELECT event_type, ts, event_id, CAST(floor(value / 100) AS BIGINT) AS cur,
          sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                                  ROWS UNBOUNDED PRECEDING) AS counter FROM events)"""


@register("counter_deltas", f"""
WITH {POLLS_SQL},
d AS (SELECT *, counter - lag(counter) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS delta FROM p)
SELECT event_type, CAST(count(*) AS BIGINT) AS polls,
       CAST(count(*) FILTER (WHERE cur > 4 OR coalesce(delta > 1, false)) AS BIGINT) AS taking,
       CAST(count(*) FILTER (WHERE coalesce(delta <> 0, false)) AS BIGINT) AS moved
FROM d GROUP BY event_type
""")
def q_counter_deltas(spark, sf_dir):
    from keyspan.operators.scan import grouped_scan
    e = _t(spark, sf_dir, "events").select(
        "event_type", "ts", "event_id", F.floor(F.col("value") / 100).cast("long").alias("cur"),
        F.floor("value").cast("long").alias("__inc"))
    p = grouped_scan(e, ["event_type"], ["ts", "event_id"], "__inc", "sum", "counter")
    d = rp.counter_deltas(p, "event_type", ["ts", "event_id"], "counter", "cur")
    return d.groupBy("event_type").agg(F.count(F.lit(1)).cast("long").alias("polls"),
                                       F.count_if("taking").cast("long").alias("taking"),
                                       F.count_if("moved").cast("long").alias("moved"))


@register("caught_up", """
WITH p AS (SELECT event_type, ts, event_id, CASE WHEN floor(value / 50) = 0 THEN 1 ELSE 0 END AS z FROM events),
s AS (SELECT *, sum(z) OVER w AS zc, sum(1 - z) OVER w AS isl FROM p
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
st AS (SELECT event_type, isl, min(zc - z) AS zs FROM s GROUP BY ALL),
hit AS (SELECT s.event_type, min(s.event_id) AS caught_up_at FROM s JOIN st USING (event_type, isl)
        WHERE s.z = 1 AND s.zc - st.zs >= 3 GROUP BY s.event_type)
SELECT e.event_type, CAST(count(*) AS BIGINT) AS polls, CAST(0 AS BIGINT) AS broken_polls, hit.caught_up_at
FROM events e LEFT JOIN hit USING (event_type) GROUP BY e.event_type, hit.caught_up_at
""")
def q_caught_up(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", "ts", "event_id",
                                           F.floor(F.col("value") / 50).cast("long").alias("lag"))
    # polls are ordered by (ts, event_id); event ids grow with ts, so the
    # first poll completing the run is also the smallest id among hits
    return rp.caught_up(e, "event_type", ["ts", "event_id"], "lag", "event_id")


@register("interval_set_extra", """
WITH a AS (SELECT DISTINCT event_type AS source, event_id AS id FROM events),
b AS (SELECT DISTINCT event_type AS source, event_id AS id FROM events WHERE value < 300),
d AS (SELECT * FROM a EXCEPT SELECT * FROM b),
r AS (SELECT source, id, id - row_number() OVER (PARTITION BY source ORDER BY id) AS isl FROM d)
SELECT source, min(id) AS lo, max(id) AS hi FROM r GROUP BY source, isl
""")
def q_interval_extra(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id", "value")
    a = iv.ids_to_intervals(e, ["source"], "event_id")
    b = iv.ids_to_intervals(e.filter(F.col("value") < 300), ["source"], "event_id")
    return iv.interval_difference(a, b, ["source"])


@register("interval_set_merge", """
WITH a AS (SELECT DISTINCT user_id % 7 AS source, event_id // 3 AS id FROM events),
r AS (SELECT source, id, id - row_number() OVER (PARTITION BY source ORDER BY id) AS isl FROM a)
SELECT CAST(source AS BIGINT) AS source, min(id) AS lo, max(id) AS hi FROM r GROUP BY source, isl
""")
def q_interval_merge(spark, sf_dir):
    # overlapping and touching intervals [event_id // 3, event_id // 3] merge
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("source"),
                                           F.floor(F.col("event_id") / 3).cast("long").alias("lo"))
    return iv.merge_intervals(e.withColumn("hi", F.col("lo")), ["source"])


VERTICAL_SQL = f"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS i FROM pages),
p AS (SELECT page_id, i, string_split(line, ':') AS parts FROM l),
k AS (SELECT page_id, lower(regexp_replace(parts[1], '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')) AS key,
             arg_max(regexp_replace(parts[2], '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g'), i) AS value
      FROM p WHERE len(list_filter(parts[2:], lambda x: x <> '')) > 0 GROUP BY ALL)
SELECT key, CAST(count(*) AS BIGINT) AS n_docs, min(md5(value)) AS least_value, max(md5(value)) AS most_value FROM k GROUP BY key
"""


@register("vertical_pairs", VERTICAL_SQL)
def q_vertical_pairs(spark, sf_dir):
    # raw pages: every line with a colon is a ``key: value`` pair, the last of a key wins
    d = _t(spark, sf_dir, "pages").select("page_id", parse_vertical(F.col("html")).alias("kv"))
    k = d.select("page_id", F.explode("kv").alias("key", "value"))
    return k.groupBy("key").agg(F.count(F.lit(1)).cast("long").alias("n_docs"), F.min(F.md5("value")).alias("least_value"),
                                F.max(F.md5("value")).alias("most_value"))
