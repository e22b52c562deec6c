"""Registered queries for composite jobs (K*), streams (I*) and sources (A*).

Jobs that write use fresh folders under the shared checkpoint dir (the
cluster's ``spark.checkpoint.dir``) and return what they read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.plans.catalog import DRIFT_SQL, MAP_SQL, SPLIT_MAP_SQL, _drifted, _t, custs_map, custs_split_map, register
from keyspan.session import scratch_path
from keyspan.spec import CUSTOMER, LINEITEM, ORDERS, shard_map_from_rows

NOW = 1706659200


KIDS_SQL = """b AS (SELECT max(o_custkey) + 1 AS n FROM orders),
p AS (SELECT i, i * (n // {k}) + least(i, n % {k}) AS a,
             i * (n // {k}) + least(i, n % {k}) + n // {k} + CASE WHEN i < n % {k} THEN 1 ELSE 0 END - 1 AS z
      FROM b, range(0, {k}) r(i))"""


def _one_shard(spark, sf_dir):
    """A map with one shard that holds every order, and its name."""
    top = int(_t(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0])
    return shard_map_from_rows(spark, [("custs", 0, top, "ready")]), f"custs-0-{top}"


@register("split_shard_counts", f"""
WITH {KIDS_SQL.format(k=3)}
SELECT 'custs-' || a || '-' || z AS shard, CAST(a AS BIGINT) AS min_id, CAST(z AS BIGINT) AS max_id,
       CAST((SELECT count(*) FROM orders WHERE o_custkey BETWEEN a AND z) AS BIGINT) AS n_rows
FROM p
""")
def q_split_counts(spark, sf_dir):
    """K1: the job splits the shard that holds all orders in three and counts
    what it wrote."""
    from keyspan.plans.jobs import split
    m, parent = _one_shard(spark, sf_dir)
    res = split(_t(spark, sf_dir, "orders"), ORDERS, m, parent, scratch_path(spark, "split"), n=3)
    kids = res.shard_map.filter(F.col("parent") == parent)
    return kids.select(F.col("name").alias("shard"), "min_id", "max_id").join(res.counts, "shard", "left") \
        .select("shard", "min_id", "max_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))


@register("split_cleanup_prune", f"""
WITH {KIDS_SQL.format(k=2)}
SELECT 'custs-' || a || '-' || z AS shard,
       CAST(count(*) FILTER (WHERE o_custkey BETWEEN a AND z) AS BIGINT) AS kept_rows,
       CAST(count(*) FILTER (WHERE NOT (o_custkey BETWEEN a AND z)) AS BIGINT) AS pruned_rows
FROM p, orders GROUP BY a, z
""")
def q_split_cleanup(spark, sf_dir):
    """K5: each child starts as a full clone of the parent's data and is
    pruned to its own range (B4)."""
    from keyspan.plans.jobs import child_ranges, split_cleanup
    m, parent = _one_shard(spark, sf_dir)
    m = m.withColumn("state", F.lit("deprecated")).unionByName(child_ranges(m, parent, 2, state="needs_cleanup"))
    clone = _t(spark, sf_dir, "orders").select("o_custkey")
    kids = [r["name"] for r in m.filter("parent is not null").select("name").collect()]
    _, pruned = split_cleanup(m, parent, {k: clone for k in kids}, ORDERS)
    total = clone.agg(F.count(F.lit(1)).alias("t"))
    parts = [p.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(k).alias("shard"), "kept")
             for k, p in pruned.items()]
    u = parts[0].unionByName(parts[1])
    t = total.select("t").scalar()
    return u.select("shard", F.col("kept").cast("long").alias("kept_rows"),
                    (t - F.col("kept")).cast("long").alias("pruned_rows"))


CC_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@register("consistency_check_rows", f"""
WITH d AS {DRIFT_SQL},
qa AS (SELECT {CC_COLS} FROM orders), qb AS (SELECT {CC_COLS} FROM d)
SELECT *, 'only_a' AS side FROM (SELECT * FROM qa EXCEPT ALL SELECT * FROM qb)
UNION ALL
SELECT *, 'only_b' FROM (SELECT * FROM qb EXCEPT ALL SELECT * FROM qa)
""")
def q_consistency(spark, sf_dir):
    """K9: chunk checksums first (C10), row diff only inside differing chunks."""
    from keyspan.plans.jobs import consistency_check
    o = _t(spark, sf_dir, "orders")
    hi = o.select(F.max("o_custkey")).first()[0]
    d = consistency_check(o, _drifted(spark, sf_dir), "o_custkey", 0, hi, ORDERS.chunks)
    return d.select(*[c.strip() for c in CC_COLS.split(",")], "side")


@register("schema_change_verify", f"""
WITH m AS (SELECT * FROM {MAP_SQL})
SELECT m.name AS shard, CASE WHEN m.seq = 0 THEN 'preflight' ELSE 'rest' END AS phase,
       CAST(count(o.o_orderkey) AS BIGINT) AS rows_before, CAST(count(o.o_orderkey) AS BIGINT) AS rows_after,
       true AS ok
FROM m LEFT JOIN orders o ON o.o_custkey >= m.min_id AND (m.max_id IS NULL OR o.o_custkey <= m.max_id)
GROUP BY m.name, m.seq
""")
def q_schema_change(spark, sf_dir):
    """K7 dry run: add ``my_new_column INT`` on every shard, preflight on the
    first, verify counts and a checksum of the untouched columns."""
    from keyspan.operators.route import route
    from keyspan.plans.jobs import schema_change
    m = custs_map(spark, sf_dir)
    routed = route(_t(spark, sf_dir, "orders"), "o_custkey", m, "custs", how="inner")
    first = m.where("seq = 0").select("name").first()["name"]
    return schema_change(routed, lambda d: d.withColumn("my_new_column", F.lit(None).cast("int")),
                         scratch_path(spark, "alter"), preflight=first, dry_run=True,
                         shards=m.select("name"))


@register("rebuild_check", """
SELECT 'lineitem' AS table_name, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS actual,
       true AS match FROM lineitem
""")
def q_rebuild(spark, sf_dir):
    """K6: range-partitioned, sorted rewrite of lineitem with a count check."""
    from keyspan.plans.jobs import rebuild
    return rebuild(_t(spark, sf_dir, "lineitem"), LINEITEM, scratch_path(spark, "rebuild"))


# --- sources ------------------------------------------------------------------------


@register("tracker_roundtrip", f"""
WITH m AS (SELECT * FROM {SPLIT_MAP_SQL}),
cand AS (SELECT * FROM m WHERE NOT (parent IS NOT NULL AND state NOT IN
         ('merging', 'ready', 'child', 'needs_cleanup', 'read_only', 'offline'))),
hits AS (SELECT o.o_orderkey, c.name,
         row_number() OVER (PARTITION BY o.o_orderkey ORDER BY (c.parent IS NULL), c.seq) AS rk
         FROM orders o JOIN cand c ON o.o_custkey >= c.min_id AND (c.max_id IS NULL OR o.o_custkey <= c.max_id))
SELECT name AS shard, CAST(count(*) AS BIGINT) AS n FROM hits WHERE rk = 1 GROUP BY name
""")
def q_tracker(spark, sf_dir):
    """Write the shard map as tracker JSON, read it back, route with it."""
    from keyspan.operators.route import route
    from keyspan.sources.tracker import read_tracker, write_tracker
    path = scratch_path(spark, "tracker")
    write_tracker(custs_split_map(spark, sf_dir), path)
    m = read_tracker(spark, path)
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    return route(o, "o_custkey", m, "custs", how="inner").groupBy("shard") \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("manifest_diff", """
SELECT 'docs/' || source || '/' || doc_id || '.txt' AS rel_path, n_chars AS length,
       CASE WHEN doc_id % 11 = 3 THEN NULL ELSE n_chars + 1 END AS target_length,
       CASE WHEN doc_id % 11 = 3 THEN 'missing' ELSE 'size' END AS problem
FROM documents WHERE doc_id % 11 = 3 OR doc_id % 13 = 5
""")
def q_manifest(spark, sf_dir):
    """C9 on the manifest of the documents (a file each, its length the number
    of characters) and a copy that lacks some, has some longer and more of its
    own."""
    from keyspan.operators.audit import manifest_diff
    d = _t(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    src = d.select(path.alias("rel_path"), F.col("n_chars").alias("length"))
    tgt = d.filter("doc_id % 11 <> 3").select(path.alias("rel_path"), F.expr(
        "if(doc_id % 13 = 5, n_chars + 1, n_chars)").alias("length"))
    extra = d.select(F.concat(F.lit("own/"), F.col("doc_id").cast("string")).alias("rel_path"), F.col("n_chars").alias("length"))
    return manifest_diff(src, tgt.unionByName(extra))


SCHEMA_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "lineitem": ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                 "l_returnflag l_linestatus l_shipdate"),
}
DATA_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
    for t, names in SCHEMA_COLUMNS.items() for c in names.split())
UNIQUE_SQL = " UNION ALL ".join(
    f"SELECT '{s.name}' AS u, count(*) = count(DISTINCT ({', '.join(s.pk)})) AS pk_unique FROM {s.name}"
    for s in (ORDERS, CUSTOMER, LINEITEM))


@register("schema_detect", f"""
WITH data AS ({DATA_SQL}), uniq AS ({UNIQUE_SQL})
SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                      WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END
         AS data_type,
       true AS nullable,
       column_name IN ('o_orderkey', 'c_custkey', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey') AS is_pk,
       CAST(CASE column_name WHEN 'o_orderkey' THEN 1 WHEN 'c_custkey' THEN 1 WHEN 'l_orderkey' THEN 1
            WHEN 'l_linenumber' THEN 2 WHEN 'l_partkey' THEN 3 WHEN 'l_suppkey' THEN 4 END AS INTEGER) AS pk_seq,
       column_name IN ('o_custkey', 'c_custkey', 'l_partkey', 'l_suppkey') AS is_shard_key,
       data.n_rows, data.n_nulls, uniq.pk_unique
FROM information_schema.columns JOIN data ON table_name = t AND column_name = c JOIN uniq ON table_name = u
""")
def q_schema(spark, sf_dir):
    """A10 held against the data: declared columns and keys with the rows and
    NULLs found, and whether the declared primary key is one."""
    from keyspan.sources.schema import detect_schema, profile
    parts = []
    for spec in (ORDERS, CUSTOMER, LINEITEM):
        df = _t(spark, sf_dir, spec.name)
        parts.append(detect_schema(spark, df, spec).join(profile(df, spec), "column_name"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("snapshot_block_growth", """
WITH inc AS (SELECT event_type AS pool, ts AS ts0, event_id AS id,
                    CAST(round(value * 100) AS BIGINT) * 10000 AS inc FROM events),
hist AS (SELECT pool, CAST(epoch_us(ts0) // 1000000 AS BIGINT) AS ts, id,
                sum(inc) OVER (PARTITION BY pool ORDER BY ts0, id ROWS UNBOUNDED PRECEDING) AS used FROM inc),
h AS (SELECT pool, ts, min(id) AS first_id, arg_max(used, id) AS used FROM hist GROUP BY pool, ts),
blk AS (SELECT pool, count(*) AS n, arg_min(used, first_id) AS fu, arg_min(ts, first_id) AS ft,
               arg_max(used, first_id) AS lu, arg_max(ts, first_id) AS lt
        FROM h WHERE ts BETWEEN 1706572800 AND 1706659200 GROUP BY pool)
SELECT pool, CAST(n AS BIGINT) AS n,
       round(CASE WHEN ft = lt THEN NULL ELSE CAST(fu - lu AS DOUBLE) / CAST(ft - lt AS DOUBLE) END, 6) AS rate
FROM blk
""")
def q_snapshot_block(spark, sf_dir):
    """A12 + A13 + D7: store the history as day-partitioned snapshots, then
    read each pool's last-day block (day partitions pruned) and its growth."""
    from keyspan.operators.capacity import block_growth_by_pool, dedup_history, history_from_events
    from keyspan.sources.schema import history_block, store_snapshot
    path = scratch_path(spark, "history")
    store_snapshot(history_from_events(_t(spark, sf_dir, "events")), path)
    hist = spark.read.parquet(path)
    blk = dedup_history(history_block(hist, None, NOW - 86400, NOW).drop("day"))
    g = block_growth_by_pool(blk)
    return g.select("pool", F.col("n").cast("long"), F.round("rate", 6).alias("rate"))


# --- streams -------------------------------------------------------------------------


def _merger(spark, sf_dir):
    from keyspan.streaming.merge import StreamMerger, write_change_sources
    e = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    root = scratch_path(spark, "streams")
    srcs = write_change_sources(e, F.col("user_id") % 3, f"{root}/in", "event_id")
    merger = StreamMerger(spark, e.schema, ["user_id"], "event_id", f"{root}/out")
    for name, path in srcs.items():
        merger.add_source(name, path)
    merger.run_available_now()
    return merger


@register("stream_merge", """
SELECT user_id, event_id, ts, event_type, value, CAST(user_id % 3 AS VARCHAR) AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1
""")
def q_stream_merge(spark, sf_dir):
    """Three change streams (user_id % 3) merged into one table keyed by
    user: many changes per key, the latest wins."""
    return _merger(spark, sf_dir).merged()


@register("stream_progress", f"""
SELECT CAST(user_id % 3 AS VARCHAR) AS source, CAST(count(*) AS BIGINT) AS rows, max(event_id) AS position,
       max(ts) AS last_ts, {NOW} - CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) AS lag_seconds
FROM events GROUP BY 1
""")
def q_stream_progress(spark, sf_dir):
    """Position and lag per source after an available-now run."""
    return _merger(spark, sf_dir).progress(NOW)


@register("furthest_position", """
SELECT event_type, furthest_node, fileno, event_id FROM (
  SELECT event_type, user_id AS furthest_node, CAST(dayofmonth(ts) AS INTEGER) AS fileno, event_id,
         row_number() OVER (PARTITION BY event_type ORDER BY dayofmonth(ts) DESC, event_id DESC) AS rk
  FROM events) WHERE rk = 1
""")
def q_furthest(spark, sf_dir):
    """I4/I8: per pool the furthest replica position (file number = day)."""
    from keyspan.streaming.merge import furthest_position
    e = _t(spark, sf_dir, "events").select("event_type", "user_id", "event_id",
                                           F.dayofmonth("ts").cast("int").alias("fileno"))
    return furthest_position(e, "event_type", "user_id", "fileno", "event_id")


@register("caught_up_stream", """
WITH p AS (SELECT event_type, event_id, CASE WHEN floor(value / 50) = 0 THEN 1 ELSE 0 END AS z,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
s AS (SELECT *, sum(z) OVER w AS zc, sum(1 - z) OVER w AS isl FROM p
      WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
st AS (SELECT event_type, isl, min(zc - z) AS zs FROM s GROUP BY ALL),
hit AS (SELECT s.event_type, s.event_id, s.k,
               row_number() OVER (PARTITION BY s.event_type ORDER BY s.event_id) AS r
        FROM s JOIN st USING (event_type, isl) WHERE s.z = 1 AND s.zc - st.zs >= 3)
SELECT event_type AS node, 'caught_up' AS status, CAST(k AS BIGINT) AS polls, event_id AS at_seq FROM hit WHERE r = 1
""")
def q_caught_up_stream(spark, sf_dir):
    """The stateful detector run as a stream over polls that come out of
    order, sink read back."""
    from keyspan.operators.scan import grouped_scan
    from keyspan.streaming.monitor import caught_up_stream
    e = _t(spark, sf_dir, "events").select("event_type", "event_id",
                                           F.floor(F.col("value") / 50).alias("lag"))
    # a poll's number in its node; every file holds polls from all over, and a file is a batch
    e = grouped_scan(e.withColumn("one", F.lit(1)), ["event_type"], ["event_id"], "one", "sum", "number").drop("one")
    e = e.repartition(5, F.xxhash64("event_id"))
    root = scratch_path(spark, "caughtup")
    e.write.mode("overwrite").parquet(f"{root}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = caught_up_stream(s, "event_type", "event_id", "lag", timeout_s=None, number="number", first=1)
    q = (out.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").filter(F.col("status") == "caught_up")


# --- more transfer / routing / report coverage ---------------------------------------


@register("export_rows_roundtrip", """
SELECT * FROM orders WHERE o_custkey >= (SELECT max(o_custkey) // 10 FROM orders)
""")
def q_export_roundtrip(spark, sf_dir):
    """Range export as tab-separated text (``\\N`` nulls),
    sorted within partitions by the key, and import back with the schema."""
    from keyspan.operators.transfer import export_range, read_tsv, write_tsv
    from keyspan.spec import TableSpec
    o = _t(spark, sf_dir, "orders")
    spec = TableSpec("orders", keys=("o_custkey",), pk=("o_orderkey",), chunks=200, order_by=("o_custkey",))
    path = scratch_path(spark, "export")
    top = int(o.agg(F.max("o_custkey")).first()[0])
    write_tsv(export_range(o, spec, top // 10, top), path)
    return read_tsv(spark, path, o.schema)


@register("chunked_export_counts", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
mx AS (SELECT CAST(floor(max(k) * 1.2) AS BIGINT) AS top FROM (
         SELECT max(o_custkey) AS k FROM orders UNION ALL SELECT max(c_custkey) FROM customer)),
b AS (SELECT m.min_id AS lo, coalesce(m.max_id, greatest(mx.top, m.min_id - 1)) AS hi,
             m.max_id IS NULL AS open FROM m, mx),
w AS (SELECT *, greatest((hi - lo + 1) // 200, 1) AS width FROM b),
c AS (SELECT CAST(s AS BIGINT) AS chunk_min, CAST(least(s + width - 1, hi) AS BIGINT) AS chunk_max
      FROM w, unnest(generate_series(lo, hi, width)) AS t(s)
      UNION ALL SELECT CAST(hi + 1 AS BIGINT), CAST(NULL AS BIGINT) FROM w WHERE open),
f AS (SELECT CASE WHEN chunk_max IS NULL THEN 'orders' || chunk_min || '-and-up.out'
                  ELSE 'orders' || chunk_min || '-' || chunk_max || '.out' END AS file_name,
             chunk_min, chunk_max FROM c)
SELECT f.file_name, CAST(count(*) AS BIGINT) AS rows FROM orders o
JOIN f ON o.o_custkey >= f.chunk_min AND (f.chunk_max IS NULL OR o.o_custkey <= f.chunk_max)
GROUP BY f.file_name
""")
def q_chunked_export(spark, sf_dir):
    """A3/A4/A5: every chunk of every shard written as its own partition in
    one job; the per-file counts come back (their sum = rows exported)."""
    from keyspan.operators.transfer import export_chunked, export_chunks
    m = custs_map(spark, sf_dir)
    o = _t(spark, sf_dir, "orders")
    tables = {"orders": (o, "o_custkey"), "customer": (_t(spark, sf_dir, "customer"), "c_custkey")}
    ch = export_chunks(m, tables, "orders", ORDERS.chunks)
    return export_chunked(o, ORDERS, ch, scratch_path(spark, "chunks"))


@register("schema_copy", "SELECT * FROM orders")
def q_schema_copy(spark, sf_dir):
    """An empty table with the source schema, written, then loaded with
    the source's rows under that schema and read back."""
    from keyspan.operators.transfer import empty_like
    o = _t(spark, sf_dir, "orders")
    path = scratch_path(spark, "schema")
    empty_like(o).write.mode("overwrite").parquet(path)
    copied = spark.read.schema(o.schema).parquet(path).schema
    o.select(*[F.col(f.name).cast(f.dataType) for f in copied]).write.mode("append").parquet(path)
    return spark.read.schema(copied).parquet(path)


@register("key_projection", """
WITH mx AS (SELECT max(o_orderkey) AS m FROM orders),
k AS (SELECT o_orderkey FROM orders, mx WHERE o_orderkey >= (m * 4) // 10 AND o_orderkey <= (m * 6) // 10)
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM k)
""")
def q_key_projection(spark, sf_dir):
    """The fields of the duplicate keys found between two copies, by a
    semi-join (never a literal IN list)."""
    from keyspan.operators.audit import duplicate_keys
    from keyspan.operators.transfer import project_for_keys
    from keyspan.plans.catalog import _overlap
    a, b = _overlap(spark, sf_dir)
    dups = duplicate_keys({"a": a, "b": b}, "o_orderkey")
    return project_for_keys(_t(spark, sf_dir, "orders"), dups, "o_orderkey", ["o_orderkey", "o_totalprice"])


@register("split_ranges_check", """
WITH g AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders),
blocks AS (SELECT min(o_custkey) AS a, max(o_custkey) AS z FROM orders GROUP BY o_custkey // 16),
pieces AS (SELECT 'blocks' AS kind, a, z FROM blocks
           UNION ALL SELECT 'joined', a, coalesce(lead(a) OVER (ORDER BY a) - 1, z) FROM blocks
           UNION ALL SELECT 'short', a, lead(a) OVER (ORDER BY a) - 1 FROM blocks
             QUALIFY lead(a) OVER (ORDER BY a) IS NOT NULL),
p AS (SELECT *, lag(z) OVER (PARTITION BY kind ORDER BY a) AS before FROM pieces),
f AS (SELECT kind, coalesce(max(before + 1 <> a), false) AS has_gaps, min(a) = any_value(lo) AS covers_start,
             max(z) = any_value(hi) AS covers_end FROM p, g GROUP BY kind)
SELECT *, NOT has_gaps AND covers_start AND covers_end AS ok FROM f
""")
def q_split_check(spark, sf_dir):
    """B9 on ranges found in the data: the keys in use per block of 16 (with
    whatever gaps there are), the blocks joined up, and those without the last."""
    from pyspark.sql import Window
    from keyspan.operators.ranges import check_contiguous
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    lo, hi = o.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    blocks = o.groupBy(F.expr("o_custkey div 16").alias("b")).agg(F.min("o_custkey").alias("min_id"),
                                                                  F.max("o_custkey").alias("max_id"))
    # one row per block of keys: split ranges are few, and this stands in for them
    following = F.lead("min_id").over(Window.orderBy("min_id")) - 1
    joined = blocks.withColumn("next", following)
    kinds = {"blocks": blocks, "joined": joined.withColumn("max_id", F.coalesce("next", "max_id")),
             "short": joined.filter("next is not null").withColumn("max_id", F.col("next"))}
    out = None
    for kind, pieces in kinds.items():
        row = check_contiguous(pieces.select("min_id", "max_id"), lo, hi).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


TARGET_MAP = [
    ("custs", 0, 39, "merging"), ("custs", 40, 99, "merging"), ("custs", 0, 99, "initialized"),
    ("custs", 100, 999, "ready"), ("custs", 100, 549, "child", "custs-100-999"),
    ("custs", 550, 999, "replicating", "custs-100-999"), ("custs", 1000, None, "read_only"),
]


def _target_sql():
    from keyspan.spec import shard_map_sql_values
    return f"""
WITH m AS (SELECT * FROM {shard_map_sql_values(TARGET_MAP)}),
cand AS (SELECT * FROM m WHERE NOT (parent IS NOT NULL AND state NOT IN
         ('merging', 'ready', 'child', 'needs_cleanup', 'read_only', 'offline'))),
hits AS (SELECT o.o_orderkey, c.name, row_number() OVER (PARTITION BY o.o_orderkey
                ORDER BY (c.parent IS NULL), c.seq) AS rk
         FROM orders o JOIN cand c ON o.o_custkey >= c.min_id AND (c.max_id IS NULL OR o.o_custkey <= c.max_id)),
cover AS (SELECT a.name, (SELECT b.name FROM m b WHERE b.pool = a.pool AND b.max_id IS NOT NULL
                          AND b.state IN ('initialized', 'ready') AND b.min_id <= a.min_id
                          AND b.max_id >= a.max_id AND b.name <> a.name ORDER BY b.seq LIMIT 1) AS merged
          FROM m a WHERE a.max_id IS NOT NULL),
t AS (SELECT m.name, CASE WHEN m.state IN ('ready', 'needs_cleanup', 'child', 'read_only') THEN m.name
                          WHEN m.state = 'merging' THEN cover.merged END AS read_target,
                     CASE WHEN m.state IN ('ready', 'needs_cleanup', 'merging') THEN m.name
                          WHEN m.state = 'child' THEN m.parent END AS write_target
      FROM m LEFT JOIN cover USING (name))
SELECT h.name AS shard, t.read_target, t.write_target, CAST(count(*) AS BIGINT) AS n
FROM hits h JOIN t ON t.name = h.name WHERE h.rk = 1 GROUP BY ALL
"""


@register("route_targets_orders", _target_sql())
def q_route_targets(spark, sf_dir):
    """B13 + C2: every order's read and write target under a map where two
    shards are being merged and one is being split."""
    from keyspan.operators.route import route_targets
    m = shard_map_from_rows(spark, TARGET_MAP)
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    r = route_targets(o, "o_custkey", m, "custs")
    return r.filter(F.col("shard").isNotNull()).groupBy("shard", "read_target", "write_target") \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("smallest_replica", """
WITH mounts AS (SELECT event_type AS pool, CAST(user_id % 3 AS INTEGER) AS seq,
                       'node-' || CAST(user_id % 3 AS VARCHAR) AS node,
                       CAST(count(*) * 1000000 AS BIGINT) AS total,
                       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used
                FROM events GROUP BY ALL)
SELECT pool, node, total, used, total - used AS available FROM (
  SELECT *, row_number() OVER (PARTITION BY pool ORDER BY total, seq) AS rk FROM mounts) WHERE rk = 1
""")
def q_smallest_replica(spark, sf_dir):
    """Per pool, the mount stats of the copy with the smallest capacity
    (copies = the three change-stream sources of each pool)."""
    from keyspan.operators.capacity import smallest_replica
    e = _t(spark, sf_dir, "events")
    mounts = e.groupBy(F.col("event_type").alias("pool"), (F.col("user_id") % 3).cast("int").alias("seq")) \
        .agg((F.count(F.lit(1)) * 1000000).cast("long").alias("total"),
             F.sum(F.round(F.col("value") * 100).cast("long")).cast("long").alias("used")) \
        .withColumn("node", F.concat(F.lit("node-"), F.col("seq").cast("string"))) \
        .withColumn("available", F.col("total") - F.col("used"))
    return smallest_replica(mounts)


@register("command_counters", """
SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS window_start,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS com_select,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS com_insert,
       CAST(count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase')) AS BIGINT) AS com_delete
FROM events GROUP BY ALL
""")
def q_command_counters(spark, sf_dir):
    """I5 in batch form: per node (user) and one-second window, commands by
    kind (view = SELECT, purchase = INSERT, the rest DELETE)."""
    from keyspan.streaming.monitor import command_counters
    g = command_counters(_commands(spark, sf_dir), "ts", "user_id", "cmd")
    return g.select("user_id", F.unix_seconds("window.start").alias("window_start"),
                    *[F.col(f"com_{k}").cast("long") for k in ("select", "insert", "delete")])


def _commands(spark, sf_dir):
    kind = (F.when(F.col("event_type") == "view", "SELECT").when(F.col("event_type") == "purchase", "INSERT")
            .otherwise("DELETE"))
    return _t(spark, sf_dir, "events").select("user_id", "ts", kind.alias("cmd"))


@register("backfill_tail", """
WITH s AS (SELECT max(event_id) // 2 AS cut, max(user_id) // 2 AS top FROM events),
c AS (SELECT user_id, event_id, CASE WHEN event_id > cut THEN value + 1 ELSE value END AS value FROM events, s)
SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM c, s WHERE user_id <= top GROUP BY user_id
""")
def q_backfill_tail(spark, sf_dir):
    """A snapshot with the latest row per user and the position it was
    taken at, the changes after that position applied on key, then the rows
    outside the shard range pruned."""
    from keyspan.streaming.merge import backfill_and_tail, latest_per_key
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    last, top = e.agg(F.max("event_id"), F.max("user_id")).first()
    path = scratch_path(spark, "backfill")
    latest_per_key(e.filter(F.col("event_id") <= last // 2), ["user_id"], "event_id").write.parquet(path)
    snap = spark.read.parquet(path)
    taken_at = snap.agg(F.max("event_id")).first()[0]      # the recorded offset
    changes = e.withColumn("value", F.col("value") + 1)
    return backfill_and_tail(snap, changes, ["user_id"], "event_id", taken_at,
                             keep=F.col("user_id") <= top // 2)


@register("merge_shards", f"""
WITH {KIDS_SQL.format(k=2)}
SELECT 'orders' AS table_name, (SELECT CAST(count(*) AS BIGINT) FROM orders JOIN p ON o_custkey BETWEEN a AND z) AS source_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM orders) AS merged_rows,
       (SELECT count(*) FROM orders JOIN p ON o_custkey BETWEEN a AND z) = (SELECT count(*) FROM orders) AS valid
""")
def q_merge_shards(spark, sf_dir):
    """K2/K3: merge the two halves of orders (duplicate check, union, write,
    count validation)."""
    from keyspan.operators.route import route
    from keyspan.plans.jobs import child_ranges, merge
    m, parent = _one_shard(spark, sf_dir)
    kids = child_ranges(m, parent, 2)
    routed = route(_t(spark, sf_dir, "orders"), "o_custkey", kids, "custs", how="inner")
    names = [r["name"] for r in kids.select("name").collect()]
    parts = {n: routed.filter(F.col("shard") == n).drop("shard") for n in names}
    return merge(parts, ORDERS, scratch_path(spark, "merge"))


@register("command_counters_stream", """
SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS window_start,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS com_select,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS com_insert,
       CAST(count(*) FILTER (WHERE event_type NOT IN ('view', 'purchase')) AS BIGINT) AS com_delete
FROM events GROUP BY ALL
""")
def q_command_counters_stream(spark, sf_dir):
    """I5 as a stream: one-second windows per node without a watermark; each
    batch writes the windows that it changed under its number, and of a
    window's rows the last batch's counts."""
    from keyspan.streaming.monitor import command_counters
    e = _commands(spark, sf_dir)
    root = scratch_path(spark, "counters")
    e.write.mode("overwrite").parquet(f"{root}/in")
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    counts = command_counters(s, "ts", "user_id", "cmd")

    def keep(batch, number):
        # the folder is the batch's own, so a batch that is run again writes the same
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/n={number}")

    q = (counts.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/ckpt")
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    kinds = ["com_select", "com_insert", "com_delete"]
    last = F.max_by(F.struct(*kinds), F.col("batch")).alias("c")
    return (spark.read.parquet(f"{root}/out").groupBy("user_id", "window").agg(last)
            .select("user_id", F.unix_seconds("window.start").alias("window_start"), *[F.col(f"c.{k}").cast("long").alias(k) for k in kinds]))
