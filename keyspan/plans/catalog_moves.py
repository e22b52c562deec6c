"""Registered queries that run the row-moving jobs end to end (K1, K2, K4, K6,
K7, I4), full text round trips (A1, A2, A6) and audits on copies that were
tampered with (C10, K9).  Ranges and maps derive from the data's largest key,
so every query reads its whole table at any scale.  Jobs write under the shared
checkpoint folder and the queries return the rows that were written."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.plans.catalog import _t, register
from keyspan.session import scratch_path
from keyspan.spec import LINEITEM, ORDERS, UNSHARDED, CUSTOMER, TableSpec, shard_map_from_rows

LI = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _top(df, *cols) -> int:
    return int(df.agg(F.greatest(*[F.max(c) for c in cols], F.lit(0))).first()[0]) if len(cols) > 1 \
        else int(df.agg(F.max(cols[0])).first()[0])


# --- K1 / K2 -------------------------------------------------------------------

PARTS_KIDS_SQL = """
b AS (SELECT greatest(max(l_partkey), max(l_suppkey)) + 1 AS n FROM lineitem),
kids AS (SELECT 'parts-' || lo || '-' || hi AS shard, lo, hi FROM (
  SELECT i * (n // 3) + least(i, n % 3) AS lo,
         i * (n // 3) + least(i, n % 3) + n // 3 + CASE WHEN i < n % 3 THEN 1 ELSE 0 END - 1 AS hi
  FROM b, range(0, 3) r(i)))"""


def _split_lineitem(spark, sf_dir):
    from keyspan.plans.jobs import split
    li = _t(spark, sf_dir, "lineitem").select(*LI)
    top = _top(li, "l_partkey", "l_suppkey")
    m = shard_map_from_rows(spark, [("parts", 0, top, "ready")])
    path = scratch_path(spark, "split-lineitem")
    res = split(li, LINEITEM, m, f"parts-0-{top}", path, n=3)
    return li, res, path


@register("split_lineitem", f"""
WITH {PARTS_KIDS_SQL}
SELECT k.shard, {", ".join(LI)} FROM lineitem l JOIN kids k
ON l.l_partkey BETWEEN k.lo AND k.hi OR l.l_suppkey BETWEEN k.lo AND k.hi
""")
def q_split_lineitem(spark, sf_dir):
    """K1 on a two-key table: each row in every child that holds a key of it."""
    _, _, path = _split_lineitem(spark, sf_dir)
    return spark.read.parquet(path).select("shard", *LI)


@register("split_open_shard", """
WITH b AS (SELECT max(o_custkey) // 4 AS a, max(o_custkey) // 2 AS z FROM orders)
SELECT CASE WHEN o_custkey <= z THEN 'custs-' || a || '-' || z ELSE 'custs-' || (z + 1) || '-infinity' END AS shard,
       o_orderkey, o_custkey, o_totalprice
FROM orders, b WHERE o_custkey >= a
""")
def q_split_open(spark, sf_dir):
    """K1 on the open last shard, by explicit ranges that end in infinity."""
    from keyspan.plans.jobs import split
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = _top(o, "o_custkey")
    a, z = top // 4, top // 2
    m = shard_map_from_rows(spark, [("custs", 0, a - 1, "ready"), ("custs", a, None, "ready")])
    path = scratch_path(spark, "split-open")
    split(o, ORDERS, m, f"custs-{a}-infinity", path, ranges=[(a, z), (z + 1, None)])
    return spark.read.parquet(path).select("shard", "o_orderkey", "o_custkey", "o_totalprice")


@register("merge_lineitem", f"SELECT {', '.join(LI)} FROM lineitem")
def q_merge_lineitem(spark, sf_dir):
    """K2 after K1: the children merged again are the table, shared rows once."""
    from keyspan.plans.jobs import JobError, merge
    _, res, path = _split_lineitem(spark, sf_dir)
    written = spark.read.parquet(path)
    kids = [r["name"] for r in res.shard_map.filter("parent is not null").select("name").collect()]
    out = scratch_path(spark, "merge-lineitem")
    report = merge({k: written.filter(F.col("shard") == k).select(*LI) for k in kids}, LINEITEM, out)
    if not all(r["valid"] for r in report.collect()):
        raise JobError("merged rows do not add up")
    return spark.read.parquet(out).select(*LI)


@register("split_states", """
WITH b AS (SELECT max(o_custkey) AS top FROM orders),
k AS (SELECT 0 AS lo, (top + 2) // 2 - 1 AS hi FROM b UNION ALL SELECT (top + 2) // 2, top FROM b),
s(step, parent_state, child_state) AS (VALUES ('split', 'ready', 'replicating'), ('reads moved', 'deprecated', 'child'),
  ('writes moved', 'deprecated', 'needs_cleanup'), ('cleaned up', 'recycle', 'ready'))
SELECT step, 'custs-0-' || top AS shard, parent_state AS state,
       CAST(CASE WHEN step = 'split' THEN (SELECT count(*) FROM orders) ELSE 0 END AS BIGINT) AS routed_rows FROM s, b
UNION ALL
SELECT step, 'custs-' || lo || '-' || hi, child_state,
       CAST(CASE WHEN step = 'split' THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) END AS BIGINT)
FROM s, k
""")
def q_split_states(spark, sf_dir):
    """B14 with K1 and K5: the states of parent and children step by step, and
    where the map of each step routes the rows."""
    from keyspan.operators.route import route
    from keyspan.operators.transitions import move_reads_to_children, move_writes_to_children
    from keyspan.plans.jobs import child_ranges, split_cleanup
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    top = _top(o, "o_custkey")
    parent = f"custs-0-{top}"
    m = shard_map_from_rows(spark, [("custs", 0, top, "ready")])
    maps = [("split", m.unionByName(child_ranges(m, parent, 2, state="replicating")))]
    maps.append(("reads moved", move_reads_to_children(maps[-1][1], parent)))
    maps.append(("writes moved", move_writes_to_children(maps[-1][1], parent)))
    kids = [r["name"] for r in maps[-1][1].filter("parent is not null").select("name").collect()]
    maps.append(("cleaned up", split_cleanup(maps[-1][1], parent, {k: o for k in kids}, ORDERS)[0]))
    out = None
    for step, sm in maps:
        live = sm.filter(~F.col("state").isin("deprecated", "recycle"))
        n = route(o, "o_custkey", live, "custs", how="inner").groupBy(F.col("shard").alias("name")).count()
        rows = sm.join(n, "name", "left").select(F.lit(step).alias("step"), F.col("name").alias("shard"), "state",
                                                 F.coalesce("count", F.lit(0)).cast("long").alias("routed_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- K4 / K6 / K7 ------------------------------------------------------------------

THIRDS_SQL = """
b AS (SELECT max(o_custkey) // 3 AS t FROM orders),
m AS (SELECT 'custs-0-' || (t - 1) AS name, 0 AS lo, t - 1 AS hi FROM b
      UNION ALL SELECT 'custs-' || t || '-' || (2 * t - 1), t, 2 * t - 1 FROM b
      UNION ALL SELECT 'custs-' || (2 * t) || '-infinity', 2 * t, NULL FROM b)"""


def thirds_map(spark, o):
    """A shard map of orders in three, derived from the largest key."""
    t = _top(o, "o_custkey") // 3
    return shard_map_from_rows(spark, [("custs", 0, t - 1, "ready"), ("custs", t, 2 * t - 1, "ready"),
                                       ("custs", 2 * t, None, "ready")])


def _stored_shards(spark, sf_dir, name):
    from keyspan.operators.route import route
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    live = scratch_path(spark, name)
    route(o, "o_custkey", thirds_map(spark, o), "custs", how="inner").write.partitionBy("shard").parquet(live)
    return live


@register("schema_change_written", f"""
WITH {THIRDS_SQL}
SELECT t.state, m.name AS shard, o_orderkey, o_custkey, o_totalprice, o_orderpriority, t.my_new_column
FROM orders o JOIN m ON o.o_custkey >= m.lo AND (m.hi IS NULL OR o.o_custkey <= m.hi),
     (VALUES ('needs_rename', NULL), ('renamed', o.o_orderkey % 7), ('old', NULL)) AS t(state, my_new_column)
""")
def q_schema_change_written(spark, sf_dir):
    """K7 on a stored table: written and verified shard by shard, the rename
    delayed; the live rows before it, after it, and the kept old table."""
    from keyspan.plans.jobs import TableAlter
    live = _stored_shards(spark, sf_dir, "alter-live")
    cols = ["shard", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    job = TableAlter(spark, live)
    job.run(lambda d: d.withColumn("my_new_column", F.col("o_orderkey") % 7), delayed_rename=True)
    none = F.lit(None).cast("long").alias("my_new_column")
    # read while the rename is still to come: a stored copy, as the folder moves below it
    seen = scratch_path(spark, "alter-seen")
    spark.read.parquet(live).select(F.lit(job.state).alias("state"), *cols, none).write.parquet(seen)
    job.rename()
    return (spark.read.parquet(seen)
            .unionByName(spark.read.parquet(live).select(F.lit("renamed").alias("state"), *cols, "my_new_column"))
            .unionByName(spark.read.parquet(f"{live}.old").select(F.lit("old").alias("state"), *cols, none)))


@register("rebuild_table", """
SELECT 'live' AS tbl, o_orderkey, o_custkey, o_totalprice FROM orders
UNION ALL SELECT 'old', o_orderkey, o_custkey, o_totalprice FROM orders
""")
def q_rebuild_table(spark, sf_dir):
    """K6 on a stored table: rewritten in key order, swapped in, the former one kept."""
    from keyspan.plans.jobs import rebuild_table
    live = scratch_path(spark, "rebuild-live")
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    _t(spark, sf_dir, "orders").select(*cols).write.parquet(live)
    rebuild_table(spark, live, ORDERS)
    read = lambda path, name: spark.read.parquet(path).select(F.lit(name).alias("tbl"), *cols)
    return read(live, "live").unionByName(read(f"{live}.old", "old"))


@register("cutover_job", f"""
WITH {THIRDS_SQL},
c AS (SELECT max(o_custkey) + 1 AS id FROM orders),
n AS (SELECT name, lo, hi FROM m WHERE hi IS NOT NULL
      UNION ALL SELECT 'custs-' || lo || '-' || (id - 1), lo, id - 1 FROM m, c WHERE hi IS NULL
      UNION ALL SELECT 'custs-' || id || '-infinity', id, NULL FROM c)
SELECT name AS shard, CAST((SELECT count(*) FROM orders WHERE o_custkey >= lo AND (hi IS NULL OR o_custkey <= hi)) AS BIGINT)
       AS n_rows, 6 AS n_columns FROM n
""")
def q_cutover_job(spark, sf_dir):
    """K4: the job (map and empty new last shard), then the rows by the new map;
    ``n_columns`` is read from the schema that was copied."""
    from keyspan.operators.route import route
    from keyspan.plans.jobs import do_cutover
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                           "o_orderpriority")
    path = scratch_path(spark, "cutover")
    m = do_cutover(thirds_map(spark, o), _top(o, "o_custkey") + 1, "custs", o, path)
    live = m.filter("state <> 'recycle'")
    n = route(o.select("o_custkey"), "o_custkey", live, "custs", how="inner").groupBy(F.col("shard").alias("name")).count()
    width = len(spark.read.schema(o.schema).parquet(path).columns)
    return live.join(n, "name", "left").select(F.col("name").alias("shard"),
                                               F.coalesce("count", F.lit(0)).cast("long").alias("n_rows"),
                                               F.lit(width).alias("n_columns"))


# --- A1 / A2 / A6 -------------------------------------------------------------------


def _round_trip(spark, df, name):
    from keyspan.operators.transfer import export_range, read_tsv, write_tsv
    path = scratch_path(spark, name)
    write_tsv(export_range(df, TableSpec(name)), path)
    return read_tsv(spark, path, df.schema)


@register("export_documents_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_export_documents(spark, sf_dir):
    """The full table out as text and back, any string unharmed."""
    return _round_trip(spark, _t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "docs")


TORN_SQL = r"""page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE url END AS url,
  CASE page_id % 5 WHEN 0 THEN '\N' || chr(9) || html || chr(13) || chr(10) || '\'
                   WHEN 1 THEN '' WHEN 2 THEN '\t\\n' || chr(10) || ' pad ' ELSE html END AS html"""


@register("export_pages_text", f"SELECT {TORN_SQL} FROM pages")
def q_export_pages(spark, sf_dir):
    """A1/A6 on texts with tabs, line ends, backslashes, empty strings, the
    text of the NULL mark, and NULLs."""
    p = _t(spark, sf_dir, "pages")
    k = F.col("page_id") % 5
    html = (F.when(k == 0, F.concat(F.lit("\\N\t"), F.col("html"), F.lit("\r\n\\")))
            .when(k == 1, F.lit("")).when(k == 2, F.lit("\\t\\\\n\n pad ")).otherwise(F.col("html")))
    return _round_trip(spark, p.select("page_id", F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"),
                                       html.alias("html")), "pages")


# --- C10 / K9 -----------------------------------------------------------------------

COPY_A_SQL = """ca AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 1 THEN o_custkey END AS k,
   CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS p, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS q
 FROM orders)"""
COPY_B_SQL = """cb AS (SELECT id, CASE WHEN id % 900 = 1 THEN 1 ELSE k END AS k,
   CASE WHEN id % 700 = 3 THEN q ELSE p END AS p, CASE WHEN id % 700 = 3 THEN p ELSE q END AS q FROM ca
 UNION ALL SELECT -1, (SELECT max(k) + 5 FROM ca), 1.5, NULL
 UNION ALL SELECT -2, -7, NULL, 2.5
 UNION ALL SELECT -3, NULL, NULL, NULL)"""
CHUNK_SQL = """CASE WHEN k > hi THEN hi + 1 WHEN k >= 0 THEN (k // w) * w END AS chunk_min,
  CASE WHEN k < 0 THEN -1 WHEN k <= hi THEN least((k // w) * w + w - 1, hi) END AS chunk_max"""


def _tampered(spark, sf_dir):
    """Two copies of orders: in the second some NULLs moved to another column,
    keys were lost, and rows came in above, below and without a key."""
    i = F.col("id")
    o = _t(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 50 != 1, F.col("o_custkey")).alias("k"),
                 F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("p"),
                 F.when(F.col("o_orderkey") % 3 != 1, F.col("o_totalprice")).alias("q"))
    hi = _top(a, "k")
    b = a.select("id", F.when(i % 900 == 1, F.lit(1).cast("long")).otherwise(F.col("k")).alias("k"),
                 F.when(i % 700 == 3, F.col("q")).otherwise(F.col("p")).alias("p"),
                 F.when(i % 700 == 3, F.col("p")).otherwise(F.col("q")).alias("q"))
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, {hi + 5}L, 1.5D, CAST(NULL AS DOUBLE)), (-2L, -7L, NULL, 2.5D), "
                      "(-3L, CAST(NULL AS BIGINT), NULL, NULL) AS e(id, k, p, q)")
    return a, b.unionByName(extra), hi


@register("checksum_audit", f"""
WITH {COPY_A_SQL}, {COPY_B_SQL}, s AS (SELECT max(k) AS hi, greatest((max(k) + 1) // 200, 1) AS w FROM ca),
d AS ((SELECT * FROM ca EXCEPT ALL SELECT * FROM cb) UNION ALL (SELECT * FROM cb EXCEPT ALL SELECT * FROM ca)),
bad AS (SELECT DISTINCT {CHUNK_SQL} FROM d, s),
na AS (SELECT {CHUNK_SQL}, count(*) AS n FROM ca, s GROUP BY ALL), nb AS (SELECT {CHUNK_SQL}, count(*) AS n FROM cb, s GROUP BY ALL)
SELECT bad.chunk_min, bad.chunk_max, CAST(coalesce(na.n, 0) AS BIGINT) AS a_rows, CAST(coalesce(nb.n, 0) AS BIGINT) AS b_rows
FROM bad
LEFT JOIN na ON bad.chunk_min IS NOT DISTINCT FROM na.chunk_min AND bad.chunk_max IS NOT DISTINCT FROM na.chunk_max
LEFT JOIN nb ON bad.chunk_min IS NOT DISTINCT FROM nb.chunk_min AND bad.chunk_max IS NOT DISTINCT FROM nb.chunk_max
""")
def q_checksum_audit(spark, sf_dir):
    """C10 on a tampered copy: chunks below, above and without a key included."""
    from keyspan.operators.audit import checksum_diff
    a, b, hi = _tampered(spark, sf_dir)
    return checksum_diff(a, b, "k", 0, hi, 200, a.columns)


@register("consistency_audit", f"""
WITH {COPY_A_SQL}, {COPY_B_SQL}
SELECT *, 'only_a' AS side FROM (SELECT * FROM ca EXCEPT ALL SELECT * FROM cb)
UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM cb EXCEPT ALL SELECT * FROM ca)
""")
def q_consistency_audit(spark, sf_dir):
    """K9 on the same copies: the differing rows themselves."""
    from keyspan.plans.jobs import consistency_check
    a, b, hi = _tampered(spark, sf_dir)
    return consistency_check(a, b, "k", 0, hi, 200)


# --- D2 / K10, C1 --------------------------------------------------------------------


def two_pool_map(spark, sf_dir):
    """The map of orders in three and, in a second pool, lineitem in three."""
    from keyspan.operators.ranges import even_split
    from keyspan.spec import SHARD_MAP_SCHEMA, shard_name_col
    top = _top(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    pieces = even_split(shard_map_from_rows(spark, [("parts", 0, top, "ready")]), 3)
    pieces = pieces.drop("min_id", "max_id", "name").withColumnsRenamed({"piece_min": "min_id", "piece_max": "max_id"})
    parts = (pieces.withColumn("seq", F.col("piece").cast("int"))
             .withColumn("name", shard_name_col(F.col("pool"), F.col("min_id"), F.col("max_id"))))
    return thirds_map(spark, _t(spark, sf_dir, "orders")).unionByName(parts.select(*[f.name for f in SHARD_MAP_SCHEMA]))


WHOLE = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("global_rowcount_report", f"""
WITH {THIRDS_SQL}, {PARTS_KIDS_SQL.replace('b AS', 'pb AS').replace('FROM b,', 'FROM pb,')},
c AS (
  SELECT 'orders' AS table_name, m.name AS shard, count(*) AS n FROM orders JOIN m
    ON o_custkey >= lo AND (hi IS NULL OR o_custkey <= hi) GROUP BY m.name
  UNION ALL SELECT 'customer', m.name, count(*) FROM customer JOIN m
    ON c_custkey >= lo AND (hi IS NULL OR c_custkey <= hi) GROUP BY m.name
  UNION ALL SELECT 'lineitem', k.shard, count(*) FROM lineitem JOIN kids k
    ON l_partkey BETWEEN k.lo AND k.hi OR l_suppkey BETWEEN k.lo AND k.hi GROUP BY k.shard
  {"".join(f" UNION ALL SELECT '{t}', 'functional', count(*) FROM {t}"
           for t in [s.name for s in UNSHARDED] + list(WHOLE))})
SELECT table_name, shard, CAST(sum(n) AS BIGINT) AS row_count, CAST(GROUPING(table_name, shard) AS INTEGER) AS lvl
FROM c GROUP BY ROLLUP (table_name, shard)
""")
def q_global_rowcount(spark, sf_dir):
    """All fourteen tables; a row of a multi-key table counts on every
    shard that holds one of its keys."""
    from keyspan.plans.jobs import global_rowcount_report
    load = lambda n: _t(spark, sf_dir, n)
    m = two_pool_map(spark, sf_dir)
    return global_rowcount_report({s.name: (load(s.name), s) for s in (ORDERS, CUSTOMER, LINEITEM)}, m,
                                  {s.name: (load(s.name), s) for s in (*UNSHARDED, *(TableSpec(t) for t in WHOLE))})


@register("route_two_pools", f"""
WITH {THIRDS_SQL}, {PARTS_KIDS_SQL.replace('b AS', 'pb AS').replace('FROM b,', 'FROM pb,')}
SELECT 'custs' AS pool, o_orderkey AS id, m.name AS shard FROM orders JOIN m ON o_custkey >= lo AND (hi IS NULL OR o_custkey <= hi)
UNION ALL
SELECT 'parts', l_orderkey * 10 + l_linenumber, k.shard FROM lineitem JOIN kids k ON l_partkey BETWEEN k.lo AND k.hi
""")
def q_route_two_pools(spark, sf_dir):
    """C1 through one map of two pools whose key ranges overlap."""
    from keyspan.operators.route import route
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    li = _t(spark, sf_dir, "lineitem")
    m = two_pool_map(spark, sf_dir)
    l2 = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("k"))
    one = lambda d, pool: route(d, "k", m, pool, how="inner").select(F.lit(pool).alias("pool"), "id", "shard")
    return one(o, "custs").unionByName(one(l2, "parts"))


# --- I4 / I6 -------------------------------------------------------------------------


@register("replay_until_then_resume", """
WITH s AS (SELECT max(event_id) // 2 AS cut FROM events),
c AS (SELECT event_id, user_id, value, CAST(user_id % 3 AS VARCHAR) AS source FROM events)
SELECT 'stopped' AS phase, * FROM (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value,
  arg_max(source, event_id) AS source FROM c, s WHERE event_id <= cut GROUP BY user_id)
UNION ALL
SELECT 'resumed', * FROM (SELECT user_id, max(event_id), arg_max(value, event_id), arg_max(source, event_id) FROM c GROUP BY user_id)
""")
def q_replay(spark, sf_dir):
    """I4: three streams stopped at one position (inside a file), then one of
    them removed after a last run; later changes come back, none is lost."""
    from keyspan.streaming.merge import StreamMerger, write_change_sources
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    root = scratch_path(spark, "replay")
    merger = StreamMerger(spark, e.schema, ["user_id"], "event_id", f"{root}/out")
    for name, path in write_change_sources(e, F.col("user_id") % 3, f"{root}/in", "event_id").items():
        merger.add_source(name, path)
    merger.run_available_now(until_seq=_top(e, "event_id") // 2)
    cols = ["user_id", "event_id", "value", "source"]
    stopped = merger.merged().select(F.lit("stopped").alias("phase"), *cols)
    merger.run_available_now()
    merger.remove_source("1")                 # sends no more; what it applied stays
    return stopped.unionByName(merger.merged().select(F.lit("resumed").alias("phase"), *cols))


@register("stream_merge_restart", """
WITH s AS (SELECT max(event_id) // 3 AS cut, max(event_id) // 2 AS half FROM events),
-- every change of source 0 is sent again by source 1 under the same sequence, with another value
c AS (SELECT event_id, user_id, value, CAST(user_id % 3 AS VARCHAR) AS source FROM events
      UNION ALL SELECT event_id, user_id, -value, '1' FROM events WHERE user_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, source DESC) AS k, 'all' AS phase FROM c
      UNION ALL
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, source DESC), 'stopped' FROM c
      WHERE event_id <= (SELECT half FROM s)
      UNION ALL
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, source DESC), 'first' FROM c
      WHERE event_id <= (SELECT cut FROM s) AND source <> '2')
SELECT phase, user_id, event_id, value, source FROM r WHERE k = 1
""")
def q_merge_restart(spark, sf_dir):
    """Three merger objects in a row on one folder.  The first takes in
    two of three sources up to a position, the second stops all three together
    at a later one, the third goes on to the end; sources, states, positions and
    stop points come from the manifest.  Two sources share sequences."""
    from keyspan.streaming.merge import StreamMerger, write_change_sources
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("user_id") % 3).alias("src"))
    again = e.where("src = 0").select("event_id", "user_id", (-F.col("value")).alias("value"), F.lit(1).cast("long").alias("src"))
    sent = e.withColumn("src", F.col("src").cast("long")).unionByName(again)
    root, top = scratch_path(spark, "restart"), _top(e, "event_id")
    paths = write_change_sources(sent, F.col("src"), f"{root}/in", "event_id")
    kind = e.drop("src").schema
    merger = lambda: StreamMerger(spark, kind, ["user_id"], "event_id", f"{root}/out")
    cols = ["user_id", "event_id", "value", "source"]
    first = merger()
    for name, path in paths.items():
        first.add_source(name, path)
    first.pause("2")
    first.run_available_now(until_seq=top // 3)
    out = merger().merged().select(F.lit("first").alias("phase"), *cols)        # read by an object that ran nothing
    second = merger()
    second.replay_together(until=top // 2)
    out = out.unionByName(merger().merged().select(F.lit("stopped").alias("phase"), *cols))
    third = merger()
    for name in sorted(third.paused):
        third.resume(name)
    third.run_available_now()
    return out.unionByName(merger().merged().select(F.lit("all").alias("phase"), *cols))


# --- B12, H2, H7-H9, H12, F4, G5 --------------------------------------------------------


@register("select_shards_rows", f"""
WITH {THIRDS_SQL}
SELECT q.kind, m.name AS shard, CAST(count(*) AS BIGINT) AS n FROM m JOIN orders ON o_custkey >= lo AND (hi IS NULL OR o_custkey <= hi),
     (VALUES ('open'), ('closed'), ('in production')) AS q(kind)
WHERE (q.kind = 'open' AND hi IS NULL) OR (q.kind = 'closed' AND lo = 0) OR q.kind = 'in production' GROUP BY ALL
""")
def q_select_shards(spark, sf_dir):
    """Shards by their ends and state, with the rows they hold."""
    from keyspan.operators.route import route, select_shards
    o = _t(spark, sf_dir, "orders").select("o_custkey")
    m = thirds_map(spark, o)
    t = _top(o, "o_custkey") // 3
    n = route(o, "o_custkey", m, "custs", how="inner").groupBy(F.col("shard").alias("name")).agg(F.count("*").cast("long").alias("n"))
    kinds = {"open": select_shards(m, "CUSTS", max_id="INFINITY"), "closed": select_shards(m, "custs", min_id=0, max_id=t - 1),
             "in production": select_shards(m, in_prod=True)}
    out = None
    for kind, found in kinds.items():
        rows = found.join(n, "name").select(F.lit(kind).alias("kind"), F.col("name").alias("shard"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("export_sorted", """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS line FROM orders
""")
def q_export_sorted(spark, sf_dir):
    """the lines of an export whose files follow each other in key order,
    numbered as they stand in the files."""
    from keyspan.operators.transfer import export_range, read_tsv, write_tsv
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    spec = TableSpec("orders", keys=("o_custkey",), pk=("o_orderkey",), chunks=200, order_by=("o_custkey", "o_orderkey"))
    path = scratch_path(spark, "sorted")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_tsv(export_range(o.repartitionByRange(n, *spec.order_by), spec), path)
    # number the lines by split and place in it: the counts of the splits before, plus the place
    lines = spark.read.option("lineSep", "\n").option("wholetext", False).text(path)
    named = lines.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("at"))
    stored = scratch_path(spark, "sorted-lines")
    named.write.parquet(stored)
    named = spark.read.parquet(stored)
    # one row per split of a file; a split is read by one task, so its ids follow each other
    splits = named.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window
    before = Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    f = F.split("value", "\t")
    return named.join(splits, ["file", "block"]).select(
        F.get(f, F.lit(0)).cast("long").alias("o_custkey"), F.get(f, F.lit(1)).cast("long").alias("o_orderkey"),
        (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"))


@register("text_functions", r"""
WITH v AS (SELECT event_id, '5.' || (event_id % 9) || '.' || (event_id % 31) || '-rel' || (user_id % 5) AS a,
                  '5.' || (user_id % 9) || '.' || (user_id % 31) AS b,
                  'binlog.' || lpad(CAST(event_id % 17 AS VARCHAR), 6, '0') AS fa, 'binlog.' || lpad(CAST(user_id % 17 AS VARCHAR), 6, '0') AS fb,
                  event_id % 17 AS na, user_id % 17 AS nb, event_id AS pa, user_id AS pb,
                  event_id % 9 AS ma, user_id % 9 AS mb, event_id % 31 AS ia, user_id % 31 AS ib FROM events)
SELECT event_id, CAST(CASE WHEN ma < mb THEN -1 WHEN ma > mb THEN 1 ELSE 0 END AS INTEGER) AS two,
       CAST(CASE WHEN (ma, ia) < (mb, ib) THEN -1 WHEN (ma, ia) > (mb, ib) THEN 1 ELSE 0 END AS INTEGER) AS three,
       CAST(na AS BIGINT) AS file_number, CASE WHEN fa = fb THEN pa > pb ELSE na > nb END AS ahead,
       round(100.0 * (event_id % 1000) / 1000, 2) AS hit, CAST(user_id % 7 AS VARCHAR) AS section_value,
       [CAST(event_id AS VARCHAR)] AS merged_a, [CAST(user_id AS VARCHAR), 'z'] AS merged_b
FROM v JOIN events USING (event_id)
""")
def q_text_functions(spark, sf_dir):
    """Versions, log files, status sections and map merges over
    values of every event."""
    from keyspan.functions import deep_merge, hit_rate, logfile_number, position_ahead, status_sections, version_cmp
    e = _t(spark, sf_dir, "events")
    s = lambda c: c.cast("string")
    i, u = F.col("event_id"), F.col("user_id")
    name = lambda c: F.concat(F.lit("binlog."), F.lpad(s(c % 17), 6, "0"))
    a = F.concat(F.lit("5."), s(i % 9), F.lit("."), s(i % 31), F.lit("-rel"), s(u % 5))
    b = F.concat(F.lit("5."), s(u % 9), F.lit("."), s(u % 31))
    status = F.concat(F.lit("-----\nPOOL A/B\n-----\nfirst\n-----\nPOOL A/B\n-----\n"), s(u % 7), F.lit("\n-----\nEND\n-----\nrest\n"))
    line = F.concat(F.lit("Buffer pool hit rate "), s(i % 1000), F.lit(" / 1000"))
    merged = deep_merge(F.create_map(F.lit("a"), F.array(s(i)), F.lit("b"), F.array(s(u))),
                        F.create_map(F.lit("b"), F.array(F.lit("z"))), concat_arrays=True)
    d = e.select("event_id", "user_id", a.alias("a"), b.alias("b"), name(i).alias("fa"), name(u).alias("fb"),
                 status.alias("st"), line.alias("line"), merged.alias("m"))
    return d.select("event_id", version_cmp(F.col("a"), F.col("b"), 2).alias("two"), version_cmp(F.col("a"), F.col("b"), 3).alias("three"),
                    logfile_number(F.col("fa")).alias("file_number"),
                    position_ahead(F.col("fa"), F.col("event_id"), F.col("fb"), F.col("user_id")).alias("ahead"),
                    hit_rate(F.col("line")).alias("hit"), F.element_at(F.element_at(status_sections(F.col("st")), "POOL A/B"), 1).alias("section_value"),
                    F.element_at("m", "a").alias("merged_a"), F.element_at("m", "b").alias("merged_b"))
