"""Registered queries of the jobs that keep state and of the operators built
around it: resumable audits, lossless exports, ordered detectors, replica
topologies, hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.plans.catalog import DRIFT_SQL, MAP_SQL, _drifted, _t, custs_map, register
from keyspan.session import scratch_path
from keyspan.spec import LINEITEM, ORDERS

# --- C10 ------------------------------------------------------------------------------


@register("checksum_resume", f"""
WITH d AS {DRIFT_SQL},
b AS (SELECT max(o_custkey) AS hi, greatest((max(o_custkey) + 1) // 200, 1) AS w FROM orders),
only_a AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM d),
only_b AS (SELECT * FROM d EXCEPT ALL SELECT * FROM orders),
bad AS (SELECT DISTINCT (o_custkey // b.w) * b.w AS chunk_min FROM (
          SELECT o_custkey FROM only_a UNION ALL SELECT o_custkey FROM only_b), b),
ca AS (SELECT (o_custkey // b.w) * b.w AS chunk_min, count(*) AS n FROM orders, b GROUP BY 1),
cb AS (SELECT (o_custkey // b.w) * b.w AS chunk_min, count(*) AS n FROM d, b GROUP BY 1),
c AS (SELECT chunk_min, coalesce(ca.n, 0) AS a_rows, coalesce(cb.n, 0) AS b_rows FROM ca FULL JOIN cb USING (chunk_min))
SELECT CAST(chunk_min AS BIGINT) AS chunk_min, CAST(least(chunk_min + w - 1, hi) AS BIGINT) AS chunk_max,
       CAST(a_rows AS BIGINT) AS a_rows, CAST(b_rows AS BIGINT) AS b_rows, bad.chunk_min IS NULL AS same,
       CASE WHEN chunk_min // (w * 25) < 3 THEN 1 ELSE 2 END AS run
FROM c CROSS JOIN b LEFT JOIN bad USING (chunk_min)
""")
def q_checksum_resume(spark, sf_dir):
    """An audit that dies after three batches of 25 chunks; a second one
    on the same folder compares only the batches that are open."""
    from keyspan.plans.checksums import ChecksumAudit
    a, b = _t(spark, sf_dir, "orders"), _drifted(spark, sf_dir)
    root, hi = scratch_path(spark, "checksums"), a.select(F.max("o_custkey")).first()[0]
    audit = lambda: ChecksumAudit(spark, root, "o_custkey", 0, hi, ORDERS.chunks, a.columns, 25)
    first, seen = audit(), []

    def dies(batch):
        seen.append(batch)
        if len(seen) == 3:
            raise KeyboardInterrupt

    try:
        first.run(a, b, dies)
    except KeyboardInterrupt:
        pass
    second = audit()
    second.run(a, b)
    run = F.when(F.col("run") == first.run_id, 1).when(F.col("run") == second.run_id, 2)
    return second.results().select("chunk_min", "chunk_max", "a_rows", "b_rows", "same", run.alias("run"))


# --- A3, A8 ---------------------------------------------------------------------------


@register("multi_key_export_files", """
WITH li AS (
  SELECT CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey END AS l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_orderkey % 11 <> 0 THEN l_suppkey END AS l_suppkey, l_quantity, generate_series
  FROM lineitem, generate_series(1, 2) WHERE generate_series = 1 OR l_orderkey % 17 = 0),
b AS (SELECT greatest(max(l_partkey), max(l_suppkey)) AS hi FROM li), w AS (SELECT hi, greatest((hi + 1) // 100, 1) AS w FROM b),
c AS (SELECT li.*, unnest(list_distinct([l_partkey // w, l_suppkey // w])) AS ch, w, hi FROM li, w)
SELECT 'lineitem' || (ch * w) || '-' || least(ch * w + w - 1, hi) || '.out' AS file_name, CAST(count(*) AS BIGINT) AS rows
FROM c WHERE ch IS NOT NULL GROUP BY ch, w, hi
""")
def q_multi_key_export_files(spark, sf_dir):
    """A table with repeated rows and NULLs in its primary key and in a
    sharding key, exported by chunks of both keys; counts of the written files."""
    from keyspan.operators.ranges import chunk_ranges, export_file_name
    from keyspan.operators.transfer import export_chunked
    li = _t(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey",
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_suppkey")).alias("l_suppkey"), "l_quantity",
        F.explode(F.when(F.col("l_orderkey") % 17 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("one"))
    li = li.drop("one")
    top = int(li.agg(F.greatest(F.max("l_partkey"), F.max("l_suppkey"))).first()[0])
    chunks = chunk_ranges(spark, 0, top, LINEITEM.chunks)
    chunks = chunks.withColumn("file_name", export_file_name(F.lit("lineitem"), F.col("chunk_min"), F.col("chunk_max")))
    return export_chunked(li, LINEITEM, chunks, scratch_path(spark, "export-files"))


# --- K7 -------------------------------------------------------------------------------


@register("schema_change_unlisted", """
SELECT o_orderpriority AS shard, CASE WHEN o_orderpriority = '1-URGENT' THEN 'preflight' ELSE 'rest' END AS phase,
       CAST(count(*) AS BIGINT) AS rows_before,
       CAST(count(*) FILTER (o_orderpriority <> '3-MEDIUM') AS BIGINT) AS rows_after, o_orderpriority <> '3-MEDIUM' AS ok
FROM orders GROUP BY o_orderpriority
UNION ALL SELECT '9-NONE', 'rest', 0, 0, true
""")
def q_schema_change_unlisted(spark, sf_dir):
    """K7: a change that loses a shard which is not in the list of shards, and a
    listed shard without rows: both are in the report."""
    from keyspan.plans.jobs import schema_change
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("shard"), "o_orderkey", "o_totalprice")
    names = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NONE",)], "name string")
    return schema_change(o, lambda d: d.where("shard <> '3-MEDIUM'").withColumn("new_column", F.lit(1)),
                         scratch_path(spark, "alter-unlisted"), preflight="1-URGENT", shards=names)


# --- G4, G5 ---------------------------------------------------------------------------


@register("interval_subset", """
WITH a AS (SELECT event_type AS source, event_id AS id FROM events),
b AS (SELECT event_type AS source, event_id AS id FROM events WHERE value >= 5 OR event_type <> 'view'),
m AS (SELECT source, CAST(count(*) FILTER (b.id IS NULL) AS BIGINT) AS missing FROM a LEFT JOIN b USING (source, id) GROUP BY source)
SELECT source, missing, missing = 0 AS subset, (SELECT sum(missing) FROM m) = 0 AS all_subset FROM m
""")
def q_interval_subset(spark, sf_dir):
    """Whether one set holds another, source by source and as a whole."""
    from keyspan.operators import intervals as iv
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id", "value")
    a = iv.ids_to_intervals(e, ["source"], "event_id")
    b = iv.ids_to_intervals(e.where("value >= 5 or source <> 'view'"), ["source"], "event_id")
    found = iv.subset_by(a, b, ["source"])
    return found.withColumn("all_subset", iv.is_subset(a, b, ["source"]).scalar())


@register("interval_pick_source", """
WITH t AS (SELECT min(event_type) AS source FROM events),
a AS (SELECT DISTINCT event_id // 2 AS id FROM events JOIN t ON event_type = source),
r AS (SELECT id, id - row_number() OVER (ORDER BY id) AS isl FROM a)
SELECT (SELECT source FROM t) AS source, min(id) AS lo, max(id) AS hi FROM r GROUP BY isl
""")
def q_interval_pick(spark, sf_dir):
    """One source's part of an interval set, that of the first source by name."""
    from keyspan.operators import intervals as iv
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.floor(F.col("event_id") / 2).alias("id"))
    return iv.pick_source(iv.ids_to_intervals(e, ["source"], "id"), e.select(F.min("source")).first()[0])


# --- C2 -------------------------------------------------------------------------------


@register("merged_cover_shards", """
WITH s AS (
  SELECT 'pool' || (c_nationkey % 3) AS pool, 'shard-' || c_custkey AS name, CAST(c_custkey AS BIGINT) AS min_id,
         CASE WHEN c_custkey % 29 <> 0 THEN CAST(c_custkey + (c_custkey * 7919) % 50 AS BIGINT) END AS max_id,
         CASE c_custkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'merging' WHEN 2 THEN 'initialized' ELSE 'child' END AS state,
         (c_custkey * 31) % 1009 AS seq FROM customer)
SELECT a.name, arg_min(b.name, (b.seq, b.name)) AS merged_name FROM s a JOIN s b
  ON a.pool = b.pool AND b.min_id <= a.min_id AND b.max_id >= a.max_id AND a.name <> b.name AND b.state IN ('ready', 'initialized')
WHERE a.max_id IS NOT NULL GROUP BY a.name
""")
def q_merged_cover(spark, sf_dir):
    """C2 on a map of one shard a customer, with nested and open ranges."""
    from keyspan.operators.route import merged_cover
    k = F.col("c_custkey").cast("long")
    state = F.when(k % 4 == 0, "ready").when(k % 4 == 1, "merging").when(k % 4 == 2, "initialized").otherwise("child")
    m = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("pool"), (F.col("c_nationkey") % 3).cast("string")).alias("pool"),
        F.concat(F.lit("shard-"), k.cast("string")).alias("name"), k.alias("min_id"),
        F.when(k % 29 != 0, k + (k * 7919) % 50).alias("max_id"), state.alias("state"), ((k * 31) % 1009).alias("seq"))
    return merged_cover(m)


# --- D15, D17 -------------------------------------------------------------------------


@register("result_classes", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN o_orderpriority END AS priority,
                  CASE WHEN o_custkey % 50 = 0 THEN 'lost ' || (o_orderkey % 3) END AS failed FROM orders)
SELECT priority, failed, o_orderkey, CAST(count(*) OVER (PARTITION BY priority, failed) AS BIGINT) AS n FROM r
""")
def q_result_classes(spark, sf_dir):
    """Every order's result, the class it is in and that class's size;
    errors are classes of their own."""
    from keyspan.operators.report import result_classes
    lost = F.col("o_custkey") % 50 == 0
    r = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(
        lost, F.concat(F.lit("lost "), (F.col("o_orderkey") % 3).cast("string"))).alias("error"))
    classes, members = result_classes(r, "o_orderkey", "priority", "error")
    same = F.col("m.priority").eqNullSafe(F.col("c.priority")) & F.col("m.failed").eqNullSafe(F.col("c.failed"))
    return members.alias("m").join(classes.alias("c"), same).select("m.priority", "m.failed", "o_orderkey", "n")


@register("slow_query_percentiles", """
WITH l AS (SELECT event_type AS fingerprint, 'db' || (user_id % 4) AS db, value FROM events)
SELECT 'all' AS scope, fingerprint, db, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 4) AS total_ms,
       quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, max(value) AS max_ms
FROM l GROUP BY ALL
UNION ALL
SELECT 'db1', fingerprint, NULL, CAST(count(*) AS BIGINT), round(sum(value), 4), quantile_disc(value, 0.5),
       quantile_disc(value, 0.95), max(value)
FROM l WHERE db = 'db1' GROUP BY ALL
""")
def q_query_percentiles(spark, sf_dir):
    """Median and 95th percentile of every class and database, and of one
    database alone."""
    from keyspan.operators.report import query_digest
    log = _t(spark, sf_dir, "events").select(
        "event_type", F.concat(F.lit("db"), (F.col("user_id") % 4).cast("string")).alias("db"), "value")
    cols = ["calls", F.round("total_ms", 4).alias("total_ms"), "p50_ms", "p95_ms", "max_ms"]
    every = query_digest(log, "event_type", "value", db_col="db", by_db=True)
    one = query_digest(log, "event_type", "value", db="db1", db_col="db")
    return every.select(F.lit("all").alias("scope"), "fingerprint", "db", *cols).unionByName(
        one.select(F.lit("db1").alias("scope"), "fingerprint", F.lit(None).cast("string").alias("db"), *cols))


# --- I5, I6, I8 -----------------------------------------------------------------------


@register("replica_roots_furthest", """
WITH RECURSIVE n AS (
  SELECT c_custkey AS node, 'pool' || c_nationkey AS pool, CASE WHEN c_custkey % 40 <> 0 THEN c_custkey - c_custkey % 40 + (c_custkey % 40) // 3 END AS parent,
         CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 13) % 5 END AS fileno, (c_custkey * 17) % 4 AS pos
  FROM customer WHERE c_custkey % 40 <> 39),
t AS (SELECT node, CASE WHEN parent IS NULL OR parent = node THEN node ELSE parent END AS root, parent IS NULL AS stop FROM n
      UNION ALL
      SELECT t.node, coalesce(n.parent, t.root), n.parent IS NULL FROM t LEFT JOIN n ON n.node = t.root WHERE NOT t.stop),
r AS (SELECT node, root FROM t WHERE stop),
a AS (SELECT n.*, root FROM n JOIN r USING (node)),
m AS (SELECT pool, root, arg_min(node, (-fileno, -pos, node)) FILTER (fileno IS NOT NULL) AS furthest_node,
             max((fileno, pos)) FILTER (fileno IS NOT NULL) AS p, count(*) AS nodes, count(*) FILTER (fileno IS NULL) AS unknown
      FROM a GROUP BY pool, root),
e AS (SELECT a.pool, a.root, count(*) AS there FROM a JOIN m ON a.pool = m.pool AND a.root = m.root AND (a.fileno, a.pos) = m.p GROUP BY ALL)
SELECT m.pool, CAST(m.root AS BIGINT) AS root, CAST(furthest_node AS BIGINT) AS furthest_node, CAST(p[1] AS BIGINT) AS fileno,
       CAST(p[2] AS BIGINT) AS pos, CAST(coalesce(there, 0) AS BIGINT) AS there,
       CAST(nodes - unknown - coalesce(there, 0) AS BIGINT) AS behind, CAST(unknown AS BIGINT) AS unknown,
       count(*) OVER (PARTITION BY m.pool) = 1 AS comparable
FROM m LEFT JOIN e ON m.pool = e.pool AND m.root = e.root
""")
def q_replica_roots(spark, sf_dir):
    """I8: customers as nodes that replicate from each other in trees of 40, in
    the pools of their nations; furthest node of every root in every pool."""
    from keyspan.streaming.merge import furthest_replicas
    k = F.col("c_custkey").cast("long")
    up = (k - k % 40 + F.floor((k % 40) / 3)).cast("long")
    nodes = _t(spark, sf_dir, "customer").where(k % 40 != 39).select(
        k.alias("node"), F.concat(F.lit("pool"), F.col("c_nationkey").cast("string")).alias("pool"),
        F.when(k % 40 != 0, up).alias("parent"), F.when(k % 11 != 0, (k * 13) % 5).alias("fileno"), ((k * 17) % 4).alias("pos"))
    return furthest_replicas(nodes, "pool", "node", "parent", "fileno", "pos")


@register("command_counters_running", """
WITH w AS (SELECT user_id AS node, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS v,
                  CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS p FROM events GROUP BY ALL),
r AS (SELECT node, s, s AS until, sum(v) OVER o AS com_select, sum(p) OVER o AS com_insert, lag(s) OVER o AS before FROM w
      WINDOW o AS (PARTITION BY node ORDER BY s))
SELECT node, s AS second, until, CAST(com_select AS BIGINT) AS com_select, CAST(com_insert AS BIGINT) AS com_insert FROM r
UNION ALL SELECT node, before + 1, s - 1, NULL, NULL FROM r WHERE s > before + 1
""")
def q_counters_running(spark, sf_dir):
    """The counters' stream, summed up as they stand each second, with the
    stretches without a report as N/A."""
    from keyspan.streaming.monitor import command_counters, cumulative_counters
    e = _t(spark, sf_dir, "events").select("ts", F.col("user_id").alias("node"), F.when(
        F.col("event_type") == "view", "SELECT").when(F.col("event_type") == "purchase", "INSERT").otherwise("DELETE").alias("cmd"))
    root = scratch_path(spark, "running")
    e.write.parquet(f"{root}/in")
    windows = command_counters(spark.readStream.schema(e.schema).parquet(f"{root}/in"), "ts", "node", "cmd", ("select", "insert"))

    def put(batch, number):                                 # the windows that the batch changed, as they now stand
        batch.select("node", F.unix_seconds("window.start").alias("second"), "com_select", "com_insert").write.mode(
            "overwrite").parquet(f"{root}/out/batch={number}")

    windows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{root}/ckpt").trigger(
        availableNow=True).start().awaitTermination()
    kinds = ["com_select", "com_insert"]
    last = spark.read.parquet(f"{root}/out").groupBy("node", "second").agg(
        *[F.max_by(c, "batch").alias(c) for c in kinds])
    return cumulative_counters(last, "node", "second", kinds)


@register("backfill_stream", """
WITH s AS (SELECT max(event_id) // 2 AS cut, max(user_id) // 2 AS top FROM events),
c AS (SELECT user_id, event_id, CASE WHEN event_id > cut THEN value + 1 ELSE value END AS value FROM events, s)
SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM c, s WHERE user_id <= top GROUP BY user_id
""")
def q_backfill_stream(spark, sf_dir):
    """A snapshot, then two streaming runs over changes that came before
    and after its offset; the second goes on behind the first."""
    from keyspan.streaming.merge import latest_per_key, stream_backfill
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    last, top = e.agg(F.max("event_id"), F.max("user_id")).first()
    root = scratch_path(spark, "backfill-stream")
    latest_per_key(e.where(F.col("event_id") <= last // 2), ["user_id"], "event_id").write.parquet(f"{root}/snapshot")
    snap = spark.read.parquet(f"{root}/snapshot")
    taken_at = snap.agg(F.max("event_id")).first()[0]
    later = e.withColumn("value", F.col("value") + 1)
    later.where(F.col("event_id") % 3 != 0).repartition(4, "user_id").write.parquet(f"{root}/in")
    changes = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    stream_backfill(snap, changes, ["user_id"], "event_id", taken_at, f"{root}/target")
    later.where(F.col("event_id") % 3 == 0).repartition(3, "event_id").write.mode("append").parquet(f"{root}/in")
    return stream_backfill(snap, changes, ["user_id"], "event_id", taken_at, f"{root}/target", F.col("user_id") <= top // 2)


# --- J1 -------------------------------------------------------------------------------


@register("job_hooks", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders), n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM o)
SELECT * FROM (
  SELECT 'merge_write' AS step, 'before high' AS event, 1 AS place, n AS rows FROM n
  UNION ALL SELECT 'merge_write', 'before low', 2, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderkey % 5 <> 0)
  UNION ALL SELECT 'merge_write', 'after', 3, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderkey % 5 <> 0)
  UNION ALL SELECT 'rebuild_write', 'before', 4, n FROM n
  UNION ALL SELECT 'rebuild_write', 'after', 5, n FROM n
  UNION ALL SELECT 'alter_shards', 'before', 6, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderpriority = '1-URGENT')
  UNION ALL SELECT 'alter_shards', 'after', 7, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderpriority = '1-URGENT')
  UNION ALL SELECT 'alter_shards', 'before', 8, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderpriority <> '1-URGENT')
  UNION ALL SELECT 'alter_shards', 'after', 9, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_orderpriority <> '1-URGENT')
  UNION ALL SELECT 'cutover_map', 'before', 10, 1
  UNION ALL SELECT 'cutover_map', 'after', 11, 3
  UNION ALL SELECT 'cleanup_prune', 'before', 12, n FROM n
  UNION ALL SELECT 'cleanup_prune', 'after', 13, (SELECT CAST(count(*) AS BIGINT) FROM o WHERE o_custkey < (SELECT max(o_custkey) // 2 FROM o))
  UNION ALL SELECT 'merge_write', 'aborted', 14, 0)
""")
def q_job_hooks(spark, sf_dir):
    """Callbacks before and after the steps of five jobs, by priority, with
    the rows that each was given; the last job is aborted before it writes."""
    from keyspan.plans.hooks import Abort, Hooks, JobAborted
    from keyspan.plans.jobs import do_cutover, merge, rebuild, schema_change, split_cleanup
    from keyspan.sources.files import exists
    from keyspan.spec import shard_map_from_rows
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    top, root, seen, hooks = o.agg(F.max("o_custkey")).first()[0], scratch_path(spark, "hooks"), [], Hooks()

    def note(name, event, change=None):
        def call(df):
            df = df if change is None else change(df)
            seen.append((name, event, len(seen) + 1, df.count()))
            return df
        return call

    hooks.before("merge_write", 10)(note("merge_write", "before low", lambda d: d.where("o_orderkey % 5 <> 0")))
    hooks.before("merge_write", 900)(note("merge_write", "before high"))
    hooks.after("merge_write")(note("merge_write", "after"))
    for name in ("rebuild_write", "alter_shards", "cutover_map", "cleanup_prune"):
        hooks.before(name)(note(name, "before"))
        hooks.after(name)(note(name, "after"))
    merge({"a": o.where("o_orderkey % 2 = 0"), "b": o.where("o_orderkey % 2 = 1")}, ORDERS, f"{root}/merged", hooks=hooks)
    rebuild(o, ORDERS, f"{root}/rebuilt", hooks=hooks)
    schema_change(o.withColumnRenamed("o_orderpriority", "shard"), lambda d: d.withColumn("more", F.lit(1)), f"{root}/altered",
                  preflight="1-URGENT", hooks=hooks)
    open_shard = shard_map_from_rows(spark, [("custs", 0, None, "ready", None, 1)])
    do_cutover(open_shard, top + 1, "custs", hooks=hooks)
    kids = shard_map_from_rows(spark, [("custs", 0, top, "deprecated", None, 1),
                                       ("custs", 0, top // 2 - 1, "needs_cleanup", f"custs-0-{top}", 2)])
    split_cleanup(kids, f"custs-0-{top}", {f"custs-0-{top // 2 - 1}": o}, ORDERS, hooks)
    stop = Hooks()

    @stop.before("merge_write")
    def no(df):
        raise Abort

    try:
        merge({"a": o}, ORDERS, f"{root}/never", hooks=stop)
    except JobAborted:
        seen.append(("merge_write", "aborted", len(seen) + 1, int(exists(spark, f"{root}/never"))))
    return spark.createDataFrame(seen, "step string, event string, place int, rows long")


# --- A7, A14, I7, H6, H11, H13 --------------------------------------------------------


@register("import_strict", """
SELECT 'loaded' AS kind, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey END AS o_orderkey, o_totalprice FROM orders
UNION ALL SELECT 'refused', NULL, NULL
""")
def q_import_strict(spark, sf_dir):
    """A7 without a mode: the upper half of the keys loads into the lower one,
    rows without a key too; a load that brings keys again is refused."""
    from keyspan.operators.transfer import import_rows
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    half = o.agg(F.max("o_orderkey")).first()[0] // 2
    keyless = o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderkey")))
    low = F.col("o_orderkey") <= half
    old, new = keyless.where(low), keyless.where(~low | F.col("o_orderkey").isNull())
    rows = import_rows(old, new, ["o_orderkey"]).select(F.lit("loaded").alias("kind"), "*")
    try:
        import_rows(old, keyless, ["o_orderkey"]).write.format("noop").mode("overwrite").save()
    except Exception as e:
        if "duplicate key on import" not in str(e):
            raise
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in o.schema]
        rows = rows.unionByName(spark.range(1).select(F.lit("refused").alias("kind"), *none))
    return rows


@register("export_listing", f"""
WITH m AS (SELECT * FROM {MAP_SQL}),
f AS (SELECT m.name AS folder, sum(strlen(concat_ws(chr(9), o_orderkey, o_custkey, o_orderpriority)) + 1) AS bytes
      FROM orders o JOIN m ON o.o_custkey >= m.min_id AND (m.max_id IS NULL OR o.o_custkey <= m.max_id) GROUP BY 1)
SELECT folder, CAST(bytes AS BIGINT) AS bytes FROM f UNION ALL SELECT 'all', CAST(sum(bytes) AS BIGINT) FROM f
""")
def q_export_listing(spark, sf_dir):
    """The files of a text export by shard, listed with their sizes."""
    from keyspan.operators.route import route
    from keyspan.operators.transfer import write_tsv
    from keyspan.sources.files import dir_size, list_files
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = scratch_path(spark, "listed")
    write_tsv(route(o, "o_custkey", custs_map(spark, sf_dir), "custs", how="inner"), path, ("shard",))
    files = list_files(spark, path, "*.txt")
    folder = F.regexp_extract("rel_path", "^shard=([^/]+)/", 1).alias("folder")
    each = files.groupBy(folder).agg(F.sum("length").cast("long").alias("bytes"))
    return each.unionByName(dir_size(files).select(F.lit("all").alias("folder"), "bytes"))


@register("redelivery_stream", "SELECT event_id, user_id, value FROM events")
def q_redelivery_stream(spark, sf_dir):
    """Changes that come again, in the same run and in one after a stop,
    are applied once."""
    from keyspan.streaming.monitor import dedup_redelivery
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value")
    root = scratch_path(spark, "redelivery")

    def run():
        changes = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        dedup_redelivery(changes, ["event_id"]).writeStream.format("parquet").option(
            "checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out").awaitTermination()

    e.where("event_id % 4 <> 1").unionByName(e.where("event_id % 3 = 0")).write.parquet(f"{root}/in")
    run()
    e.where("event_id % 2 = 1").write.mode("append").parquet(f"{root}/in")
    run()
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@register("vertical_rows", """
SELECT l_orderkey, l_linenumber, 'part' AS kind, CAST(l_partkey AS BIGINT) AS id FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'supplier', CAST(l_suppkey AS BIGINT) FROM lineitem
""")
def q_vertical_rows(spark, sf_dir):
    """H6: a client's vertical output of two rows for every line item, parsed
    back into rows."""
    from keyspan.functions import parse_vertical_rows
    star = "*" * 27

    def row(n, kind, key):
        return F.concat(F.lit(f"{star} {n}. row {star}\n  Kind: {kind}\nempty:\n    Id: "), F.col(key).cast("string"), F.lit("\n"))

    text = F.concat(row(1, "part", "l_partkey"), row(2, "supplier", "l_suppkey"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(
        parse_vertical_rows(text, errors="raise")).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", F.col("r")["kind"].alias("kind"), F.col("r")["id"].cast("long").alias("id"))


@register("array_helpers", """
WITH s AS (SELECT o_orderkey, list_distinct([o_custkey % 4, o_custkey % 6, o_orderkey % 5, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END]) AS v
           FROM orders),
e AS (SELECT o_orderkey, unnest(v) AS x FROM s)
SELECT CAST(a.x AS BIGINT) AS a, CAST(b.x AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n
FROM e a JOIN e b ON a.o_orderkey = b.o_orderkey AND a.x < b.x GROUP BY 1, 2
""")
def q_array_helpers(spark, sf_dir):
    """Two short lists of every order as one sorted set, and its pairs."""
    from keyspan.functions import element_pairs, sorted_set
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    one = F.array(c % 4, c % 6)
    two = F.array(k % 5, F.when(k % 3 > 0, k % 3))
    pairs = _t(spark, sf_dir, "orders").select(F.explode(element_pairs(sorted_set(one, two))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("status_json", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'db' || o_custkey END AS from_host,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS BIGINT) END AS from_pid,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(1700000000 + o_custkey AS BIGINT) END AS at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'can_be_altered' ELSE o_orderpriority END AS state
FROM orders
""")
def q_status_json(spark, sf_dir):
    """Status documents of runs and of schema changes, written and read."""
    from keyspan.functions import alter_state, parse_run_status, run_status_json, set_alter_state
    k = F.col("o_orderkey")
    path = scratch_path(spark, "status")
    run = run_status_json(F.concat(F.lit("DB"), F.col("o_custkey").cast("string")), k, F.col("o_custkey") + 1_700_000_000)
    before = set_alter_state(F.lit(None).cast("string"), F.lit("needs_rename"))
    now = set_alter_state(before, F.when(k % 3 != 0, F.col("o_orderpriority")))
    _t(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 7 != 0, run).otherwise("").alias("run"), now.alias("alter")).write.parquet(path)
    r = spark.read.parquet(path).withColumn("run", parse_run_status(F.col("run")))
    return r.select("o_orderkey", "run.from_host", "run.from_pid", F.col("run.timestamp").alias("at"),
                    alter_state(F.col("alter")).alias("state"))
