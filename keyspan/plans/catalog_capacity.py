"""Registered capacity-analytics queries (E1-E9, D6-D10, D8/F1) over the
history fixture derived from ``events`` (FIXTURES.md: pool = event_type,
ts = epoch seconds, id = event_id, used = exact running sum, total = 115 %
of the largest final usage, now = 2024-01-31 00:00:00 UTC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyspan.operators import capacity as cap
from keyspan.plans.catalog import ORACLE, _t, register

NOW = 1706659200  # 2024-01-31 00:00:00 UTC
NOW_DAY = "2024-01-31"

HIST_SQL = """
inc AS (SELECT event_type AS pool, ts AS ts0, event_id AS id,
               CAST(round(value * 100) AS BIGINT) * 10000 AS inc FROM events),
tot AS (SELECT (max(s) * 115) // 100 AS total FROM (SELECT sum(inc) AS s FROM inc GROUP BY pool)),
hist AS (
  SELECT pool, CAST(epoch_us(ts0) // 1000000 AS BIGINT) AS ts, id, CAST(tot.total AS BIGINT) AS total,
         CAST(sum(inc) OVER (PARTITION BY pool ORDER BY ts0, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
  FROM inc, tot),
h AS (SELECT pool, ts, min(id) AS first_id, max(id) AS id, arg_max(used, id) AS used,
             arg_max(total, id) AS total FROM hist GROUP BY pool, ts)"""

SEG_SQL = HIST_SQL + """,
anch(pool, ts) AS (
  SELECT pool, min(ts) FROM h GROUP BY pool
  UNION ALL
  SELECT pool, nxt FROM (
    SELECT a.pool, (SELECT min(h2.ts) FROM h h2 WHERE h2.pool = a.pool AND h2.ts > a.ts + 86340) AS nxt
    FROM anch a) WHERE nxt IS NOT NULL),
sg AS (
  SELECT a.pool, a.ts AS seg_start,
         coalesce((SELECT min(h2.ts) FROM h h2 WHERE h2.pool = a.pool AND h2.ts > a.ts + 86340),
                  CASE WHEN l.last > a.ts THEN l.last END) AS seg_end
  FROM anch a JOIN (SELECT pool, max(ts) AS last FROM h GROUP BY pool) l USING (pool)),
segs AS (
  SELECT s.pool, s.seg_start, s.seg_end, CAST(s.seg_start AS VARCHAR) || '-' || CAST(s.seg_end AS VARCHAR) AS seg_key,
         CAST(h1.used - h0.used AS DOUBLE) / CAST(s.seg_end - s.seg_start AS DOUBLE) AS rate,
         CAST(row_number() OVER (PARTITION BY s.pool ORDER BY s.seg_start) AS INTEGER) AS seg_no
  FROM sg s JOIN h h0 ON h0.pool = s.pool AND h0.ts = s.seg_start
            JOIN h h1 ON h1.pool = s.pool AND h1.ts = s.seg_end
  WHERE s.seg_end IS NOT NULL),
growth AS (
  SELECT pool, sum(rate * CASE WHEN k = n THEN pow(0.5, n - 1) ELSE pow(0.5, k) END) AS growth_rate,
         avg(rate) AS mean_rate, count(*) AS segments
  FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY seg_start DESC) AS k,
               count(*) OVER (PARTITION BY pool) AS n FROM segs) GROUP BY pool),
cur AS (SELECT pool, arg_max(total, (ts, id)) AS total, arg_max(used, (ts, id)) AS used
        FROM hist GROUP BY pool)"""


def _hist(spark, sf_dir):
    return cap.history_from_events(_t(spark, sf_dir, "events"))


def _segments(spark, sf_dir):
    return cap.segmentify(_hist(spark, sf_dir))


@register("history_dedup", "WITH " + HIST_SQL + """
SELECT pool, ts, first_id, id, used, total FROM h
""")
def q_history_dedup(spark, sf_dir):
    return cap.dedup_history(_hist(spark, sf_dir)).select("pool", "ts", "first_id", "id", "used", "total")


@register("growth_segments", "WITH RECURSIVE " + SEG_SQL + """
SELECT pool, seg_start, seg_end, seg_key, rate, seg_no FROM segs
""")
def q_growth_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@register("decaying_growth", "WITH RECURSIVE " + SEG_SQL + """
SELECT pool, round(growth_rate, 6) AS growth_rate, round(mean_rate, 6) AS mean_rate,
       CAST(segments AS BIGINT) AS segments FROM growth
""")
def q_decaying_growth(spark, sf_dir):
    g = cap.decaying_growth(_segments(spark, sf_dir))
    return g.select("pool", F.round("growth_rate", 6).alias("growth_rate"),
                    F.round("mean_rate", 6).alias("mean_rate"), F.col("segments").cast("long"))


@register("days_left", "WITH RECURSIVE " + SEG_SQL + """
SELECT c.pool, round(CAST(c.used AS DOUBLE) / (1024.0 * 1049000.0), 6) AS used_gb,
       round(g.growth_rate / (1024.0 * 1049000.0) * 86400, 6) AS gb_per_day,
       round(CASE WHEN g.growth_rate IS NULL OR g.growth_rate / (1024.0 * 1049000.0) * 86400 <= 0
                   OR (0.85 * c.total - c.used) / (g.growth_rate * 86400) > 999 THEN NULL
                  ELSE (0.85 * c.total - c.used) / (g.growth_rate * 86400) END, 6) AS days_left
FROM cur c LEFT JOIN growth g USING (pool)
""")
def q_days_left(spark, sf_dir):
    h = _hist(spark, sf_dir)
    d = cap.days_left(cap.current_usage(h), cap.decaying_growth(cap.segmentify(h)))
    return d.select("pool", *[F.round(c, 6).alias(c) for c in ("used_gb", "gb_per_day", "days_left")])


@register("day_over_day", "WITH RECURSIVE " + SEG_SQL + """,
r AS (SELECT pool, rate, row_number() OVER (PARTITION BY pool ORDER BY seg_start DESC) - 1 AS r FROM segs)
SELECT pool,
  round(max(CASE WHEN r = 0 THEN rate / (1024.0 * 1049000.0) * 86400 END), 6) AS d0,
  round(max(CASE WHEN r = 1 THEN rate / (1024.0 * 1049000.0) * 86400 END), 6) AS d1,
  round(max(CASE WHEN r = 2 THEN rate / (1024.0 * 1049000.0) * 86400 END), 6) AS d2,
  round(max(CASE WHEN r = 7 THEN rate / (1024.0 * 1049000.0) * 86400 END), 6) AS d7,
  round(max(CASE WHEN r = 14 THEN rate / (1024.0 * 1049000.0) * 86400 END), 6) AS d14
FROM r GROUP BY pool
""")
def q_day_over_day(spark, sf_dir):
    d = cap.day_over_day(_segments(spark, sf_dir))
    return d.select("pool", *[F.round(f"d{n}", 6).alias(f"d{n}") for n in cap.DOD_OFFSETS])


@register("total_consumed", "WITH RECURSIVE " + SEG_SQL + """
SELECT CAST(sum(c.used) AS BIGINT) AS total_used,
       round(sum(g.growth_rate * 86400), 4) AS total_growth_per_day
FROM cur c LEFT JOIN growth g USING (pool)
""")
def q_total_consumed(spark, sf_dir):
    h = _hist(spark, sf_dir)
    t = cap.total_consumed(cap.current_usage(h), cap.decaying_growth(cap.segmentify(h)))
    return t.select("total_used", F.round("total_growth_per_day", 4).alias("total_growth_per_day"))


@register("threshold_buckets", "WITH " + HIST_SQL + """,
cur AS (SELECT pool, arg_max(total, (ts, id)) AS total, arg_max(used, (ts, id)) AS used FROM hist GROUP BY pool)
SELECT pool, round(CAST(used AS DOUBLE) / total, 6) AS fill,
       CASE WHEN CAST(used AS DOUBLE) / total > 0.85 THEN 'critical'
            WHEN CAST(used AS DOUBLE) / total > 0.80 THEN 'warning' ELSE 'none' END AS bucket
FROM cur
""")
def q_threshold_buckets(spark, sf_dir):
    b = cap.threshold_buckets(cap.current_usage(_hist(spark, sf_dir)))
    return b.select("pool", F.round("fill", 6).alias("fill"), "bucket")


# --- outliers ------------------------------------------------------------------

def _n_blocks(now=NOW):
    start0 = now - cap.OUTLIER_DAYS * cap.DAY
    n = 0
    while start0 + n * cap.BLOCK_STEP + cap.BLOCK_MIN_TAIL < now:
        n += 1
    return n


OUT_SQL = HIST_SQL + f""",
blk AS (
  SELECT p.pool, b.block, l.lag, {NOW - 3 * 86400} + b.block * 7200 AS start,
         {NOW - 3 * 86400} + b.block * 7200 - l.lag * 86400 AS lo,
         {NOW - 3 * 86400} + b.block * 7200 - l.lag * 86400 + 7320 AS hi
  FROM (SELECT DISTINCT pool FROM h) p, range(0, {_n_blocks()}) b(block),
       (VALUES (0), (7), (14), (21), (28)) l(lag)),
per AS (
  SELECT b.pool, b.block, b.start, b.lag, count(*) AS n,
         arg_min(h.used, h.first_id) AS fu, arg_min(h.ts, h.first_id) AS ft,
         arg_max(h.used, h.first_id) AS lu, arg_max(h.ts, h.first_id) AS lt
  FROM blk b JOIN h ON h.pool = b.pool AND h.ts BETWEEN b.lo AND b.hi
  GROUP BY b.pool, b.block, b.start, b.lag),
pr AS (SELECT *, CASE WHEN ft = lt THEN NULL ELSE CAST(fu - lu AS DOUBLE) / CAST(ft - lt AS DOUBLE) END AS rate
       FROM per),
cu AS (SELECT pool, block, start, n AS now_n, rate AS now_rate FROM pr WHERE lag = 0),
ba AS (SELECT pool, block,
         max(CASE WHEN lag = 7 THEN rate END) AS b7, max(CASE WHEN lag = 14 THEN rate END) AS b14,
         max(CASE WHEN lag = 21 THEN rate END) AS b21, max(CASE WHEN lag = 28 THEN rate END) AS b28,
         coalesce(bool_or(lag = 7), false) AS k7, coalesce(bool_or(lag = 14), false) AS k14,
         coalesce(bool_or(lag = 21), false) AS k21, coalesce(bool_or(lag = 28), false) AS k28
       FROM pr WHERE lag > 0 AND n >= 2 GROUP BY pool, block),
j0 AS (SELECT cu.*, ba.b7, ba.b14, ba.b21, ba.b28, coalesce(ba.k7, false) AS k7, coalesce(ba.k14, false) AS k14,
              coalesce(ba.k21, false) AS k21, coalesce(ba.k28, false) AS k28
       FROM cu LEFT JOIN ba USING (pool, block)),
m1 AS (SELECT *, (CASE WHEN k7 THEN b7 ELSE 0 END + CASE WHEN k14 THEN b14 ELSE 0 END + CASE WHEN k21 THEN b21 ELSE 0 END
                  + CASE WHEN k28 THEN b28 ELSE 0 END)
                 / (CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT)) AS mean FROM j0),
s1 AS (SELECT * REPLACE (k7 AND NOT coalesce(b7 > mean * 5 OR b7 < mean * -5, false) AS k7) FROM m1),
m2 AS (SELECT * REPLACE ((CASE WHEN k7 THEN b7 ELSE 0 END + CASE WHEN k14 THEN b14 ELSE 0 END
                  + CASE WHEN k21 THEN b21 ELSE 0 END + CASE WHEN k28 THEN b28 ELSE 0 END)
                 / (CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT)) AS mean) FROM s1),
s2 AS (SELECT * REPLACE (k14 AND NOT coalesce(b14 > mean * 5 OR b14 < mean * -5, false) AS k14) FROM m2),
m3 AS (SELECT * REPLACE ((CASE WHEN k7 THEN b7 ELSE 0 END + CASE WHEN k14 THEN b14 ELSE 0 END
                  + CASE WHEN k21 THEN b21 ELSE 0 END + CASE WHEN k28 THEN b28 ELSE 0 END)
                 / (CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT)) AS mean) FROM s2),
s3 AS (SELECT * REPLACE (k21 AND NOT coalesce(b21 > mean * 5 OR b21 < mean * -5, false) AS k21) FROM m3),
m4 AS (SELECT * REPLACE ((CASE WHEN k7 THEN b7 ELSE 0 END + CASE WHEN k14 THEN b14 ELSE 0 END
                  + CASE WHEN k21 THEN b21 ELSE 0 END + CASE WHEN k28 THEN b28 ELSE 0 END)
                 / (CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT)) AS mean) FROM s3),
s4 AS (SELECT * REPLACE (k28 AND NOT coalesce(b28 > mean * 5 OR b28 < mean * -5, false) AS k28) FROM m4),
fin AS (SELECT pool, block, start, now_n, now_rate,
          CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT) AS baseline_n,
          (CASE WHEN k7 THEN b7 ELSE 0 END + CASE WHEN k14 THEN b14 ELSE 0 END
           + CASE WHEN k21 THEN b21 ELSE 0 END + CASE WHEN k28 THEN b28 ELSE 0 END)
          / nullif(CAST(k7 AS INT) + CAST(k14 AS INT) + CAST(k21 AS INT) + CAST(k28 AS INT), 0) AS baseline_mean
        FROM s4),
fl AS (SELECT *, now_n > 0 AND baseline_n > 0 AS evaluated,
         coalesce((now_rate > baseline_mean * 2.2 AND baseline_mean <> 0)
                  OR (baseline_mean = 0 AND now_rate > 1048576), false) AS sustained,
         coalesce((now_rate > baseline_mean * 5.0 AND baseline_mean <> 0)
                  OR (baseline_mean = 0 AND now_rate > 1048576), false) AS spike
       FROM fin)"""


def _blocks(spark, sf_dir):
    h = cap.dedup_history(_hist(spark, sf_dir))
    return cap.outlier_blocks(h, NOW)


@register("outlier_baseline", "WITH " + OUT_SQL + """
SELECT pool, CAST(block AS INTEGER) AS block, CAST(start AS BIGINT) AS start, CAST(now_n AS BIGINT) AS now_n,
       round(now_rate, 6) AS now_rate, CAST(baseline_n AS INTEGER) AS baseline_n,
       round(baseline_mean, 6) AS baseline_mean
FROM fin
""")
def q_outlier_baseline(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.select("pool", F.col("block").cast("int"), F.col("start").cast("long"),
                    F.col("now_n").cast("long"), F.round("now_rate", 6).alias("now_rate"),
                    F.col("baseline_n").cast("int"), F.round("baseline_mean", 6).alias("baseline_mean"))


@register("outlier_runs", "WITH " + OUT_SQL + """,
e AS (SELECT *, sum(CASE WHEN sustained THEN 0 ELSE 1 END)
                  OVER (PARTITION BY pool ORDER BY block ROWS UNBOUNDED PRECEDING) AS isl
      FROM fl WHERE evaluated),
r AS (SELECT pool, isl, count(*) AS blocks, min(start) AS run_start, arg_max(start, block) AS ls,
             arg_max(now_rate, block) AS lr, arg_max(baseline_mean, block) AS lm
      FROM e WHERE sustained GROUP BY pool, isl),
z AS (SELECT pool, sum(CASE WHEN sustained THEN 0 ELSE 1 END) AS resets FROM e GROUP BY pool)
SELECT r.pool, CAST(run_start AS BIGINT) AS run_start, CAST(ls + 7320 AS BIGINT) AS run_end,
       CAST(blocks AS BIGINT) AS blocks,
       round(lr / (1024.0 * 1049000.0) * 86400, 6) AS usage_gb_day,
       round(lm / (1024.0 * 1049000.0) * 86400, 6) AS prev_weeks_gb_day
FROM r JOIN z USING (pool) WHERE blocks > 3 AND resets > isl
""")
def q_outlier_runs(spark, sf_dir):
    r = cap.outlier_runs(_blocks(spark, sf_dir))
    return r.select("pool", F.col("run_start").cast("long"), F.col("run_end").cast("long"),
                    F.col("blocks").cast("long"), F.round("usage_gb_day", 6).alias("usage_gb_day"),
                    F.round("prev_weeks_gb_day", 6).alias("prev_weeks_gb_day"))


# A history with known outliers on top of the hours found in ``events``: one
# pool with a closed run of blocks, one with a run too short, one whose run is
# still open at the end, and two without.
RUNS_SQL = f"""
g AS (SELECT event_type AS pool, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS ts, min(event_id) AS first_id
      FROM events GROUP BY ALL),
i AS (SELECT *, CASE WHEN pool = 'view' AND ts BETWEEN {NOW - 60 * 3600} AND {NOW - 40 * 3600}
                       OR pool = 'purchase' AND ts BETWEEN {NOW - 50 * 3600} AND {NOW - 47 * 3600}
                       OR pool = 'click' AND ts >= {NOW - 30 * 3600} THEN 9000000 ELSE 1000000 END AS inc FROM g),
h AS (SELECT pool, ts, first_id, first_id AS id, CAST(0 AS BIGINT) AS total,
             CAST(sum(inc) OVER (PARTITION BY pool ORDER BY ts) AS BIGINT) AS used FROM i)"""


def _runs_history(spark, sf_dir):
    from keyspan.operators.scan import grouped_scan
    e = _t(spark, sf_dir, "events")
    g = e.groupBy(F.col("event_type").alias("pool"),
                  (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long").alias("ts")) \
        .agg(F.min("event_id").alias("first_id"))
    at, pool = F.col("ts"), F.col("pool")
    high = (((pool == "view") & at.between(NOW - 60 * 3600, NOW - 40 * 3600))
            | ((pool == "purchase") & at.between(NOW - 50 * 3600, NOW - 47 * 3600))
            | ((pool == "click") & (at >= NOW - 30 * 3600)))
    i = g.withColumn("inc", F.when(high, 9000000).otherwise(1000000).cast("long"))
    return grouped_scan(i, ["pool"], ["ts"], "inc", "sum", "used").select("pool", "ts", "first_id", "used")


@register("outlier_runs_found", "WITH " + OUT_SQL.replace(HIST_SQL, RUNS_SQL) + """,
e AS (SELECT *, sum(CASE WHEN sustained THEN 0 ELSE 1 END)
                  OVER (PARTITION BY pool ORDER BY block ROWS UNBOUNDED PRECEDING) AS isl
      FROM fl WHERE evaluated),
r AS (SELECT pool, isl, count(*) AS blocks, min(start) AS run_start, arg_max(start, block) AS ls
      FROM e WHERE sustained GROUP BY pool, isl),
z AS (SELECT pool, sum(CASE WHEN sustained THEN 0 ELSE 1 END) AS resets FROM e GROUP BY pool)
SELECT 'run' AS kind, r.pool, CAST(run_start AS BIGINT) AS run_start, CAST(ls + 7320 AS BIGINT) AS run_end,
       CAST(blocks AS BIGINT) AS blocks FROM r JOIN z USING (pool) WHERE blocks > 3 AND resets > isl
UNION ALL
SELECT 'spike', pool, CAST(start AS BIGINT), CAST(start + 7320 AS BIGINT), CAST(1 AS BIGINT) FROM fl WHERE evaluated AND spike
""")
def q_outlier_runs_found(spark, sf_dir):
    """E8 and E9 where there is something to find: closed, short and open runs."""
    b = cap.outlier_blocks(_runs_history(spark, sf_dir), NOW).checkpoint()
    runs = cap.outlier_runs(b).select(F.lit("run").alias("kind"), "pool", F.col("run_start").cast("long"),
                                      F.col("run_end").cast("long"), F.col("blocks").cast("long"))
    spikes = cap.outlier_spikes(b).select(F.lit("spike").alias("kind"), "pool", F.col("start").cast("long").alias("run_start"),
                                          F.col("end").cast("long").alias("run_end"), F.lit(1).cast("long").alias("blocks"))
    return runs.unionByName(spikes)


@register("outlier_spikes", "WITH " + OUT_SQL + """
SELECT pool, CAST(start AS BIGINT) AS start, CAST(start + 7320 AS BIGINT) AS "end",
       strftime(epoch_ms(CAST(start AS BIGINT) * 1000), '%m/%d/%Y %H:%M:%S') AS start_time,
       strftime(epoch_ms(CAST(start + 7320 AS BIGINT) * 1000), '%m/%d/%Y %H:%M:%S') AS end_time,
       round(now_rate / (1024.0 * 1049000.0) * 86400, 6) AS usage_gb_day,
       round(baseline_mean / (1024.0 * 1049000.0) * 86400, 6) AS prev_weeks_gb_day
FROM fl WHERE evaluated AND spike
""")
def q_outlier_spikes(spark, sf_dir):
    s = cap.outlier_spikes(_blocks(spark, sf_dir))
    return s.select("pool", F.col("start").cast("long"), F.col("end").cast("long"), "start_time", "end_time",
                    F.round("usage_gb_day", 6).alias("usage_gb_day"),
                    F.round("prev_weeks_gb_day", 6).alias("prev_weeks_gb_day"))


# --- D8 / F1 key exhaustion -------------------------------------------------------

KEY_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEY_POOLS = {"orders": "custs", "customer": "custs", "lineitem": "parts"}


def _is_key(name: str) -> bool:
    return name.endswith("key") or name.endswith("_id")


# integer key columns of the driver tables and their Spark types (for the
# oracle text; the Spark side reads the same facts from the schemas)
KEY_COLUMNS = (
    ("region", "r_regionkey", "int"), ("nation", "n_nationkey", "int"),
    ("nation", "n_regionkey", "int"), ("customer", "c_custkey", "bigint"),
    ("customer", "c_nationkey", "int"), ("supplier", "s_suppkey", "bigint"),
    ("supplier", "s_nationkey", "int"), ("part", "p_partkey", "bigint"),
    ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"),
    ("lineitem", "l_orderkey", "bigint"), ("lineitem", "l_partkey", "bigint"),
    ("lineitem", "l_suppkey", "bigint"), ("events", "event_id", "bigint"),
    ("events", "user_id", "bigint"), ("documents", "doc_id", "bigint"),
    ("embeddings", "vec_id", "bigint"), ("pages", "page_id", "bigint"),
    ("benchmark", "item_id", "bigint"), ("labels", "doc_id", "bigint"),
    ("conversations", "conv_id", "bigint"),
)


def _key_sql() -> str:
    parts = [f"SELECT '{KEY_POOLS.get(t, 'functional')}' AS pool, '{t}' AS table_name, "
             f"'{c}' AS column_name, '{ty}' AS column_type, CAST(max({c}) AS DECIMAL(20,0)) AS max_val, "
             f"CAST({cap.type_max(ty)} AS DECIMAL(20,0)) AS data_type_max FROM {t}"
             for t, c, ty in KEY_COLUMNS]
    return ("WITH s AS (" + " UNION ALL ".join(parts) + """),
f AS (SELECT *, CAST(max_val AS DOUBLE) / CAST(data_type_max AS DOUBLE) AS fraction FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY pool, table_name ORDER BY fraction DESC, column_name DESC) AS rk
      FROM f)
SELECT pool, table_name, column_name, column_type, max_val, data_type_max, round(fraction, 2) AS ratio, fraction
FROM b WHERE rk = 1 ORDER BY ratio DESC, fraction DESC, pool, table_name LIMIT 5""")


@register("key_exhaustion_top5", _key_sql())
def q_key_exhaustion(spark, sf_dir):
    tables = {t: _t(spark, sf_dir, t) for t in KEY_TABLES}
    samples = cap.key_exhaustion(tables, KEY_POOLS, NOW, _is_key)
    return cap.top_exhaustion(samples, NOW_DAY)


# --- K8, H2, H5 --------------------------------------------------------------------


@register("capacity_plan", f"""
WITH d AS ({ORACLE["days_left"]}), o AS ({ORACLE["day_over_day"]}), t AS ({ORACLE["threshold_buckets"]}),
x AS ({ORACLE["total_consumed"]}),
r AS (SELECT pool, count(*) AS segments FROM ({ORACLE["growth_segments"]}) GROUP BY pool)
SELECT pool, used_gb, gb_per_day, days_left, d0, d1, d7, fill, bucket, CAST(segments AS BIGINT) AS segments, total_used,
       total_growth_per_day
FROM d LEFT JOIN o USING (pool) LEFT JOIN t USING (pool) LEFT JOIN r USING (pool), x
""")
def q_capacity_plan(spark, sf_dir):
    """K8: the report of the job on one stored snapshot of the history, its
    parts side by side per pool."""
    from keyspan.plans.jobs import capacity_plan
    plan = capacity_plan(_hist(spark, sf_dir), NOW)
    six = lambda *names: [F.round(c, 6).alias(c) for c in names]
    left = plan["days_left"].select("pool", *six("used_gb", "gb_per_day", "days_left"))
    days = plan["day_over_day"].select("pool", *six("d0", "d1", "d7"))
    fill = plan["thresholds"].select("pool", *six("fill"), "bucket")
    count = plan["segments"].groupBy("pool").agg(F.count("*").cast("long").alias("segments"))
    total = plan["total"].select("total_used", F.round("total_growth_per_day", 4).alias("total_growth_per_day"))
    report = left.join(days, "pool", "left").join(fill, "pool", "left").join(count, "pool", "left")
    # the total is one row
    return report.withColumns({c: total.select(c).scalar() for c in total.columns})


@register("size_units", """
SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0)
                    ELSE printf('%.2f B', b * 1.0) END AS size,
       CAST(b * 604800 AS DOUBLE) AS per_week, CAST(b * 2592000 AS DOUBLE) AS per_month,
       round(CAST(b AS DOUBLE) / (1024 * 1024), 9) AS mb
FROM (SELECT doc_id, strlen(text) * 64 + 1 AS b FROM documents)
""")
def q_size_units(spark, sf_dir):
    """H1/H2: sizes in words and rates per week and month."""
    b = F.octet_length("text").cast("long") * 64 + 1
    return _t(spark, sf_dir, "documents").select(
        "doc_id", cap.humanize_bytes(b).alias("size"), F.round(cap.per_week(b).cast("double"), 4).alias("per_week"),
        F.round(cap.per_month(b).cast("double"), 4).alias("per_month"), F.round(cap.bytes_to_mb(b), 9).alias("mb"))


TYPE_TEXTS_SQL = "['int(11) unsigned', 'bigint(20)', 'smallint(5) unsigned', 'INT', 'varchar(9)', 'mediumint(8) unsigned zerofill']"


@register("key_type_limits", f"""
WITH t AS (SELECT o_orderkey, {TYPE_TEXTS_SQL}[o_orderkey % 6 + 1] AS column_type,
                  CASE WHEN o_orderkey % 4 = 0 THEN 'auto_increment' WHEN o_orderkey % 4 = 1 THEN 'on update' ELSE '' END AS extra FROM orders),
m AS (SELECT *, regexp_extract(lower(column_type), '^[a-z]+') AS base, regexp_matches(lower(column_type), 'unsigned$') AS unsigned FROM t),
x AS (SELECT *, CASE base WHEN 'int' THEN 4294967296 WHEN 'bigint' THEN 18446744073709551616 WHEN 'smallint' THEN 65536
                          WHEN 'mediumint' THEN 16777216 END AS top FROM m)
SELECT o_orderkey, column_type, contains(extra, 'auto_increment') AS auto_increment, unsigned,
       CAST(CASE WHEN unsigned THEN top ELSE top // 2 - 1 END AS DECIMAL(20, 0)) AS data_type_max
FROM (SELECT * REPLACE (CAST(top AS HUGEINT) AS top) FROM x)
""")
def q_key_type_limits(spark, sf_dir):
    """H5 with H3: what a column's type text says of it."""
    from keyspan.sources.schema import int_type_flags
    texts = ["int(11) unsigned", "bigint(20)", "smallint(5) unsigned", "INT", "varchar(9)", "mediumint(8) unsigned zerofill"]
    k = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(
        k, F.get(F.array(*[F.lit(t) for t in texts]), (k % 6).cast("int")).alias("column_type"),
        F.when(k % 4 == 0, "auto_increment").when(k % 4 == 1, "on update").otherwise("").alias("extra"))
    return o.select("o_orderkey", "column_type", *int_type_flags(F.col("column_type"), F.col("extra")))
