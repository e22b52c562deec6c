"""Reports: statistics (D11), count rollups (D12), status matrix (D13),
nested location tree (D14), inverted results (D15), priority pick (D16),
query digest (D17), poll statistics (D18), deterministic sampling (B15),
counter deltas (E10) and caught-up detection (E11).

Per-group "latest n" / "first by priority" use aggregates (``max_by``) or
rank filters that Spark turns into a partial top-n before the shuffle
(WindowGroupLimit), so a hot group never ships all its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.operators.scan import grouped_lag, grouped_scan

# --- Fixed values -------------------------------------------------------------
DIGEST_LIMIT = 30           # top 30 slowest query classes
PERCENTILE_ACCURACY = 10_000
POLL_TRIES = 8              # samples per poll
CONN_MAX = 4                # more connections than this: taking connections
CONN_THRESHOLD = 1          # more new connections than this in the interval
CAUGHT_UP_POLLS = 3         # zero lag in 3 polls in a row
CATCH_UP_TIMEOUT = 21600    # seconds
SAMPLE_MASK = 7             # low 3 bits ...
SAMPLE_VALUE = 2            # ... equal to 2
# ------------------------------------------------------------------------------


def describe(df: DataFrame, col: str, by=()) -> DataFrame:
    """Mean, sum, sample variance and sample standard deviation."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(col).alias("mean"), F.sum(col).alias("total"),
                 F.var_samp(col).alias("variance"), F.stddev_samp(col).alias("stddev"),
                 F.count(col).alias("n"))


def count_rollup(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts at every prefix of ``levels`` plus a grand total."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                  F.grouping_id().cast("int").alias("lvl"))


def status_matrix(df: DataFrame, status: str, klass: str, classes: list[str],
                  aliases: list[str], excluded: str) -> tuple[DataFrame, DataFrame]:
    """Status x class count matrix with a row total, the excluded status
    reported apart as its total.  The total counts every row of the status,
    also those of classes that are not listed or NULL; a NULL status has a row
    of its own.  One aggregate, no pivot."""
    kept = df.filter(~F.col(status).eqNullSafe(F.lit(excluded)))
    matrix = kept.groupBy(status).agg(
        *[F.count_if(F.col(klass).eqNullSafe(F.lit(c))).cast("long").alias(a) for c, a in zip(classes, aliases)],
        F.count(F.lit(1)).cast("long").alias("total"))
    apart = df.filter(F.col(status) == excluded).agg(F.count(F.lit(1)).cast("long").alias("n")) \
        .select(F.lit(excluded).alias(status), "n")
    return matrix, apart


def nested_counts(df: DataFrame, levels: list[str], leaf: str) -> DataFrame:
    """Nest ``levels[0] -> levels[1] -> ... -> {leaf: count}`` as maps.
    Each level is one aggregate over the previous level's (small) result;
    the leaf holds counts, so no level collects raw rows."""
    cur = df.groupBy(*levels, leaf).agg(F.count(F.lit(1)).cast("long").alias("__n"))
    val = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(leaf), F.col("__n")))))
    cur = cur.groupBy(*levels).agg(val.alias("__m"))
    for i in range(len(levels) - 1, 0, -1):
        key = levels[i]
        by_key = (lambda k: lambda x, y: F.when(x[k] < y[k], -1).when(x[k] > y[k], 1).otherwise(0))(key)
        cur = cur.groupBy(*levels[:i]).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("__m"))), by_key))
            .alias("__m"))
    return cur.withColumnRenamed("__m", "tree")


def render_tree(c: Column) -> Column:
    """Deterministic text of a two-level ``map<string, map<string, long>>``:
    ``k1{a=1,b=2};k2{...}`` with keys sorted (maps are built sorted)."""
    inner = F.transform(F.map_entries(c), lambda e: F.concat(
        e["key"], F.lit("{"),
        F.array_join(F.transform(F.map_entries(e["value"]),
                                 lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","),
        F.lit("}")))
    return F.array_join(inner, ";")


def invert_results(results: DataFrame, key: str, value: str, error: str | None = None) -> DataFrame:
    """Value -> sorted list of keys that returned it; rows with an error
    are kept apart under ``value`` NULL and their own list."""
    r = results
    if error is not None:
        r = r.withColumn(value, F.when(F.col(error).isNull(), F.col(value)))
    return r.groupBy(value).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("keys"),
                                F.count(F.lit(1)).cast("long").alias("n"))


def result_classes(results: DataFrame, key: str, value: str, error: str | None = None) -> tuple[DataFrame, DataFrame]:
    """D15 at any size: the classes ``(value, failed, n)`` and the membership
    table ``(value, failed, key)`` that belongs to them.  Keys with an error are
    a class of their own per error (``value`` NULL, ``failed`` the error).  The
    classes are a partial aggregate, the members are not grouped at all, so a
    value that nearly all keys return is no single row or task."""
    failed = F.col(error).cast("string") if error is not None else F.lit(None).cast("string")
    members = results.select(F.when(failed.isNull(), F.col(value)).alias(value), failed.alias("failed"), F.col(key))
    return members.groupBy(value, "failed").agg(F.count(F.lit(1)).cast("long").alias("n")), members


def first_by_priority(df: DataFrame, group: str, is_local: Column, seq: str, cols) -> DataFrame:
    """Per group, the row of a local copy beats a remote one; among
    equals the last (largest ``seq``) wins.  ``max_by`` aggregate: partial
    per task, so a hot group is combined map-side."""
    pick = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(is_local.cast("int"), F.col(seq)))
    return df.groupBy(group).agg(pick.alias("__p")).select(group, "__p.*")


def fingerprint(stmt: Column) -> Column:
    """D17 query class: lower case, quoted strings and numbers replaced by
    ``?``, whitespace collapsed."""
    s = F.lower(stmt)
    s = F.regexp_replace(s, r"'[^']*'", "?")
    s = F.regexp_replace(s, r'"[^"]*"', "?")
    s = F.regexp_replace(s, r"\b\d+(\.\d+)?\b", "?")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(s)


def query_digest(log: DataFrame, stmt: str, ms: str, db: str | None = None, db_col: str | None = None,
                 limit: int = DIGEST_LIMIT, accuracy: int = PERCENTILE_ACCURACY, by_db: bool = False) -> DataFrame:
    """Top ``limit`` query classes by total time (a TakeOrdered, not
    a full sort), optional database filter or, with ``by_db``, a class per
    database: count, total, mean, median, 95th percentile and maximum
    milliseconds.  Percentiles come from a mergeable sketch per class (partial
    and final), whose rank error is at most 1 / ``accuracy`` of the calls; up to
    about that many calls it is exact."""
    if (db is not None or by_db) and db_col is None:
        raise ValueError("a database filter needs the column that names the database")
    d = log if db is None else log.filter(F.col(db_col) == db)
    keys = [fingerprint(F.col(stmt)).alias("fingerprint"), *([F.col(db_col).alias("db")] if by_db else [])]
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("calls"), F.sum(ms).alias("total_ms"),
        F.avg(ms).alias("mean_ms"), F.percentile_approx(ms, [0.5, 0.95], accuracy).alias("__p"), F.max(ms).alias("max_ms"))
    return (g.orderBy(F.col("total_ms").desc(), *[k for k in ("fingerprint", "db") if k in g.columns]).limit(limit)
            .withColumns({"p50_ms": F.col("__p")[0], "p95_ms": F.col("__p")[1]}).drop("__p"))


def poll_stats(samples: DataFrame, node: str, order, value: str, tries: int = POLL_TRIES) -> DataFrame:
    """Max and mean of the last ``tries`` integer samples per node.  The
    rank filter becomes a WindowGroupLimit (partial top-n before the
    shuffle)."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(node).orderBy(*[F.col(c).desc() for c in order])
    last = samples.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= tries)
    v = F.col(value).cast("long")
    return last.groupBy(node).agg(F.greatest(F.max(v), F.lit(0)).alias("max_value"),
                                  (F.sum(v) / F.lit(float(tries))).alias("avg_value"))


def deterministic_sample(df: DataFrame, col: str, mask: int = SAMPLE_MASK,
                         value: int = SAMPLE_VALUE, hashed: bool = False) -> DataFrame:
    """Keep rows whose key has ``key & 7 == 2`` (or the same test on a
    64-bit hash of the key, for keys with structure in the low bits)."""
    k = F.xxhash64(F.col(col)) if hashed else F.col(col).cast("long")
    return df.filter(k.bitwiseAND(F.lit(mask)) == value)


def counter_deltas(polls: DataFrame, node: str, order: list[str], counter: str, current: str,
                   max_current: int = CONN_MAX, threshold: int = CONN_THRESHOLD) -> DataFrame:
    """Per poll, the counter's growth since the previous poll of the
    same node (distributed lag, no per-node task) and the verdict: taking
    connections when current > max or growth > threshold; position moved
    when the counter changed."""
    lagged = grouped_lag(polls, [node], order, counter, "__prev")
    delta = F.col(counter) - F.col("__prev")
    return lagged.withColumn("delta", delta) \
        .withColumn("taking", (F.col(current) > max_current) | F.coalesce(delta > threshold, F.lit(False))) \
        .withColumn("moved", F.coalesce(delta != 0, F.lit(False))).drop("__prev")


def caught_up(polls: DataFrame, node: str, order: list[str], lag: str, ts: str,
              polls_needed: int = CAUGHT_UP_POLLS, seconds: str | None = None,
              timeout: int = CATCH_UP_TIMEOUT) -> DataFrame:
    """Per node, the first poll with the ``polls_needed``-th zero lag since
    the last positive one.  A NULL lag (broken replication) neither counts nor
    resets.  With ``seconds`` (a column of epoch seconds) polls ``timeout`` or
    more seconds after the node's first one come too late, and ``timed_out``
    tells the nodes that had not caught up by then.  Both running counts come
    from one two-pass scan, run starts from an aggregate: no node is ever
    gathered into one task."""
    p = polls
    if seconds is not None:
        first = polls.groupBy(node).agg(F.min(seconds).alias("__t0"))
        p = p.join(first, node).filter(F.col(seconds) - F.col("__t0") < timeout).drop("__t0")
    p = p.withColumn("__z", F.coalesce((F.col(lag) == 0).cast("int"), F.lit(0))) \
        .withColumn("__nz", F.coalesce((F.col(lag) != 0).cast("int"), F.lit(0)))
    p = grouped_scan(p, [node], order, ["__z", "__nz"], "sum", ["__zc", "__isl"])
    start = p.groupBy(node, "__isl").agg(F.min(F.col("__zc") - F.col("__z")).alias("__zs"))
    p = p.join(start, [node, "__isl"])
    hit = p.filter((F.col("__z") == 1) & (F.col("__zc") - F.col("__zs") >= polls_needed))
    done = hit.groupBy(node).agg(F.min(ts).alias("caught_up_at"))
    summary = polls.groupBy(node).agg(F.count(F.lit(1)).cast("long").alias("polls"),
                                      F.count_if(F.col(lag).isNull()).cast("long").alias("broken_polls"))
    out = summary.join(done, node, "left")
    if seconds is None:
        return out
    ended = polls.groupBy(node).agg((F.max(seconds) - F.min(seconds) >= timeout).alias("__late"))
    return out.join(ended, node).withColumn("timed_out", F.col("__late") & F.col("caught_up_at").isNull()).drop("__late")
