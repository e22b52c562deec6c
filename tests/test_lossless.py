"""Row-moving jobs and audits on the cases that once lost or hid rows."""

import pytest
from pyspark.sql import functions as F

from keyspan.operators.audit import checksum_diff, result_set_diff, row_hash
from keyspan.operators.counts import shard_counts
from keyspan.operators.rangejoin import plan_buckets, range_join
from keyspan.operators.report import caught_up, status_matrix
from keyspan.operators.route import route
from keyspan.operators.scan import grouped_scan
from keyspan.operators.transfer import read_tsv, write_tsv
from keyspan.plans.jobs import JobError, TableAlter, merge, rebuild_table, schema_change, split
from keyspan.session import checkpoint_dir, scratch_path
from keyspan.spec import TableSpec, shard_map_from_rows

TWO = TableSpec("t", keys=("a", "b"), pk=("id",))


def two_key_rows(spark):
    return spark.createDataFrame([(1, 10, 70), (2, 20, 30), (3, 80, 90), (4, 120, 60), (5, None, 55), (6, 200, 300),
                                  (7, None, None)], "id long, a long, b long")


def test_split_by_all_keys(spark):
    m = shard_map_from_rows(spark, [("p", 0, 99, "ready")])
    path = scratch_path(spark, "two")
    res = split(two_key_rows(spark), TWO, m, "p-0-99", path, n=2)
    got = {(r.shard, r.id) for r in spark.read.parquet(path).collect()}
    assert got == {("p-0-49", 1), ("p-50-99", 1), ("p-0-49", 2), ("p-50-99", 3), ("p-50-99", 4), ("p-50-99", 5)}
    assert {r.state for r in res.shard_map.filter("parent is not null").collect()} == {"replicating"}
    n = {r.shard: r.n for r in shard_counts(two_key_rows(spark), TWO, m).collect()}
    assert n == {"p-0-99": 5}


def test_split_guards_open_and_empty(spark):
    rows = two_key_rows(spark)
    busy = shard_map_from_rows(spark, [("p", 0, 99, "read_only")])
    with pytest.raises(JobError):
        split(rows, TWO, busy, "p-0-99", scratch_path(spark, "busy"))
    open_ = shard_map_from_rows(spark, [("p", 0, None, "ready")])
    path = scratch_path(spark, "open")
    split(rows, TWO, open_, "p-0-infinity", path, ranges=[(0, 99), (100, None)])
    assert {(r.shard, r.id) for r in spark.read.parquet(path).collect()} >= {("p-100-infinity", 6), ("p-0-99", 4),
                                                                             ("p-100-infinity", 4)}
    for bad in ([(0, 99), (101, None)], [(0, 99), (100, 500)], [(5, None)]):
        with pytest.raises(JobError):
            split(rows, TWO, open_, "p-0-infinity", scratch_path(spark, "bad"), ranges=bad)
    empty = shard_map_from_rows(spark, [("p", 1000, 1999, "ready")])
    res = split(rows, TWO, empty, "p-1000-1999", scratch_path(spark, "empty"), n=2)
    assert res.counts.count() == 0


def test_split_counts_are_independent_of_the_routing(spark):
    from keyspan.plans.hooks import Hooks
    h = Hooks()

    @h.before("split_write")
    def drop(df):
        return df.filter("id <> 2")

    m = shard_map_from_rows(spark, [("p", 0, 99, "ready")])
    with pytest.raises(JobError, match="mismatch"):
        split(two_key_rows(spark), TWO, m, "p-0-99", scratch_path(spark, "lost"), hooks=h)


def test_merge_takes_whole_keys_and_shared_rows(spark):
    spec = TableSpec("t", keys=("k",), pk=("k", "line"))
    a = spark.createDataFrame([(1, 1), (1, 2)], "k long, line long")
    b = spark.createDataFrame([(1, 3)], "k long, line long")
    assert merge({"a": a, "b": b}, spec, scratch_path(spark, "m1")).first()["valid"]
    with pytest.raises(JobError):
        merge({"a": a, "b": a}, spec, scratch_path(spark, "m2"))
    rows = two_key_rows(spark)
    path = scratch_path(spark, "m3")
    assert merge({"a": rows, "b": rows.filter("id < 4")}, TWO, path).first()["valid"]
    assert result_set_diff(rows, spark.read.parquet(path).select(*rows.columns)).count() == 0
    other = rows.withColumn("b", F.lit(1).cast("long"))
    with pytest.raises(JobError):
        merge({"a": rows, "b": other}, TWO, scratch_path(spark, "m4"))


def test_merge_of_two_keys_moves_its_rows_once(spark):
    """Counting, checking and writing read one stored result; nothing of it is computed twice."""
    from keyspan.plans.hooks import Hooks
    h, plans = Hooks(), []

    @h.before("merge_write")
    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    spec = TableSpec("t", keys=("a", "b"), pk=("id",))
    rows = spark.createDataFrame([(1, 1, 2, 0.5, "x"), (1, 1, 2, 0.5, "x"), (2, 3, 4, float("nan"), None), (3, 5, None, 0.0, ""),
                                  (None, 7, 8, None, "y"), (4, 9, 9, -1.0, "z")], "id long, a long, b long, q double, s string")
    path = scratch_path(spark, "m5")
    report = merge({"x": rows, "y": rows.filter("id < 4"), "z": rows.limit(1)}, spec, path, hooks=h).first()
    assert report["valid"] and report["merged_rows"] == 6
    assert result_set_diff(rows, spark.read.parquet(path).select(*rows.columns)).count() == 0
    assert len(plans) == 1 and "Exchange" not in plans[0]
    # two rows of one key on one shard are its own affair; on two shards they clash
    pair = rows.limit(1).unionByName(rows.limit(1).withColumn("s", F.lit("other")))
    assert merge({"x": pair, "y": rows.filter("id = 2")}, spec, scratch_path(spark, "m6")).first()["merged_rows"] == 3
    with pytest.raises(JobError, match="different rows"):
        merge({"x": pair, "y": rows.limit(1)}, spec, scratch_path(spark, "m7"))


def test_schema_change_sees_a_lost_shard(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, shard string")
    lost = schema_change(t, lambda d: d.filter("shard <> 'b'").withColumn("x", F.lit(1)), scratch_path(spark, "lost"))
    got = {r.shard: (r.phase, r.rows_before, r.rows_after, r.ok) for r in lost.collect()}
    assert got == {"a": ("preflight", 2, 2, True), "b": ("rest", 1, 0, False)}
    first = schema_change(t, lambda d: d.filter("shard <> 'a'"), scratch_path(spark, "first")).collect()
    assert [(r.shard, r.ok) for r in first] == [("a", False)]      # the rest is not touched
    swapped = schema_change(t.withColumn("y", F.col("id")), lambda d: d.withColumn("y", F.lit(None).cast("long")),
                            scratch_path(spark, "swapped"))
    assert not any(r.ok for r in swapped.collect())


def test_table_alter_states(spark):
    live = scratch_path(spark, "live")
    spark.createDataFrame([(1, "a"), (3, "b")], "id long, shard string").write.partitionBy("shard").parquet(live)
    job = TableAlter(spark, live)
    with pytest.raises(JobError):
        job.rename()
    with pytest.raises(JobError, match="verification"):
        TableAlter(spark, live).run(lambda d: d.filter("id > 1"))
    live2 = scratch_path(spark, "live2")
    spark.read.parquet(live).write.partitionBy("shard").parquet(live2)
    job = TableAlter(spark, live2)
    job.run(lambda d: d.withColumn("x", F.lit(7)), delayed_rename=True)
    assert job.state == "needs_rename" and "x" not in spark.read.parquet(live2).columns
    with pytest.raises(JobError):
        job.run(lambda d: d)
    job.rename()
    assert {r.x for r in spark.read.parquet(live2).collect()} == {7}
    assert "x" not in spark.read.parquet(f"{live2}.old").columns
    rebuilt = scratch_path(spark, "rebuilt")
    spark.range(50).withColumnRenamed("id", "k").write.parquet(rebuilt)
    rebuild_table(spark, rebuilt, TableSpec("r", keys=("k",), pk=("k",)))
    assert spark.read.parquet(rebuilt).count() == spark.read.parquet(f"{rebuilt}.old").count() == 50


def test_text_round_trip_of_any_string(spark):
    values = ["a\tb", "x\ny", "", "\\N", "\\", "\\\\n", "\\\n", " pad ", "\r\n", "\0", None, "é文", "\\t\t\\", "N"]
    df = spark.createDataFrame([(i, v, [v, None], float(i) / 3) for i, v in enumerate(values)],
                               "id long, v string, w array<string>, d double")
    path = scratch_path(spark, "text")
    write_tsv(df, path)
    assert sorted(read_tsv(spark, path, df.schema).collect()) == sorted(df.collect())
    one = df.select("v")
    path = scratch_path(spark, "one")
    write_tsv(one, path)
    assert sorted(map(repr, read_tsv(spark, path, one.schema).collect())) == sorted(map(repr, one.collect()))


def test_checksums_see_moved_nulls_and_outer_keys(spark):
    cols = "k long, p int, q int"
    a = spark.createDataFrame([(1, None, 1), (5, 2, None), (9, 1, 1)], cols)
    for extra in ([(1, 1, None), (5, 2, None), (9, 1, 1)], [(1, None, 1), (5, 2, None), (9, 1, 1), (99, 0, 0)],
                  [(1, None, 1), (5, 2, None), (9, 1, 1), (-4, 0, 0)], [(1, None, 1), (5, 2, None), (9, 1, 1), (None, 0, 0)]):
        assert checksum_diff(a, spark.createDataFrame(extra, cols), "k", 0, 9, 5, ["k", "p", "q"]).count() == 1
    assert checksum_diff(a, a, "k", 0, 4, 5, ["k", "p", "q"]).count() == 0
    h = a.select(row_hash(["p", "q"]).alias("h")).distinct().count()
    assert h == 3


def test_route_needs_the_pool_where_there_are_several(spark):
    m = shard_map_from_rows(spark, [("p", 0, 9, "ready"), ("q", 0, 9, "ready")])
    rows = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        route(rows, "k", m)
    assert route(rows, "k", m, "q").filter("shard = 'q-0-9'").count() == 10


def test_range_join_counts_overlaps_before_a_hint(spark):
    ranges = spark.range(400).selectExpr("id as min_id", "id + 100000 as max_id")
    plan = plan_buckets(ranges)
    assert plan.exploded_rows > 400 * 300           # overlapping ranges, counted and not guessed
    rows = spark.range(0, 100500, 1000).withColumnRenamed("id", "k")
    want = rows.join(ranges, (F.col("k") >= F.col("min_id")) & (F.col("k") <= F.col("max_id"))).count()
    assert range_join(rows, "k", ranges, broadcast_max_rows=1000).count() == want


def test_running_sum_with_nulls(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([None, 1, None, 1, None, None, 4])],
                               "g string, i int, v long")
    for parts in (1, 3, 7):
        got = [r.s for r in grouped_scan(df, ["g"], ["i"], "v", "sum", "s", partitions=parts).orderBy("i").collect()]
        assert got == [None, 1, 1, 2, 2, 2, 6]


def test_matrix_total_and_caught_up(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "odd"), ("a", None), (None, "x"), ("P", "x")], "s string, k string")
    m, apart = status_matrix(df, "s", "k", ["x"], ["x_n"], "P")
    assert {(r.s, r.x_n, r.total) for r in m.collect()} == {("a", 1, 3), (None, 1, 1)} and apart.first()["n"] == 1
    polls = spark.createDataFrame([("n", i, lag, i * 10000) for i, lag in enumerate([0, None, 0, 5, 0, None, 0, 0])]
                                  + [("z", i, 0, i * 20000) for i in range(4)], "node string, i int, lag int, t int")
    got = {r.node: r.caught_up_at for r in caught_up(polls, "node", ["i"], "lag", "i").collect()}
    assert got == {"n": 7, "z": 2}                  # a broken poll neither counts nor resets
    late = {r.node: (r.caught_up_at, r.timed_out) for r in
            caught_up(polls, "node", ["i"], "lag", "i", seconds="t").collect()}
    assert late == {"n": (None, True), "z": (None, True)}


def test_stream_detector_across_batches(spark):
    import numpy as np
    import pandas as pd
    from keyspan.streaming.monitor import _caught_up_fn

    class State:
        exists, hasTimedOut, kept = False, False, None

        @property
        def get(self):
            return self.kept

        def update(self, x):
            self.exists, self.kept = True, x

    def by_hand(lags):
        zeros = 0
        for i, x in enumerate(lags):
            zeros = zeros if x is None else zeros + 1 if x == 0 else 0
            if x == 0 and zeros >= 3:
                return i
        return None

    rng = np.random.default_rng(0)
    for _ in range(200):
        lags = [None if x == 0 else float(x > 3) for x in rng.integers(0, 6, 14)]
        state, out = State(), []
        fn = _caught_up_fn(3, None)
        for at in range(0, 14, 5):
            part = lags[at:at + 5]
            pdf = pd.DataFrame({"lag": [np.nan if x is None else x for x in part], "seq": range(at, at + len(part))})
            for frame in fn(("n",), iter([pdf]), state):
                out += frame.to_dict("records")
        hit = [r["at_seq"] for r in out if r["status"] == "caught_up"]
        assert hit == ([by_hand(lags)] if by_hand(lags) is not None else [])


def test_scratch_folders_are_dropped(spark, monkeypatch):
    from keyspan import session
    monkeypatch.setattr(session, "_scratch", [])
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    spark.range(3).write.parquet(f"{path}.old")
    assert session.drop_scratch(spark) == 2 and session._scratch == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_sorted_export_numbers_lines_of_split_files(spark):
    """Files of several splits, in as many files as the session has shuffle partitions."""
    from keyspan.plans.catalog_moves import q_export_sorted
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in names}
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_custkey", "o_orderkey")
    want = [(i, r.o_custkey, r.o_orderkey) for i, r in enumerate(o.orderBy("o_custkey", "o_orderkey").collect(), 1)]
    try:
        for k, v in zip(names, ("4000", "1")):
            spark.conf.set(k, v)
        got = q_export_sorted(spark, "/root/testdata/sf0.01")
        assert sorted((r.line, r.o_custkey, r.o_orderkey) for r in got.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
