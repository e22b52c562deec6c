"""C10 over several runs, A3/A8 without loss, K7 with unlisted shards."""
import collections
import time

import pytest
from pyspark.sql import functions as F

from keyspan.operators.transfer import export_chunked
from keyspan.plans.checksums import AlreadyRunning, ChecksumAudit
from keyspan.plans.jobs import JobError, schema_change
from keyspan.session import scratch_path
from keyspan.sources.files import exists, names_in
from keyspan.spec import TableSpec

COLS = ["k", "v"]


def copies(spark, change=()):
    rows = [(i, f"v{i}") for i in range(100)] + [(None, "none"), (-5, "below"), (500, "above"), (7, "v7")]
    other = [(k, "changed" if k in change else v) for k, v in rows]
    return spark.createDataFrame(rows, "k long, v string"), spark.createDataFrame(other, "k long, v string")


def audit(spark, root, **kw):
    return ChecksumAudit(spark, root, "k", 0, 99, 20, COLS, batch_chunks=4, **kw)


class Dies(BaseException):
    pass


def after(n):
    seen = []

    def call(batch):
        seen.append(batch)
        if len(seen) == n:
            raise Dies
    return call


def test_resumes_and_keeps_what_differs(spark):
    a, b = copies(spark, change=(3, 77, None, 500))
    root = scratch_path(spark, "t-audit")
    one = audit(spark, root)
    with pytest.raises(Dies):
        one.run(a, b, after(2))
    assert one.open_batches() == ["b00000002", "b00000003", "b00000004", "outside"]
    # batches that are done are not read again: what changes there is not seen, what changes elsewhere is
    _, c = copies(spark, change=(3, 25, 77, 90, None, 500))
    two = audit(spark, root)
    got = two.run(a, c)
    assert (got.clean, got.resumed, got.batches) == (False, True, 4)
    assert {(r.chunk_min, r.chunk_max) for r in got.differing.collect()} == {(0, 4), (75, 79), (90, 94), (None, None), (100, None)}
    by_run = collections.Counter(r.run for r in two.results().collect())
    assert by_run == {one.run_id: 8, two.run_id: 12 + 3}
    assert exists(spark, f"{root}/results")                     # kept for review
    again = audit(spark, root).run(a, b)
    assert (again.clean, again.batches) == (False, 0)


def test_clean_results_go(spark):
    a, b = copies(spark)
    root = scratch_path(spark, "t-clean")
    with pytest.raises(Dies):
        audit(spark, root).run(a, b, after(1))
    got = audit(spark, root).run(a, b)
    assert (got.clean, got.resumed, got.batches, got.differing.count()) == (True, True, 5, 0)
    assert not exists(spark, root)


def test_one_run_at_a_time(spark):
    a, b = copies(spark)
    root = scratch_path(spark, "t-lease")

    def second(batch):
        with pytest.raises(AlreadyRunning):
            audit(spark, root).run(a, b)
        raise Dies

    with pytest.raises(Dies):
        audit(spark, root).run(a, b, second)
    assert names_in(spark, f"{root}/runs") == []                # a run that ends takes back its sign
    dead = audit(spark, root)
    dead._beat()                                                # killed: its sign stays
    with pytest.raises(AlreadyRunning):
        audit(spark, root).run(a, b)
    time.sleep(0.05)
    assert audit(spark, root, lease_s=0.01).run(a, b).clean
    with pytest.raises(Dies):
        audit(spark, root).run(a, b, after(1))
    with pytest.raises(JobError, match="other parameters"):
        ChecksumAudit(spark, root, "k", 0, 99, 10, COLS, batch_chunks=4).run(a, b)


@pytest.mark.parametrize("fmt", ["parquet", "tsv"])
def test_export_keeps_rows_without_or_with_repeated_keys(spark, fmt):
    rows = [(1, 5, 5, "a"), (None, 5, 15, "b"), (None, 5, 15, "c"), (2, 25, None, "d"), (2, 25, None, "d"), (3, None, None, "e"),
            (4, 12, 17, "line\nend\tand tab")]
    df = spark.createDataFrame(rows, "id long, k1 long, k2 long, v string")
    spec = TableSpec("t", keys=("k1", "k2"), pk=("id",), chunks=3)
    chunks = spark.createDataFrame([(0, 9, "f0"), (10, 19, "f1"), (20, 29, "f2")], "chunk_min long, chunk_max long, file_name string")
    out = scratch_path(spark, "t-export")
    got = {r.file_name: r.rows for r in export_chunked(df, spec, chunks, out, fmt).collect()}
    assert got == {"f0": 3, "f1": 3, "f2": 2}                   # a row without any key is in no chunk
    if fmt == "parquet":
        back = spark.read.parquet(out).select("id", "k1", "k2", "v").distinct().collect()
        assert len(back) == 5


def test_schema_change_reports_every_shard(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "shard string, v int")
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "n string")
    out = scratch_path(spark, "t-alter")
    got = schema_change(df, lambda d: d.where("shard is null or shard <> 'c'"), out, preflight="a", shards=names).collect()
    assert {(r.shard, r.phase, r.rows_before, r.rows_after, r.ok) for r in got} == {
        ("a", "preflight", 1, 1, True), ("b", "rest", 1, 1, True), ("c", "rest", 1, 0, False), (None, "rest", 1, 1, True),
        ("z", "rest", 0, 0, True)}
    with pytest.raises(JobError, match="not empty"):
        schema_change(df, lambda d: d.withColumn("n", F.lit(1)), out)


def test_capacity_plan_takes_a_snapshot_first(spark):
    from keyspan.operators.capacity import history_from_events
    from keyspan.plans.jobs import capacity_plan
    h = history_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    path = scratch_path(spark, "t-plan")
    now = 1706659200
    top = h.groupBy("pool").agg(F.max("id").alias("id"), F.max("used").alias("used"), F.max("total").alias("total"))
    new = top.select("pool", F.lit(now).cast("long").alias("ts"), (F.col("id") + 10 ** 9).alias("id"), "total",
                     (F.col("used") + 1).alias("used"), (F.col("total") - F.col("used") - 1).alias("available"), F.col("used").alias("db_sizes"))
    out = capacity_plan(h, now, snapshot=new.select(*h.columns), history_path=path)
    assert spark.read.parquet(path).count() == h.count() + 5
    assert {r.pool: r.used for r in out["thresholds"].select("pool", "used").collect()} == {r.pool: r.used + 1 for r in top.collect()} \
        if "used" in out["thresholds"].columns else out["thresholds"].count() == 5
    ends = {r.e for r in out["segments"].groupBy("pool").agg(F.max("seg_end").alias("e")).collect()}
    assert ends == {now}
    again = capacity_plan(h, now, snapshot=new.withColumn("ts", F.lit(now + 5).cast("long")).select(*h.columns), history_path=path)
    assert spark.read.parquet(path).count() == h.count() + 10 and again["growth"].count() == 5


def test_steps_are_known_and_aborts_stop_them(spark):
    from keyspan.plans.hooks import Abort, Hooks, JobAborted, STEPS, step
    df = spark.range(3)
    with pytest.raises(ValueError):
        step(Hooks(), "no_such_step", lambda d: d, df)
    hooks = Hooks()

    @hooks.before("count_rows")
    def stop(d):
        raise Abort

    with pytest.raises(JobAborted):
        step(hooks, "count_rows", lambda d: 1 / 0, df)
    assert {"merge_write", "rebuild_write", "alter_shards", "cutover_map", "cleanup_prune"} <= set(STEPS)
