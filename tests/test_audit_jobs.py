"""Audits, import modes, jobs and hooks; metamorphic properties."""

import pytest
from pyspark.sql import functions as F

from keyspan.operators.audit import (checksum_diff, duplicate_keys, duplicate_rows, manifest_diff,
                                     result_set_diff)
from keyspan.operators.counts import chunk_rowcounts, range_count
from keyspan.operators.transfer import import_rows, read_tsv, write_tsv
from keyspan.plans.hooks import Abort, Hooks
from keyspan.plans.jobs import JobError, merge, rebuild, split, split_cleanup
from keyspan.session import scratch_path
from keyspan.spec import CUSTS_MAP, LINEITEM, ORDERS, TableSpec, shard_map_from_rows
from tests.conftest import SF001


def test_duplicates(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(3,), (4,), (1,)], "k long")
    c = spark.createDataFrame([(3,), (9,)], "k long")
    got = {r.k: (r.n_rows, r.shards) for r in duplicate_keys({"a": a, "b": b, "c": c}, "k").collect()}
    assert got == {1: (2, "a,b"), 3: (3, "a,b,c")}  # includes the minimum key (exact)
    rows = duplicate_rows({"a": a, "b": b}, "k", ["k"]).count()
    assert rows == 4


def test_import_modes(spark):
    ex = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    inc = spark.createDataFrame([(2, "new"), (3, "new"), (3, "new")], "k long, v string")
    ign = {r.k: r.v for r in import_rows(ex, inc, ["k"], "ignore").collect()}
    rep = {r.k: r.v for r in import_rows(ex, inc, ["k"], "replace").collect()}
    assert ign == {1: "old", 2: "old", 3: "new"} and rep == {1: "old", 2: "new", 3: "new"}
    once = spark.createDataFrame([(3, "new")], "k long, v string")
    assert import_rows(ex, once, ["k"], None).count() == 3
    for clash in (inc, spark.createDataFrame([(9, "a"), (9, "b")], "k long, v string")):
        with pytest.raises(Exception, match="duplicate key"):
            import_rows(ex, clash, ["k"], None).collect()


def test_tsv_round_trip(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    o = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, None).otherwise(F.col("o_orderstatus")))
    p = scratch_path(spark, "tsv")
    write_tsv(o, p)
    back = read_tsv(spark, p, o.schema)
    assert result_set_diff(o, back).count() == 0


def test_checksum_diff_finds_changed_chunk(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    d = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 5, F.col("o_totalprice") + 1)
                     .otherwise(F.col("o_totalprice")))
    key = o.filter("o_orderkey = 5").first()["o_custkey"]
    hi = o.agg(F.max("o_custkey")).first()[0]
    bad = checksum_diff(o, d, "o_custkey", 0, hi, 50, o.columns).collect()
    assert len(bad) == 1 and bad[0].chunk_min <= key <= bad[0].chunk_max
    assert checksum_diff(o, o, "o_custkey", 0, hi, 50, o.columns).count() == 0


def test_chunk_counts_sum_and_multi_key_double_count(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    hi = o.agg(F.max("o_custkey")).first()[0]
    total = chunk_rowcounts(o, "o_custkey", 0, hi, 200).agg(F.sum("n")).first()[0]
    assert total == o.count()
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    r = range_count(li, LINEITEM, 0, 99).first()
    assert r.chunk_sum >= r.n


def test_split_merge_round_trip(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    m = shard_map_from_rows(spark, CUSTS_MAP)
    out = scratch_path(spark, "split")
    res = split(o, ORDERS, m, "custs-100-999", out, n=3)
    kids = [r.name for r in res.shard_map.filter("parent IS NOT NULL").collect()]
    assert len(kids) == 3
    written = spark.read.parquet(out)
    parts = {k: written.filter(F.col("shard") == k).drop("shard") for k in kids}
    merged_path = scratch_path(spark, "merge")
    report = merge(parts, ORDERS, merged_path).collect()
    assert all(r.valid for r in report)
    parent = o.filter(F.col("o_custkey").between(100, 999))
    back = spark.read.parquet(merged_path).select(*o.columns)
    assert result_set_diff(parent, back).count() == 0  # split then merge = identity
    with pytest.raises(JobError):  # overlapping shards refuse to merge
        merge({"x": parent, "y": parent}, ORDERS, scratch_path(spark, "bad"))


def test_cleanup_guard_and_prune(spark):
    rows = [("p", 0, 99, "deprecated"), ("p", 0, 49, "needs_cleanup", "p-0-99"),
            ("p", 50, 99, "needs_cleanup", "p-0-99")]
    m = shard_map_from_rows(spark, rows)
    data = spark.createDataFrame([(k,) for k in range(100)], "k long")
    spec = TableSpec("t", keys=("k",), pk=("k",))
    new_map, pruned = split_cleanup(m, "p-0-99", {"p-0-49": data, "p-50-99": data}, spec)
    assert pruned["p-0-49"].count() == 50 and pruned["p-50-99"].count() == 50
    st = {r.name: r.state for r in new_map.collect()}
    assert st == {"p-0-99": "recycle", "p-0-49": "ready", "p-50-99": "ready"}
    with pytest.raises(JobError):
        split_cleanup(new_map, "p-0-99", {}, spec)


def test_rebuild_counts(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    assert rebuild(li, LINEITEM, scratch_path(spark, "rb")).first()["match"]


def test_manifest_diff(spark):
    src = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "rel_path string, length long")
    tgt = spark.createDataFrame([("a", 1), ("b", 5), ("z", 9)], "rel_path string, length long")
    got = {r.rel_path: r.problem for r in manifest_diff(src, tgt).collect()}
    assert got == {"b": "size", "c": "missing"}


def test_hooks_order_and_abort(spark):
    h = Hooks()
    seen = []

    @h.before("step", priority=10)
    def low(df):
        seen.append("low")

    @h.before("step", priority=200)
    def high(df):
        seen.append("high")
        return df.withColumn("x", F.lit(1))

    df = spark.range(3)
    out = h.wrap("step", lambda d: d.filter("id > 0"), df)
    assert seen == ["high", "low"] and out.count() == 2 and "x" in out.columns

    @h.after("step")
    def stop(df):
        raise Abort()
    assert h.wrap("step", lambda d: d, df).count() == 3   # the finished step's result stands

    @h.before("other")
    def refuse(df):
        raise Abort()
    assert h.wrap("other", lambda d: d, df) is None
