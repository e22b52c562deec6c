"""Scalar/text functions, streaming merge and monitors, driver contract."""

import pytest
from pyspark.sql import functions as F

from keyspan.functions import (deep_merge, hit_rate, logfile_number, parse_vertical, position_ahead,
                               status_sections, version_cmp)
from keyspan.session import scratch_path
from tests.conftest import SF001


def test_parse_vertical_rules(spark):
    text = "*** 1. row ***\n  Name : Foo \nempty:\nblank: \nurl: http://x\nnocolon\nName: Bar"
    df = spark.createDataFrame([(text,)], "t string")
    m = df.select(parse_vertical(F.col("t")).alias("m")).first()["m"]
    # later duplicate wins, trailing-empty pieces vanish, only piece 2 is kept
    assert m == {"name": "Bar", "blank": "", "url": "http"}


def test_versions_and_positions(spark):
    df = spark.createDataFrame([("5.5.27-rel28.1-log", "5.6.10", "mysql-bin.000012", 5,
                                 "mysql-bin.000009", 900)],
                               "a string, b string, fa string, pa long, fb string, pb long")
    r = df.select(version_cmp(F.col("a"), F.col("b"), 2).alias("c2"),
                  version_cmp(F.col("a"), F.col("a"), 3).alias("c3"),
                  logfile_number(F.col("fa")).alias("n"),
                  position_ahead(F.col("fa"), F.col("pa"), F.col("fb"), F.col("pb")).alias("ahead")).first()
    assert (r.c2, r.c3, r.n, r.ahead) == (-1, 0, 12, True)
    with pytest.raises(ValueError):
        version_cmp(F.col("a"), F.col("b"), 4)


def test_status_sections_and_hit_rate(spark):
    text = ("-----\nBUFFER POOL AND MEMORY\n-----\nTotal memory 10\nBuffer pool hit rate 990 / 1000\n"
            "-----\nROW OPERATIONS\n-----\n0 queries inside\n-----\nROW OPERATIONS\n-----\n2 queries\n"
            "-----\nEND OF STATUS\n-----\nno header follows\n")
    df = spark.createDataFrame([(text,)], "t string")
    m = df.select(status_sections(F.col("t")).alias("m")).first()["m"]
    assert set(m) == {"BUFFER POOL AND MEMORY", "ROW OPERATIONS"} and m["ROW OPERATIONS"] == ["2 queries"]
    line = [x for x in m["BUFFER POOL AND MEMORY"] if x.startswith("Buffer pool hit rate")][0]
    rate = spark.createDataFrame([(line,)], "l string").select(hit_rate(F.col("l"))).first()[0]
    assert rate == 99.0


def test_deep_merge(spark):
    df = spark.sql("SELECT map('a', array('1'), 'b', array('2')) AS o, map('b', array('3'), 'c', array('4')) AS n")
    r = df.select(deep_merge(F.col("o"), F.col("n")).alias("x"),
                  deep_merge(F.col("o"), F.col("n"), True).alias("y")).first()
    assert r.x == {"a": ["1"], "b": ["3"], "c": ["4"]}
    assert r.y == {"a": ["1"], "b": ["2", "3"], "c": ["4"]}
    nested = spark.sql("SELECT map('x', map('a', array(1), 'b', array(2)), 'y', map('k', array(9))) AS o, "
                       "map('x', map('b', array(3)), 'z', map('c', array(4))) AS n")
    r = nested.select(deep_merge(F.col("o"), F.col("n"), levels=2).alias("x"),
                      deep_merge(F.col("o"), F.col("n"), True, 2).alias("y")).first()
    assert r.x == {"x": {"a": [1], "b": [3]}, "y": {"k": [9]}, "z": {"c": [4]}}
    assert r.y["x"]["b"] == [2, 3]


def test_stream_merge_sources(spark):
    from keyspan.streaming.merge import DuplicateSource, StreamMerger, UnknownSource, write_change_sources
    e = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    root = scratch_path(spark, "t-streams")
    srcs = write_change_sources(e, F.col("user_id") % 3, f"{root}/in", "event_id")
    m = StreamMerger(spark, e.schema, ["event_id"], "event_id", f"{root}/out")
    for n, p in srcs.items():
        m.add_source(n, p)
    with pytest.raises(DuplicateSource):
        m.add_source("0", srcs["0"])
    with pytest.raises(UnknownSource):
        m.pause("nope")
    m.pause("2")
    m.run_available_now()
    assert m.merged().count() == e.filter(F.col("user_id") % 3 != 2).count()
    m.resume("2")
    m.run_available_now()                        # resumes from its own checkpoint
    assert m.merged().count() == e.count()
    m.run_available_now()                        # nothing new: exactly once
    assert m.changes().count() == e.count()
    prog = {r.source: r.rows for r in m.progress().collect()}
    assert sum(prog.values()) == e.count()


def test_command_counters_and_caught_up(spark):
    from keyspan.streaming.monitor import caught_up_stream, command_counters
    e = spark.read.parquet(f"{SF001}/events.parquet")
    kinds = e.withColumn("cmd", F.when(F.col("event_type") == "view", "SELECT")
                         .when(F.col("event_type") == "purchase", "INSERT").otherwise("DELETE"))
    root = scratch_path(spark, "t-mon")
    kinds.write.parquet(f"{root}/in")
    s = spark.readStream.schema(kinds.schema).parquet(f"{root}/in")
    q = (command_counters(s, "ts", "user_id", "cmd").writeStream.format("memory").queryName("all_windows")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT sum(com_select) s, sum(com_insert) i, sum(com_delete) d FROM all_windows").first()
    assert tuple(got) == tuple(kinds.filter(f"cmd = '{c}'").count() for c in ("SELECT", "INSERT", "DELETE"))
    q = (command_counters(s, "ts", "user_id", "cmd", watermark="10 seconds").writeStream.format("memory").queryName("cc")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT sum(com_select) s, sum(com_insert) i, sum(com_delete) d FROM cc").first()
    # windows still open at the end of the run are not emitted in append mode
    assert got.s <= kinds.filter("cmd = 'SELECT'").count()
    polls = spark.createDataFrame([("n1", i, lag) for i, lag in enumerate([0.0, 1.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 0.0])] +
                                  [("n2", i, lag) for i, lag in enumerate([None, 0.0, 0.0])],
                                  "node string, seq long, lag double")
    polls.write.parquet(f"{root}/polls")
    ps = spark.readStream.schema(polls.schema).parquet(f"{root}/polls")
    q = (caught_up_stream(ps, "node", "seq", "lag", timeout_s=None).writeStream.format("memory")
         .queryName("cu").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.node, r.status): (r.polls, r.at_seq) for r in spark.sql("SELECT * FROM cu").collect()}
    assert got[("n1", "caught_up")] == (8, 7)
    assert got[("n2", "broken")] == (1, 0)


def test_driver_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50


def test_dates_and_redelivery(spark):
    from keyspan.functions import epoch_day, epoch_report_time
    r = spark.createDataFrame([(1706659200,)], "t long").select(epoch_day(F.col("t")).alias("d"),
                                                                  epoch_report_time(F.col("t")).alias("s")).first()
    assert (r.d, r.s) == ("2024-01-31", "01/31/2024 00:00:00")
    from keyspan.streaming.monitor import dedup_redelivery
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:09")],
                                 "k long, ts string").withColumn("ts", F.to_timestamp("ts"))
    root = scratch_path(spark, "t-dedup")
    rows.write.parquet(root + "/in")
    s = spark.readStream.schema(rows.schema).parquet(root + "/in")
    q = dedup_redelivery(s, ["k"], "ts").writeStream.format("memory").queryName("dd") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM dd").first()[0] == 2


def test_capacity_plan_job(spark):
    from keyspan.operators.capacity import history_from_events
    from keyspan.plans.jobs import capacity_plan
    h = history_from_events(spark.read.parquet(f"{SF001}/events.parquet"))
    out = capacity_plan(h, 1706659200)
    assert {"segments", "growth", "days_left", "day_over_day", "outlier_runs", "outlier_spikes"} <= set(out)
    assert out["growth"].count() == 5
