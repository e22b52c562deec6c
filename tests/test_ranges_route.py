"""Range generators, predicates, prune and routing (B*, C1, C2, A5)."""

import random

from pyspark.sql import functions as F

from keyspan.operators.ranges import (check_contiguous, chunk_ranges, even_split, export_file_name,
                                      key_range_predicate, range_check_predicate)
from keyspan.operators.rangejoin import range_join
from keyspan.operators.route import cutover, effective_map, merged_cover, route, shard_targets
from keyspan.operators.transfer import next_key_after, prune_to_range
from keyspan.spec import CUSTS_MAP, CUSTS_SPLIT_MAP, shard_map_from_rows


def test_chunks_floor_quirk(spark):
    # width = floor(10 / 3) = 3 -> four chunks, the last clipped
    got = [tuple(r) for r in chunk_ranges(spark, 1, 10, 3).orderBy("chunk_min").collect()]
    assert got == [(1, 3), (4, 6), (7, 9), (10, 10)]
    # min_per_chunk wins when the width would be 0
    got = [tuple(r) for r in chunk_ranges(spark, 0, 4, 10, min_per_chunk=2).orderBy("chunk_min").collect()]
    assert got == [(0, 1), (2, 3), (4, 4)]


def test_even_split(spark):
    df = spark.createDataFrame([(1, 10)], "min_id long, max_id long")
    got = [(r.piece_min, r.piece_max) for r in even_split(df, 3).orderBy("piece").collect()]
    assert got == [(1, 4), (5, 7), (8, 10)]


def test_check_contiguous(spark):
    ok = spark.createDataFrame([(0, 9), (10, 19)], "min_id long, max_id long")
    gap = spark.createDataFrame([(0, 9), (11, 19)], "min_id long, max_id long")
    assert check_contiguous(ok, 0, 19).first()["ok"]
    r = check_contiguous(gap, 0, 19).first()
    assert r["has_gaps"] and not r["ok"]


def test_predicates(spark):
    df = spark.createDataFrame([(1, 50), (60, 5), (70, 80), (None, 3)], "a long, b long")
    n = df.filter(key_range_predicate(["a", "b"], 0, 10)).count()
    assert n == 3  # (1,50) via a, (60,5) via b, (None,3) via b
    bad = df.filter(F.coalesce(range_check_predicate(F.col("a"), 0, 10), F.lit(False))).count()
    assert bad == 2


def test_prune_keeps_null_keys(spark):
    rows = [(1, 5, 5), (2, 50, 50), (3, 50, 5), (4, None, 50), (5, 50, None), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, k1 long, k2 long")
    kept = sorted(r.id for r in prune_to_range(df, ["k1", "k2"], 0, 10).collect())
    assert kept == [1, 3, 4, 5, 6]  # only id 2 has every key present and outside
    again = sorted(r.id for r in prune_to_range(prune_to_range(df, ["k1", "k2"], 0, 10),
                                                 ["k1", "k2"], 0, 10).collect())
    assert again == kept  # idempotent


def test_export_file_names(spark):
    df = spark.createDataFrame([(1, 5), (6, None), (None, 9), (None, None)], "lo long, hi long")
    got = [r[0] for r in df.select(export_file_name(F.lit("posts"), F.col("lo"), F.col("hi"))).collect()]
    assert got == ["posts1-5.out", "posts6-and-up.out", "postsstart-9.out", "posts-full.out"]


def test_next_key_after(spark):
    df = spark.createDataFrame([(k,) for k in (3, 7, 20)], "k long")
    assert next_key_after(df, "k", 7, "asc").first()[0] == 20
    assert next_key_after(df, "k", 7, "desc").first()[0] == 3
    assert next_key_after(df, "k", 20, "asc").first()[0] is None


def test_route_prefers_child_and_skips_unbuilt(spark):
    m = shard_map_from_rows(spark, CUSTS_SPLIT_MAP + [("custs", 0, 19, "initializing", "custs-0-39")])
    df = spark.createDataFrame([(5,), (120,), (700,), (5000,), (None,)], "k long")
    got = {r.k: r.shard for r in route(df, "k", m, "custs").collect()}
    assert got == {5: "custs-0-39", 120: "custs-100-549", 700: "custs-550-999",
                   5000: "custs-1000-infinity", None: None}


def test_route_matches_brute_force(spark):
    rnd = random.Random(7)
    rows, lo = [], 0
    for _ in range(30):
        hi = lo + rnd.randint(0, 50)
        rows.append(("p", lo, hi, "ready"))
        lo = hi + 1 + rnd.choice([0, 0, 3])  # occasional gaps
    rows.append(("p", lo, None, "ready"))
    m = shard_map_from_rows(spark, rows)
    keys = [rnd.randint(-5, lo + 100) for _ in range(400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.shard for r in route(df, "k", m).collect()}
    for k in keys:
        want = None
        for p, a, b, _ in rows:
            if a <= k and (b is None or k <= b):
                want = f"{p}-{a}-{'infinity' if b is None else b}"
                break
        assert got[k] == want, k


def test_range_join_left_keeps_unmatched(spark):
    r = spark.createDataFrame([(0, 9, "a"), (20, None, "b")], "min_id long, max_id long, tag string")
    df = spark.createDataFrame([(5,), (15,), (10 ** 12,)], "k long")
    got = {x.k: x.tag for x in range_join(df, "k", r, how="left").collect()}
    assert got == {5: "a", 15: None, 10 ** 12: "b"}


def test_cutover(spark):
    m = cutover(shard_map_from_rows(spark, CUSTS_MAP), 5000, "custs")
    got = {(r.name, r.state) for r in m.collect()}
    assert ("custs-1000-infinity", "recycle") in got
    assert ("custs-1000-4999", "ready") in got and ("custs-5000-infinity", "ready") in got
    import pytest
    with pytest.raises(Exception):
        cutover(shard_map_from_rows(spark, CUSTS_MAP), 10, "custs").collect()


def test_effective_map_disjoint(spark):
    eff = effective_map(shard_map_from_rows(spark, CUSTS_SPLIT_MAP)).orderBy("min_id").collect()
    assert [(r.name, r.min_id, r.max_id) for r in eff] == [
        ("custs-0-39", 0, 39), ("custs-40-99", 40, 99), ("custs-100-549", 100, 549),
        ("custs-550-999", 550, 999), ("custs-1000-infinity", 1000, None)]


def test_targets_and_merged_cover(spark):
    rows = [("p", 0, 99, "merging"), ("p", 100, 199, "merging"), ("p", 0, 199, "initialized"),
            ("p", 200, 299, "child", "p-0-199"), ("p", 300, 399, "read_only")]
    m = shard_map_from_rows(spark, rows)
    cover = {r.name: r.merged_name for r in merged_cover(m).collect()}
    assert cover == {"p-0-99": "p-0-199", "p-100-199": "p-0-199"}
    t = {r.name: (r.read_target, r.write_target) for r in shard_targets(m).collect()}
    assert t["p-0-99"] == ("p-0-199", "p-0-99")
    assert t["p-200-299"] == ("p-200-299", "p-0-199")
    assert t["p-300-399"] == ("p-300-399", None)


def test_state_transitions(spark):
    import pytest
    from keyspan.operators import transitions as tr
    from keyspan.operators.route import check_parents, select_shards
    rows = [("p", 0, 99, "ready"), ("p", 0, 49, "replicating", "p-0-99"), ("p", 50, 99, "replicating", "p-0-99"),
            ("p", 100, 199, "ready"), ("p", 200, 299, "ready"), ("p", 100, 299, "initialized")]
    m = shard_map_from_rows(spark, rows)
    assert [r.name for r in select_shards(m, "P", being_split=True).collect()] == ["p-0-99"]
    assert select_shards(m, in_prod=True).count() == 3
    assert check_parents(m).count() == 0
    m1 = tr.move_reads_to_children(m, "p-0-99")
    st = {r.name: r.state for r in m1.collect()}
    assert st["p-0-99"] == "deprecated" and st["p-0-49"] == "child"
    with pytest.raises(tr.TransitionError):
        tr.move_reads_to_children(m1, "p-0-99")          # children no longer replicating
    m2 = tr.move_writes_to_children(m1, "p-0-99")
    assert {r.state for r in m2.filter("parent = 'p-0-99'").collect()} == {"needs_cleanup"}
    shards = ["p-100-199", "p-200-299"]
    m3 = tr.merge_cleanup(tr.merge_writes(tr.merge_reads(m2, shards, "p-100-299"), shards, "p-100-299"),
                          shards, "p-100-299")
    st = {r.name: r.state for r in m3.collect()}
    assert st["p-100-299"] == "ready" and st["p-100-199"] == "recycle"
    with pytest.raises(tr.TransitionError):
        tr.merge_writes(m2, shards, "p-100-299")          # shards are not merging yet
    assert {r.state for r in tr.set_manual(m, "p-0-99", "read_only").filter("name = 'p-0-99'").collect()} \
        == {"read_only"}
