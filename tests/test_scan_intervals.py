"""Distributed scans and interval sets against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keyspan.operators import intervals as iv
from keyspan.operators.scan import grouped_lag, grouped_scan, next_at_or_after


def _data(spark, seed=5, n=600):
    rnd = random.Random(seed)
    # one hot group holding most rows, as the skew rule asks for
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b"]), i, rnd.randint(-50, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, o long, v long"), rows


def test_grouped_scan_matches_window(spark):
    df, _ = _data(spark)
    for fn in ("sum", "min", "max"):
        for back in (False, True):
            got = {(r.g, r.o): r.x for r in grouped_scan(df, ["g"], ["o"], "v", fn, "x", backward=back,
                                                         partitions=7).collect()}
            frame = (Window.currentRow, Window.unboundedFollowing) if back else \
                (Window.unboundedPreceding, Window.currentRow)
            w = Window.partitionBy("g").orderBy("o").rowsBetween(*frame)
            agg = {"sum": F.sum, "min": F.min, "max": F.max}[fn]
            want = {(r.g, r.o): r.x for r in df.withColumn("x", agg("v").over(w)).collect()}
            assert got == want, (fn, back)


def test_grouped_lag_matches_window(spark):
    df, _ = _data(spark, 9)
    got = {(r.g, r.o): r.p for r in grouped_lag(df, ["g"], ["o"], "v", "p", partitions=5).collect()}
    want = {(r.g, r.o): r.p for r in df.withColumn(
        "p", F.lag("v").over(Window.partitionBy("g").orderBy("o"))).collect()}
    assert got == want


def test_next_at_or_after(spark):
    pts = spark.createDataFrame([("a", t) for t in (1, 5, 9, 20)] + [("b", 3)], "g string, t long")
    q = spark.createDataFrame([("a", 0, 1), ("a", 5, 2), ("a", 6, 3), ("a", 21, 4), ("b", 4, 5)],
                              "g string, q long, k long")
    got = {r.k: r.nx for r in next_at_or_after(pts, q, ["g"], "t", "q", "k", "nx").collect()}
    assert got == {1: 1, 2: 5, 3: 9, 4: None, 5: None}


def _set_from(rows):
    s = {}
    for src, lo, hi in rows:
        s.setdefault(src, set()).update(range(lo, hi + 1))
    return s


def _runs(ids):
    out, ids = [], sorted(ids)
    for x in ids:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


def test_interval_difference_and_merge(spark):
    rnd = random.Random(3)
    a = [(s, lo, lo + rnd.randint(0, 6)) for s in ("u1", "u2") for lo in rnd.sample(range(200), 40)]
    b = [(s, lo, lo + rnd.randint(0, 6)) for s in ("u1", "u2") for lo in rnd.sample(range(200), 40)]
    A = spark.createDataFrame(a, "source string, lo long, hi long")
    B = spark.createDataFrame(b, "source string, lo long, hi long")
    sa, sb = _set_from(a), _set_from(b)
    got = sorted((r.source, r.lo, r.hi) for r in iv.interval_difference(A, B, ["source"]).collect())
    want = sorted((s, lo, hi) for s in sa for lo, hi in _runs(sa[s] - sb.get(s, set())))
    assert got == want
    got = sorted((r.source, r.lo, r.hi) for r in iv.merge_intervals(A, ["source"]).collect())
    want = sorted((s, lo, hi) for s in sa for lo, hi in _runs(sa[s]))
    assert got == want
    assert iv.is_subset(A, A, ["source"]).first()["subset"]


def test_parse_and_render(spark):
    df = spark.createDataFrame([("uuid1:1-5:7:9-12,uuid2:1-100",)], "s string")
    p = iv.parse_interval_sets(df, "s")
    assert sorted(tuple(r) for r in p.collect()) == [("uuid1", 1, 5), ("uuid1", 7, 7), ("uuid1", 9, 12),
                                                     ("uuid2", 1, 100)]
    r = {x.source: x.intervals for x in iv.render_interval_set(iv.merge_intervals(p, ["source"]), ["source"]).collect()}
    assert r == {"uuid1": "1-5:7:9-12", "uuid2": "1-100"}
    assert iv.pick_source(p, "uuid2").count() == 1


def test_hot_group_is_spread_over_partitions(spark):
    """One group holding 90 % of the rows must not land in one task."""
    from keyspan.operators.scan import range_chunks
    rows = [("hot" if i % 10 else "cold", i, 1) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    r = range_chunks(df, ["g", "o"], partitions=8)
    sizes = [x["n"] for x in r.filter("g = 'hot'").groupBy("__pid").count()
             .withColumnRenamed("count", "n").collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)


def test_range_join_shuffle_path_matches_broadcast(spark):
    from keyspan.operators.rangejoin import range_join
    rnd = random.Random(11)
    ranges = spark.createDataFrame([(i * 10, i * 10 + 9, i) for i in range(50)] + [(500, None, 99)],
                                   "min_id long, max_id long, tag long")
    df = spark.createDataFrame([(rnd.randint(-20, 900),) for _ in range(2000)] + [(3,)] * 500, "k long")
    a = sorted(tuple(r) for r in range_join(df, "k", ranges, how="left").collect())
    b = sorted(tuple(r) for r in range_join(df, "k", ranges, how="left", broadcast_max_rows=0).collect())
    assert a == b


@pytest.mark.parametrize("partitions,seed", [(1, 0), (3, 1), (9, 2), (30, 3)])
def test_interval_sweep_over_partitions(spark, partitions, seed):
    """Intervals open over one or many partition edges, repeated and nested ones, a NULL group."""
    rng = random.Random(seed)
    make = lambda n, far: [(rng.choice(["a", "b", None, "z"]), lo := rng.randint(0, 300), lo + rng.choice([0, 1, 3, far]))
                           for _ in range(n)]
    a, b = make(60, 120) + [("whole", 0, 5000)] + [("dots", 2 * i, 2 * i) for i in range(300)], make(40, 30) + [("whole", 100, 101)]

    def ids(rows):
        out = {}
        for g, lo, hi in rows:
            out.setdefault(g, set()).update(range(lo, hi + 1))
        return out

    def runs(sets):
        out = set()
        for g, s in sets.items():
            for x in s:
                if x - 1 not in s:
                    hi = x
                    while hi + 1 in s:
                        hi += 1
                    out.add((g, x, hi))
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        fa, fb = (spark.createDataFrame(x, "g string, lo long, hi long") for x in (a, b))
        got = [tuple(r) for r in iv.merge_intervals(fa, ["g"]).collect()]
        extra = [tuple(r) for r in iv.interval_difference(fa, fb, ["g"]).collect()]
        missing = {r.g: (r.missing, r.subset) for r in iv.subset_by(fa, fb, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sa, sb = ids(a), ids(b)
    left = {g: s - sb.get(g, set()) for g, s in sa.items()}
    assert len(got) == len(set(got)) and set(got) == runs(sa)
    assert len(extra) == len(set(extra)) and set(extra) == runs(left)
    assert missing == {g: (len(s), not s) for g, s in left.items()}
