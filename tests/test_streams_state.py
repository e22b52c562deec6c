"""I3 in any order, I5 running totals, I6 as a stream, I8 over several roots."""
import random

import pytest

from keyspan.session import scratch_path
from keyspan.streaming.merge import furthest_replicas, replica_roots, stream_backfill
from keyspan.streaming.monitor import caught_up_stream, cumulative_counters


def detect(polls, needed=3):
    """The rule, poll by poll: (status, polls, at_seq)."""
    out, zeros = [], 0
    for i, (seq, lag) in enumerate(polls, 1):
        if lag is None:
            out.append(("broken", i, seq))
        elif lag == 0:
            zeros += 1
            if zeros >= needed:
                return out + [("caught_up", i, seq)]
        else:
            zeros = 0
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_detector_does_not_depend_on_arrival(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{k}": [(100 * k + 7 * i, rng.choice([0.0, 0.0, 1.0, 2.5, None])) for i in range(rng.randint(0, 40))] for k in range(6)}
    rows = [(n, i, seq, lag) for n, polls in nodes.items() for i, (seq, lag) in enumerate(polls)]
    rows += rng.sample(rows, 20)                               # polls that come twice
    rng.shuffle(rows)
    root = scratch_path(spark, "t-order")
    kind = "node string, no long, seq long, lag double"
    for i in range(0, len(rows), 17):
        spark.createDataFrame(rows[i:i + 17], kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    (caught_up_stream(s, "node", "seq", "lag", timeout_s=None, number="no").writeStream.format("parquet")
     .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination())
    got = {}
    for r in spark.read.schema("node string, status string, polls long, at_seq long").parquet(f"{root}/out").collect():
        got.setdefault(r.node, []).append((r.status, r.polls, r.at_seq))
    want = {n: detect(p) for n, p in nodes.items() if detect(p)}
    assert {n: sorted(x, key=lambda e: (e[1], e[0])) for n, x in got.items()} == {n: sorted(x, key=lambda e: (e[1], e[0])) for n, x in want.items()}


def test_detector_holds_a_chunk_at_most(spark, monkeypatch):
    """Polls of a node are put in order by chunks, whatever the order they come in; no state holds more of them."""
    import pandas as pd

    from keyspan.streaming import monitor

    class State:
        exists, get = False, None
        def update(self, v):
            self.exists, self.get = True, v

    fn, state = monitor._chunk_fn(3, 10, 4), State()
    polls = lambda *no: iter([pd.DataFrame({"number": no, "seq": [100 + n for n in no], "kind": [0] * len(no)})])
    rows = lambda *no: [tuple(r)[1:4] for f in fn(("n", 2), polls(*no), state) for r in f.itertuples(index=False)]
    assert rows(21, 20, 21) == [] and state.get == (0, [2, 3], [120, 121], [0, 0])
    assert rows(18) == [(18, 1, [0])] and rows(19, 18) == [(19, 3, [0, 1, 2])]
    assert state.get == (4, [], [], []) and rows(18, 19, 20, 21) == []

    monkeypatch.setattr(monitor, "CHUNK", 4)
    rng = random.Random(7)
    nodes = {f"n{k}": [(100 * k + 7 * i, rng.choice([0.0, 0.0, 1.0, -2.5, None, float("nan")])) for i in range(5 * k + 3)]
             for k in range(8)} | {None: [(7, 0.0)] * 3, "never": [(i, 1.0) for i in range(9)]}
    rows = [(n, i + 1, seq, lag) for n, polls in nodes.items() for i, (seq, lag) in enumerate(polls)]
    rows += rng.sample(rows, 20)
    rng.shuffle(rows)
    root, kind = scratch_path(spark, "t-chunks"), "node string, no long, seq long, lag double"
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i:i + 60], kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    (caught_up_stream(s, "node", "seq", "lag", timeout_s=None, number="no", first=1).writeStream.format("parquet")
     .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination())
    got = sorted(tuple(r) for r in spark.read.schema(monitor.CAUGHT_UP_OUT).parquet(f"{root}/out").na.fill("null", ["node"]).collect())
    clean = lambda polls: [(q, None if x is None or x != x else x) for q, x in polls]
    assert got == sorted((n or "null", *x) for n, p in nodes.items() for x in detect(clean(p)))


def test_lost_poll_is_given_up():
    """The timer of a gap: the poll that follows it is judged, later ones wait for theirs."""
    import pandas as pd

    from keyspan.streaming.monitor import _caught_up_fn

    class State:
        def __init__(self):
            self.value, self.hasTimedOut, self.wait = None, False, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)
        def update(self, v):
            self.value = v
        def remove(self):
            self.value = None
        def setTimeoutDuration(self, ms):
            self.wait = ms

    fn, state = _caught_up_fn(2, 9000, 1000, 0), State()
    polls = lambda *p: iter([pd.DataFrame(p, columns=["number", "seq", "lag"])])
    assert list(fn(("n",), polls((0, 10, 0.0), (2, 12, 0.0), (4, 14, 0.0)), state)) == []
    assert state.wait == 1000 and state.value[4] == [2, 4]
    state.hasTimedOut = True
    out = [tuple(r) for f in fn(("n",), iter([]), state) for r in f.itertuples(index=False)]
    assert out == [("n", "gap", 1, 12), ("n", "caught_up", 2, 12)]
    assert state.value[3] and state.value[4] == []


def test_running_totals_and_silent_stretches(spark):
    rows = [("a", 1, 2), ("a", 2, 1), ("a", 6, 4), ("a", 2, 5), ("b", 3, 0), (None, 1, 1), (None, 3, 1)]
    got = {tuple(r) for r in cumulative_counters(spark.createDataFrame(rows, "n string, s long, c long"), "n", "s", ["c"]).collect()}
    assert got == {("a", 1, 1, 2), ("a", 2, 2, 8), ("a", 3, 5, None), ("a", 6, 6, 12), ("b", 3, 3, 0), (None, 1, 1, 1),
                   (None, 2, 2, None), (None, 3, 3, 2)}


def test_backfill_goes_on_and_repeats_batches(spark):
    root = scratch_path(spark, "t-backfill")
    kind = "k long, seq long, v string"
    snap = spark.createDataFrame([(1, 5, "s1"), (2, 4, "s2"), (3, 1, "s3")], kind)
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    put([(1, 5, "s1"), (2, 6, "c6"), (2, 8, "c8"), (4, 7, "c7")])
    stream = spark.readStream.schema(kind).parquet(f"{root}/in")
    state = lambda df: {r.k: (r.seq, r.v) for r in df.collect()}
    first = state(stream_backfill(snap, stream, ["k"], "seq", 5, f"{root}/out"))
    assert first == {1: (5, "s1"), 2: (8, "c8"), 3: (1, "s3"), 4: (7, "c7")}
    put([(3, 9, "c9")])
    got = stream_backfill(snap, stream, ["k"], "seq", 5, f"{root}/out", keep="k <= 3")
    assert state(got) == {1: (5, "s1"), 2: (8, "c8"), 3: (9, "c9")}
    assert spark.read.parquet(f"{root}/out/applied").select("batch").distinct().count() == 2


def test_positions_count_within_one_root(spark):
    rows = [("p", "m", None, 9, 9), ("p", "r1", "m", 3, 5), ("p", "r2", "m", 3, 7), ("p", "deep", "r1", 9, 9), ("p", "lost", "m", None, 3),
            ("q", "m2", None, 1, 0), ("q", "s1", "m2", 1, 1), ("q", "other", "gone", 5, 5), ("r", "x", None, None, None)]
    df = spark.createDataFrame(rows, "pool string, node string, parent string, f long, p long")
    roots = {r.node: r.root for r in replica_roots(df, "node", "parent").collect()}
    assert roots == {"m": "m", "r1": "m", "r2": "m", "deep": "m", "lost": "m", "m2": "m2", "s1": "m2", "other": "gone", "x": "x"}
    got = {(r.pool, r.root): tuple(r)[2:] for r in furthest_replicas(df, "pool", "node", "parent", "f", "p").collect()}
    assert got == {("p", "m"): ("deep", 9, 9, 2, 2, 1, True), ("q", "m2"): ("s1", 1, 1, 1, 1, 0, False),
                   ("q", "gone"): ("other", 5, 5, 1, 0, 0, False), ("r", "x"): (None, None, None, 0, 0, 1, True)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "node long, parent long")
    assert {r.root for r in replica_roots(chain, "node", "parent").collect()} == {0}
    own = spark.createDataFrame([("x", "a"), ("a", "a")], "node string, parent string")
    assert {r.root for r in replica_roots(own, "node", "parent").collect()} == {"a"}
    for n in (2, 3, 4, 7):
        circle = [(i, (i + 1) % n) for i in range(n)] + [(100, 0)]
        with pytest.raises(ValueError):
            replica_roots(spark.createDataFrame(circle, "node long, parent long"), "node", "parent")
