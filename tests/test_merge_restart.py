"""The merger's state over restarts, ties and stops at one position."""
import pytest
from pyspark.sql import functions as F

from keyspan.session import scratch_path
from keyspan.streaming.manifest import KEPT_VERSIONS, Manifest, ManifestConflict, Source
from keyspan.streaming.merge import DuplicateSource, PositionsDiffer, StreamMerger, UnknownSource, write_change_sources

KIND = "id long, k long, v string"


def setup(spark, rows):
    """rows: (source, id, k, v)"""
    root = scratch_path(spark, "t-restart")
    df = spark.createDataFrame(rows, "src string, " + KIND)
    paths = write_change_sources(df, F.col("src"), f"{root}/in", "id")
    new = lambda: StreamMerger(spark, df.drop("src").schema, ["k"], "id", f"{root}/out")
    return new, paths


def state(m):
    return {r.k: (r.id, r.v, r.source) for r in m.merged().collect()}


def send(spark, path, rows):
    spark.createDataFrame(rows, KIND).write.mode("append").parquet(path)


def test_a_new_object_goes_on(spark):
    new, paths = setup(spark, [("a", 1, 1, "x"), ("a", 3, 2, "y"), ("b", 2, 1, "z"), ("c", 9, 3, "w")])
    m = new()
    for n, p in paths.items():
        m.add_source(n, p)
    m.pause("c")
    m.run_available_now()
    want = {1: (2, "z", "b"), 2: (3, "y", "a")}
    assert state(m) == state(new()) == want
    assert new().positions() == {"a": 3, "b": 2, "c": None}
    with pytest.raises(DuplicateSource):
        new().add_source("a", paths["a"])
    new().remove_source("b")
    with pytest.raises(UnknownSource):
        new().pause("b")
    new().run_available_now()                          # c is still paused
    assert state(new()) == want
    new().resume("c")
    send(spark, paths["a"], [(10, 1, "new")])
    send(spark, paths["b"], [(11, 1, "after removal")])
    new().run_available_now()
    assert state(new()) == {1: (10, "new", "a"), 2: (3, "y", "a"), 3: (9, "w", "c")}
    assert new().changes().count() == 5                # nothing twice, nothing of the removed source
    new().add_source("b", paths["b"])                  # goes on behind what it sent
    new().run_available_now()
    assert state(new())[1] == (11, "after removal", "b")
    assert new().positions() == {"a": 10, "b": 11, "c": 9}


def test_stop_point_survives_and_positions_are_equal(spark):
    new, paths = setup(spark, [(s, i, i % 4, s) for s in "ab" for i in range(1, 9)])
    for n, p in paths.items():
        new().add_source(n, p)
    new().pause("b")
    new().run_available_now(until_seq=5)
    assert new().stop_at == 5 and {i for i, *_ in state(new()).values()} == {2, 3, 4, 5}
    assert {s for *_, s in state(new()).values()} == {"a"}
    assert new().replay_together(until=6) == 6
    assert new().paused == {"a", "b"} and new().stop_at == 6
    assert state(new()) == {2: (6, "b", "b"), 3: (3, "b", "b"), 0: (4, "b", "b"), 1: (5, "b", "b")}
    # a change before the position that was not taken in
    send(spark, paths["a"], [(4, 7, "late")])
    assert new().behind(["a", "b"], 6) == {"a": 1}
    assert new().replay_together(["a", "b"]) == 8      # the furthest position committed
    assert new().behind(["a", "b"], 8) == {}
    with pytest.raises(UnknownSource):
        new().replay_together(["a", "nope"], 3)


def test_difference_is_raised(spark, monkeypatch):
    new, paths = setup(spark, [(s, i, i, s) for s in "ab" for i in range(4)])
    for n, p in paths.items():
        new().add_source(n, p)
    monkeypatch.setattr(StreamMerger, "run_available_now", lambda self, *a: None)
    with pytest.raises(PositionsDiffer, match="a.*4.*b.*4"):
        new().replay_together(until=3)
    assert new().paused == {"a", "b"}
    with pytest.raises(ValueError):
        new().replay_together()                        # nothing committed yet, no position named


def test_equal_sequences_do_not_depend_on_order(spark):
    """One sequence from two sources, and twice from one source with other values."""
    rows = [("p", 5, 1, "P"), ("q", 5, 1, "Q"), ("p", 7, 2, "one"), ("p", 7, 2, "two"), ("p", 8, 3, None), ("p", 8, 3, "v")]
    got = []
    for order in (rows, rows[::-1]):
        new, paths = setup(spark, order)
        for n in sorted(paths, reverse=order is rows):
            new().add_source(n, paths[n])
        new().run_available_now()
        got.append(state(new()))
    assert got[0] == got[1] and got[0][1] == (5, "Q", "q")


def test_manifest_versions(spark):
    root = scratch_path(spark, "t-manifest")
    one, two = Manifest.load(spark, root), Manifest.load(spark, root)
    one.sources["a"] = Source("/in/a")
    assert one.changed
    one.commit(spark, root)
    assert not one.changed
    two.sources["b"] = Source("/in/b")
    with pytest.raises(ManifestConflict):
        two.commit(spark, root)
    assert set(Manifest.load(spark, root).sources) == {"a"}
    import datetime
    at = datetime.datetime(2024, 1, 31, 12, 0, 0, 5)
    for i in range(KEPT_VERSIONS + 3):
        m = Manifest.load(spark, root)
        m.stop_at, m.sources["a"].position = i, at
        m.commit(spark, root)
    m = Manifest.load(spark, root)
    assert (m.version, m.stop_at, m.sources["a"].position) == (KEPT_VERSIONS + 4, KEPT_VERSIONS + 2, at)
    from keyspan.sources.files import names_in
    assert len(names_in(spark, f"{root}/manifest")) == KEPT_VERSIONS
