"""Ranked search against a full evaluation."""
import collections
import math
import random
import re

import edge
import numpy as np

from keyspan.llm import nra

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    """Every score of every document, from the formula."""
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in found for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = {}
    for item, want in wanted.items():
        rows = []
        for (doc, c), size in zip(found, sizes):
            m = 100 - 50 + (50 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in want if t in c)
            if s > 0:
                rows.append((-s, doc is None, doc))
        if rows:
            out[item] = [(r, d, -s) for r, (s, _, d) in enumerate(sorted(rows)[:k], 1)]
    return out


def got(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[0]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(rows) for i, rows in out.items()}


def pairs(df, i, t):
    return [(r[i], r[t]) for r in df.select(i, t).collect()]


def test_real(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert got(nra.search(docs, items)) == brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_small_chunks_blocks_and_k(spark, monkeypatch):
    """Floors of earlier chunks, several blocks of items and ties over the edge change nothing."""
    monkeypatch.setattr(nra, "CHUNK_POSTINGS", 40)
    monkeypatch.setattr(nra, "BLOCK_PAIRS", 5)
    monkeypatch.setattr(nra, "FIRST_DEPTH", 1)
    monkeypatch.setattr(nra, "PARTS", 1)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, range(30, 0, -1), k=rng.randint(1, 40))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 - i, texts[0]) for i in range(60)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12)))) for i in range(12)] + [(99, texts[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for k in (1, 7, 50):
        assert got(nra.search(frame, spark.createDataFrame(items, "item_id long, text string"), k)) == brute(docs, items, k)


def test_edges(spark):
    docs = edge.docs(spark)
    items = spark.createDataFrame(
        [("a", "The FOX, the lazy-dog!", 1), ("a", "fox word7", 1), (None, "one line", 2), ("b", None, 1), ("c", "", 1),
         ("d", "文字 Ünï nowhere", 3), ("e", "absentterm", 4), ("f", edge.LONG, 1)], "item_id string, text string, rank int")
    want = brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert got(nra.search(docs, items)) == want
    assert set(want) == {"a", None, "d", "f"}
    assert nra.search(edge.empty(spark), items).count() == 0
    assert nra.search(docs, items.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert nra.search(nothing, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert nra.search(nothing, items).count() == 0


def test_reads_stop_early():
    """The bounds end the reading before the lists are read out, and lists are read in order."""
    class Watched(np.ndarray):
        deepest = 0

        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop is not None:
                Watched.deepest = max(Watched.deepest, key.stop)
            return super().__getitem__(key)

    n = 100_000
    impacts = np.sort(np.random.default_rng(1).integers(1, 1000, n))[::-1].astype(np.int64)
    impacts[:50] += 10 ** 6
    same = np.arange(n).view(Watched)
    found, score = nra.read_lists([(same, impacts), (same, impacts)], n, 50, 0)
    assert sorted(found.tolist()) == list(range(50)) and (np.sort(score)[::-1] == np.sort(2 * impacts[:50])[::-1]).all()
    assert 0 < Watched.deepest < n // 100
