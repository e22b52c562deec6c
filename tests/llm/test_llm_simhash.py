"""SimHash near-duplicates against brute force."""
import collections
import random

import edge
import numpy as np
import pytest

from keyspan.llm import simhash
from keyspan.llm.components import components

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    import xxhash
    words, w = [], ""
    for ch in (text or ""):
        if ch in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += ch.lower() if "A" <= ch <= "Z" else ch
    words += [w] if w else []
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(id, fingerprint) rows -> component ids by comparing all fingerprints."""
    fps = sorted({f for _, f in rows})
    a = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    at = {f: root(i) for i, f in enumerate(fps)}
    least = {}
    for d, f in rows:
        if d is not None:
            least[at[f]] = min(d, least.get(at[f], d))
    return [(d, f, least.get(at[f])) for d, f in rows]


def check(df):
    got = collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect())
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    assert got == collections.Counter(brute_components(rows))


def test_edges(spark):
    check(edge.docs(spark))
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    assert simhash.deduplicated(edge.empty(spark)).count() == 0


def test_real(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_anchors_cover():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 500)
    h = simhash.home(half)
    assert (simhash._syndromes(h) == 0).all()
    assert (np.bitwise_count(half ^ h) <= 1).all()
    rows, anchor = simhash.replicas(half)
    assert (simhash._syndromes(anchor) == 0).all()
    assert (np.bitwise_count(half[rows] ^ anchor) <= 2).all()
    assert len(set(zip(rows.tolist(), anchor.tolist()))) == len(rows)
    every = {(i, a) for i in range(500) for b in range(-1, 32)
             for a in [int(simhash.home(np.array([half[i] ^ (1 << b if b >= 0 else 0)]))[0])]}
    assert every <= set(zip(rows.tolist(), anchor.tolist()))


@pytest.mark.parametrize("hot", [simhash.HOT_HOMES, 3])
def test_every_link_is_found(spark, monkeypatch, hot):
    """Chains and dense balls of fingerprints, also when anchors are split."""
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    monkeypatch.setattr(simhash, "HOT_ANCHORS", 10 ** 9)
    rng = random.Random(hot)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 12)):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << b ^ 1 << c for b in range(0, 64, 3) for c in range(64)}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in components(found).collect()}
    want = brute_components([(int(np.uint64(f).astype(np.int64)), f) for f in sorted(fps)])
    assert {i: c for i, _, c in want} == {i: min(k for k, _, d in want if d == c) for i, _, c in want}
    got = collections.defaultdict(set)
    for (fp,) in signed:
        got[roots.get(fp, fp)].add(fp)
    mine = collections.defaultdict(set)
    for i, _, c in want:
        mine[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1800)] + [(5000, 5000)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1800)}


def test_deduplicated_keeps_one_of_each(spark):
    df = edge.docs(spark)
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    want = {c for _, _, c in brute_components(rows) if c is not None}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1          # the text without an id stays
    nulls = spark.createDataFrame([(None, "some words that stay"), (None, "some words that stay"), (None, "others here now")],
                                  "doc_id long, text string")
    assert sorted(r.text for r in simhash.deduplicated(nulls).collect()) == ["others here now", "some words that stay"]


def test_deduplicated_keeps_every_text_of_a_repeated_id(spark):
    texts = ["one text about the first thing of all", "some other words that stand for themselves here",
             "a third document with its very own sentence"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (2, texts[2]), (3, texts[2])]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, texts[0]), (1, texts[1]), (2, texts[2])]


def test_deduplicated_names(spark):
    clash = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, sh_row string")
    with pytest.raises(ValueError):
        simhash.deduplicated(clash)


def test_deduplicated_reads_texts_in_python_once(spark):
    """The plan that returns the rows has no Python in it: fingerprints are stored."""
    out = simhash.deduplicated(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "simhash" not in plan.replace("simhash-", "")
