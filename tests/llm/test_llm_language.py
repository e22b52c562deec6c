"""Language identification against byte-by-byte context trees, and held-out accuracy."""
import collections
import math
import random
import zlib

import edge
import numpy as np
import pytest

from keyspan.llm import ppm

SF = "/root/testdata/sf0.01"


def tree(texts):
    """context -> successor -> count, for contexts of 0 to 4 bytes."""
    out = collections.defaultdict(collections.Counter)
    for t in texts:
        t = ppm.START + t
        for i in range(4, len(t)):
            for k in range(5):
                out[t[i - k:i]][t[i]] += 1
    return out


def distribution(seen, context):
    """The probability of every byte after a context, by the method itself."""
    p, left, gone = [0.0] * 256, 1.0, set()
    for k in range(4, -1, -1):
        counts = seen.get(context[len(context) - k:])
        if not counts:
            continue
        new = {s: n for s, n in counts.items() if s not in gone}
        if not new:
            continue
        total = sum(new.values()) + len(new)
        for s, n in new.items():
            p[s] = left * n / total
        left *= len(new) / total
        gone |= set(new)
    for s in range(256):
        if s not in gone:
            p[s] = left / (256 - len(gone))
    return p


def brute_bits(seen, text):
    t = ppm.START + text
    return sum(-math.log2(distribution(seen, t[i - 4:i])[t[i]]) for i in range(4, len(t)))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def counts_of(by_language):
    out = []
    for k in range(5):
        table = {}
        for l, texts in enumerate(by_language):
            for t in texts:
                for g in ppm.keys(np.frombuffer(ppm.START + t, np.uint8).astype(np.int64), k).tolist():
                    table.setdefault(g, [0] * len(by_language))[l] += 1
        grams = sorted(table)
        out.append((np.array(grams), np.array([table[g] for g in grams])))
    return out


def test_code_lengths_are_exact(monkeypatch):
    rng = random.Random(3)
    texts = [["".join(rng.choices(letters, k=rng.randint(1, 60))).encode() for _ in range(20)]
             for letters in ("abcab ", "bcdeß", "xyzab")]
    trees = ppm.Trees(counts_of(texts))
    seen = [tree(t) for t in texts]
    new = [b"abcab cab", b"", b"zzz\xff\x00 q", "ßßß äöü".encode(), bytes(range(256)), texts[0][3], b"a"]
    want = np.array([[brute_bits(s, t) for s in seen] for t in new])
    assert np.allclose(trees.score(new), want)
    monkeypatch.setattr(ppm, "PIECE", 7)
    assert np.allclose(trees.score(new), want)
    for s in seen:
        for context in (b"abca", b"qqqq", b"\n\n\n\n", b" abc"):
            assert abs(sum(distribution(s, context)) - 1) < 1e-9


def test_predictions_match_brute_force(spark):
    rng = random.Random(5)
    letters = {"en": "etaoin shr", "de": "enisr atdhuß", "é": "ésaitn rul"}
    rows = []
    for i in range(160):
        lang = rng.choice(list(letters))
        rows.append((i, "".join(rng.choices(letters[lang], k=rng.randint(1, 120))), lang if i % 9 else None))
    got = {r.doc_id: r for r in ppm.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    names = sorted(letters)
    seen = {l: tree([t.encode() for i, t, x in rows if x == l and not held(i)]) for l in names}
    for i, text, _ in rows:
        assert got[i].held_out == held(i)
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        bits = {l: brute_bits(seen[l], text.encode()) for l in names}
        best = min(bits.values())
        assert bits[got[i].lang_pred] == pytest.approx(best) == pytest.approx(got[i].bits)
        assert got[i].score == pytest.approx(1 / sum(2 ** (best - b) for b in bits.values()))


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, f"text number {i} " * 5, "ab"[i % 2]) for i in range(400)] + [(1, "text number 1 " * 5, "b")] * 300
    names, trees = ppm.trained(spark.createDataFrame(rows, "id long, text string, lang string"), 4000)
    assert names == ["a", "b"]
    n = np.exp2(trees.logn[0]).sum(0)
    assert (n <= 2000).all() and (n > 1500).all()
    _, all_of = ppm.trained(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert np.allclose(np.exp2(all_of.logn[0]).sum(0), [sum(len(t) for _, t, l in set(rows) if l == x) for x in "ab"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = ppm.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_edges(spark):
    docs = edge.docs(spark)
    got = ppm.identified(docs).collect()
    assert len(got) == docs.count()
    text = collections.defaultdict(set)
    for r in docs.collect():
        text[r.doc_id].add(r.text)
    for r in got:
        assert 0 <= r.score <= 1
        if all(t is None or not any(map(str.isalpha, t)) for t in text[r.doc_id]):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0, None)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de")
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
    assert ppm.identified(edge.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in ppm.identified(nothing).collect()} == {(1, "und"), (2, "und")}
