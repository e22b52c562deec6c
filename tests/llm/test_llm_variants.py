"""Spelling variants against all pairs of words."""
import collections
import random
import re
import zlib

import edge
import pytest

from keyspan.llm import variants

SF = "/root/testdata/sf0.01"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(docs):
    out = collections.Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def edits(w, letters):
    """Every word one edit away, over the given letters."""
    cuts = range(len(w) + 1)
    return ({w[:i] + w[i + 1:] for i in cuts[:-1]} | {w[:i] + c + w[i:] for i in cuts for c in letters}
            | {w[:i] + c + w[i + 1:] for i in cuts[:-1] for c in letters}) - {w}


def brute(words):
    letters = set("".join(words))
    near = {w: edits(w, letters) & words.keys() for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def check(df):
    words = brute_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = variants.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(words)
    want = brute(words)
    assert {tuple(r) for r in got} == want
    return want


def test_real(spark):
    want = check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(w[1] is not None for w in want) > 10


@pytest.mark.parametrize("few", [0, 4])
def test_shared_chunks_are_cut_again(spark, monkeypatch, few):
    """Families of words with one chunk in common, chains of forms, and both chunks surviving."""
    monkeypatch.setattr(variants, "PAIRS_PER_WORD", few)
    rng = random.Random(few)
    words = collections.Counter()
    for base in ("overload", "prefixed", "señoritas", "abcabcabcabcab"):
        words[base] = 400
        for _ in range(60):
            w = rng.choice(sorted(edits(base, "abcéß")))
            words[w] += rng.choice((2, 3, 40, 41))
            w = rng.choice(sorted(edits(w, "xy")))
            words[w] += 2
    for i in range(300):
        words["overload"[:4] + "".join(rng.choices("abcdef", k=4))] += 2
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    want = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert any(w[2] not in (w[0], w[1]) for w in want)


def test_edges(spark):
    check(edge.docs(spark))
    assert variants.grouped(edge.empty(spark)).count() == 0
    long = "Ab" * 200
    rows = [(1, f"{long} {long} {long}x {long}x ÀÉÎõüÿß ÀÉÎõüÿß Àéîõüÿß àÉÎõüÿß×÷ 文字letters lettersĀletters", "x", 1),
            (None, "nullnull nullnull nullnulx", "y", 2), (2, None, None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, word string, n int"))
    huge = "ab" * 10_000
    rows = [(1, f"{huge} {huge} {huge}x {huge}x")]
    got = variants.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r.word), r.n, r.n_near) for r in got) == sorted(
        (len(w), n, 1) for w, n in brute_words(rows).items())
