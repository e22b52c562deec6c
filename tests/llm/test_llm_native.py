"""Mixing, sharding and rules against brute force."""
import collections
import hashlib
import re
import zlib

import edge
import pytest
from keyspan.llm import kdshard, mixing, rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- mixing -----------------------------------------------------------------

def brute_mix(rows):
    """rows of (doc_id, source, size) -> list of (row, target, copies), by sorting hashes."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    out = []
    for s in sources:
        whole = int(target[s] // size[s]) if size[s] else 0
        budget = target[s] - whole * size[s]
        groups = collections.defaultdict(list)
        for r in rows:
            if r[1] == s:
                key = f"{'null' if r[0] is None else r[0]}:{r[2]}"
                groups[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) >> 30].append(r)
        done, closed = 0, False
        for h in sorted(groups):
            n = sum(r[2] for r in groups[h])
            more = not closed and (done + n <= budget or n - (budget - done) < budget - done)
            closed = closed or done + n > budget
            done += n
            out += [(r, target[s], min(2, whole + more)) for r in groups[h]]
    return out


def check_mix(df):
    got = collections.Counter(
        ((r.doc_id, r.source, r.size), round(r.target, 4), r.copies * r.size) for r in mixing.mix(df).collect())
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.collect()]
    want = collections.Counter((r, round(t, 4), c * r[2]) for r, t, c in brute_mix(rows))
    assert got == want


def test_mix_edges(spark):
    check_mix(edge.docs(spark))
    assert mixing.mix(edge.empty(spark)).count() == 0


def test_mix_real(spark):
    check_mix(table(spark, "documents"))


def test_mix_hot_source_near_target(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 40 as int)) as text",
                                      "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    got = mixing.mix(df).groupBy("source").agg({"target": "max", "source_size": "max"}).collect()
    taken = {r.source: r.n for r in mixing.mix(df).selectExpr("source", "size * copies as n").groupBy("source")
             .agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    for r in got:
        assert abs(taken[r["source"]] - r["max(target)"]) <= 40


def test_mixed_documents_repeat_rows(spark):
    df = edge.docs(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = collections.Counter((r.doc_id, r.source) for r in out.collect())
    assert got == +want


def test_mix_without_ids(spark):
    """Texts tell documents without an id apart, so their source comes near its target."""
    df = spark.range(2100).selectExpr("if(id % 3 = 0, null, id) as doc_id", "concat('a b c d e f w', id) as text",
                                      "if(id % 3 = 0, 'nameless', 's') as source")
    rows = mixing.mix(df).where("source = 'nameless'").collect()
    assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) <= 70


# ---- sharding ---------------------------------------------------------------

def check_shards(df, shards, slack):
    rows = kdshard.shard(df, shards).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
                               for r in df.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    per = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        per[r.shard].append(r)
    for got in per.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    sizes = [sum(r.size for r in per.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= slack
    return rows


def test_shards_real(spark):
    df = table(spark, "documents")
    longest = max(len((r.text or "").encode()) for r in df.collect())
    check_shards(df, 24, 2 * longest)


def test_shards_edges(spark):
    check_shards(edge.docs(spark), 4, 10 ** 9)
    assert kdshard.shard(edge.empty(spark)).count() == 0


def test_shards_hot_group_is_cut(spark):
    """A third of all rows are copies in one source: sizes stay near equal."""
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy copy copy', concat('text ', id)) as text",
                                      "'en' as lang", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    check_shards(df, 24, 400)


def test_shards_repeated_row_is_cut(spark):
    """A third of all rows are one row, repeated: sizes stay near equal."""
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'one text', concat('text ', id)) as text",
                                      "'en' as lang", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    check_shards(df, 24, 400)


# ---- rules ------------------------------------------------------------------

def brute_stats(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def check_stats(df):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                              for r in rules.statistics(df).collect())
    assert got == collections.Counter((r.doc_id, *brute_stats(r.text)) for r in df.collect())


def test_statistics(spark):
    check_stats(edge.docs(spark))
    check_stats(table(spark, "documents"))


def test_rules_reject_labelled_junk_and_keep_clean(spark):
    """Held-out accuracy: learned on four fifths of the labels, judged on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rules.filtered(docs, labels.where("pmod(doc_id, 5) <> 1"))
    got = judged.where("not base_failed").join(labels.where("pmod(doc_id, 5) = 1"), "doc_id").selectExpr(
        "count_if(quality = 0) bad", "count_if(quality = 0 and not kept) caught",
        "count_if(quality = 1) good", "count_if(quality = 1 and not kept) lost").first()
    assert got.caught >= 0.9 * got.bad
    assert got.lost <= 0.02 * got.good


def test_rules_edges(spark):
    labels = table(spark, "labels")
    assert rules.filtered(edge.empty(spark), labels).count() == 0
    out = rules.filtered(edge.docs(spark), labels.limit(0)).collect()
    assert len(out) == len(edge.rows())
    assert all(r.base_failed for r in out if r.n_words < 10)
    assert all(r.rule is None for r in out)
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 0), (7, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert rules.filtered(edge.docs(spark), nulls).count() == len(edge.rows())


@pytest.mark.parametrize("texts", [["a b c d e a b c d e"], ["x " * 50], ["a b c d e f a b c d e"]])
def test_repeat_windows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_stats(df)
