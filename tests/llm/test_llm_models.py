"""Co-training, nearest neighbours, LM scores and main text."""
import collections
import math
import zlib

import edge
import numpy as np
import pytest

from keyspan.llm import cotrain, lbl, mainpage, postings

SF, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# ---- co-training ------------------------------------------------------------

def test_cotraining_accuracy_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    out = cotrain.classified(docs, labels.where("pmod(doc_id, 5) <> 1"))
    got = out.join(labels.where("pmod(doc_id, 5) = 1"), "doc_id").selectExpr(
        "count_if(quality = 0) bad", "count_if(quality = 0 and not ct_kept) caught",
        "count_if(quality = 1) good", "count_if(quality = 1 and not ct_kept) lost").first()
    assert got.caught >= 0.95 * got.bad
    assert got.lost <= 0.01 * got.good


def test_cotraining_sample_is_of_its_documents(spark, monkeypatch):
    """Labels of other documents do not use up the sample."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id for r in cotrain.classified(docs, labels).where("not ct_kept").collect()}
    others = spark.range(10 ** 6, 10 ** 6 + 50_000).selectExpr("id doc_id", "0 quality", "0 toxic")
    more = labels.selectExpr("doc_id", "quality", "toxic").unionByName(others)
    got = {r.doc_id for r in cotrain.classified(docs, more).where("not ct_kept").collect()}
    assert want and got == want


def test_cotraining_says_when_it_does_nothing(spark):
    df = edge.docs(spark)
    with pytest.warns(UserWarning, match="every document is kept"):
        cotrain.classified(df, spark.createDataFrame([(10 ** 6, 0), (10 ** 6 + 1, 1)], "doc_id long, quality int"))
    with pytest.raises(ValueError):
        cotrain.classified(df.withColumnRenamed("kept", "ct_kept"), spark.createDataFrame([], "doc_id long, quality int"))


def test_cotraining_exchanges_confident_labels():
    """With few labels on one side the other view's pseudo-labels help."""
    rng = np.random.default_rng(0)

    def rows(n, y):
        return ((2 * y[:, None] - 1) * 1.2 + rng.standard_normal((n, 6))).astype(np.float32)

    y = np.tile([0, 1], 12)
    pool_y, test_y = rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    text, meta, pt, pm = rows(24, y), rows(24, y), rows(3000, pool_y), rows(3000, pool_y)
    test = [rows(3000, test_y), rows(3000, test_y)]
    acc = []
    for rounds in (0, cotrain.ROUNDS):
        m = cotrain.co_train(text, meta, y, pt, pm, rounds)
        p = m.probability([v.score(x) for v, x in zip(m.views, test)])
        acc.append([float(((q >= 0.5) == test_y).mean()) for q in p])
    assert acc[1][2] >= 0.95 and min(acc[1][:2]) >= min(acc[0][:2]) - 0.01
    assert acc[1][2] >= max(acc[1][:2]) - 0.01              # both views together are no worse than one


def test_cotraining_against_brute_force(spark):
    """The same rounds over all documents in memory give the same scores."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("doc_id % 3 = 0")
    model = cotrain.fit(docs, labels, labelled=200, rounds=2, exchanged=25)
    rows = docs.selectExpr("*", "xxhash64(doc_id) h", "pmod(xxhash64(doc_id), 1L << 40) p").orderBy("h").collect()
    known = {r.doc_id: int(r.quality >= 0.5) for r in labels.where("quality is not null").collect()}
    x = {r.doc_id: np.concatenate([cotrain.text_features(r.text), cotrain.meta_features(r.source, r.lang, r.n_chars)])
         .astype(np.float16) for r in rows}
    cut = cotrain.TEXT_SIZE
    side = (lambda d: x[d][:cut], lambda d: x[d][cut:])
    first = [r.doc_id for r in rows if r.doc_id in known][:200]
    y = np.array([known[d] for d in first])
    apart = np.arange(len(y)) % 3 == 2
    learned = [[(d, known[d]) for d in np.array(first)[~apart]] for _ in (0, 1)]
    for step in range(3):
        views, scales = [], []
        for i in (0, 1):
            z = np.stack([side[i](d) for d, _ in learned[i]]).astype(np.float32)
            views.append(cotrain.Logistic().fit(z, np.array([t for _, t in learned[i]], np.float32)))
            scales.append(cotrain.calibrate(views[i].score(np.stack([side[i](d) for d in first])[apart]), y[apart]))
        if step == 2:
            break
        for i in (0, 1):
            have = {d for d, _ in learned[1 - i]}
            odds = {r.doc_id: scales[i][0] * views[i].score(side[i](r.doc_id)[None])[0] + scales[i][1] for r in rows}
            free = [r for r in sorted(rows, key=lambda r: r.p) if r.doc_id not in known and r.doc_id not in have]
            for label in (0, 1):
                sure = [r for r in free if (odds[r.doc_id] if label else -odds[r.doc_id]) >= cotrain.SURE][:25]
                learned[1 - i] += [(r.doc_id, label) for r in sorted(sure, key=lambda r: r.h)]
    given = [len(t) - int((~apart).sum()) for t in learned]
    assert max(given) > 25, given                                   # something was exchanged
    for i in (0, 1):
        every = np.stack([side[i](d) for d in x])
        want = scales[i][0] * views[i].score(every) + scales[i][1]
        np.testing.assert_allclose(model.log_odds(i, model.views[i].score(every)), want, rtol=0.02, atol=0.05)


def test_cotraining_edges(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df = edge.docs(spark)
    assert cotrain.classified(edge.empty(spark), labels).count() == 0
    none = cotrain.classified(df, labels.limit(0)).collect()
    assert len(none) == len(edge.rows()) and all(r.ct_kept for r in none)
    odd = spark.createDataFrame([(i % 17, None if i % 5 == 0 else i % 2, 0) for i in range(60)] + [(None, 1, 0)],
                                "doc_id long, quality int, toxic int")
    out = cotrain.classified(df, odd)
    assert out.columns == df.columns + ["ct_scores", "ct_kept"] and out.count() == len(edge.rows())
    assert all(0 <= r.ct_scores.score <= 1 for r in out.collect())


# ---- nearest neighbours -----------------------------------------------------

def brute_nearest(rows, asked, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if asked(i)}):
        best = {}
        for v in x[ids == q]:
            d = np.sqrt(((x - v) ** 2).sum(1))
            for i, s in zip(ids.tolist(), d.tolist()):
                if i != q:
                    best[i] = min(s, best.get(i, s))
        out[q] = sorted((s, i) for i, s in best.items())[:k]
    return out


def recall(got, want):
    """Found neighbours that are as near as the true ones."""
    hit = n = 0
    for q, best in want.items():
        far = best[-1][0] if best else 0
        hit += sum(r.score <= far + 1e-9 for r in got.get(q, []))
        n += len(best)
    return hit / n


def by_query(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.query_id].append(r)
    for rows in got.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
    return got


def clustered(spark, n=12_000, centres=400, dim=32, seed=1):
    """Vectors around centres that lie in groups themselves; more lists than a query opens."""
    rng = np.random.default_rng(seed)
    groups = rng.standard_normal((20, dim))
    c = groups[rng.integers(0, 20, centres)] + 0.5 * rng.standard_normal((centres, dim))
    x = c[rng.integers(0, centres, n)] + 0.25 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)


@pytest.mark.parametrize("table", ["given", "clustered"])
def test_recall(spark, table):
    df = spark.read.parquet(f"{SF1}/embeddings.parquet") if table == "given" else clustered(spark)
    got = by_query(postings.search(df, lambda i: i % 100 == 0))
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 100 == 0)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert len(rows) == len(want[q])
    assert recall(got, want) >= 0.9


def test_lists_are_pruned(spark):
    """How much of a table a query is compared with, and what that finds."""
    share = {}
    for name, df in (("given", spark.read.parquet(f"{SF1}/embeddings.parquet")), ("clustered", clustered(spark))):
        v = postings.usable(df, "vec_id", "embedding").persist()
        c = postings.fit_centroids(np.array([r.vec for r in v.select("vec").collect()]))
        kind = "list int, vec_id long, vec array<double>"
        index = v.mapInArrow(postings._lists(c, 1, postings.REPLICATE, postings.COPIES), kind).groupBy("list").count()
        asked = v.where("vec_id % 100 = 0").mapInArrow(postings._lists(c, postings.LEAST_PROBES, postings.PROBE), kind)
        n, q = v.count(), v.where("vec_id % 100 = 0").count()
        share[name] = asked.join(index, "list").agg({"count": "sum"}).first()[0] / (n * q)
        opened = asked.count() / q
        assert opened < len(c)
        v.unpersist()
    assert share["clustered"] < 0.05          # where there are clusters
    assert share["given"] < 1.2               # vectors that lie evenly: about a third of them lie in two lists


def test_nearest_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], "x", 1) for i in range(60)]
    rows += [(5, rows[5][1], "again", 2), (6, [9.0, 9.0, 9.0, 9.0], "second", 1), (100, rows[0][1], "tie", 1)]
    odd = [(200, None, "", 1), (300, [0.0] * 4, "", 1), (400, [1.0, None, 2.0, 3.0], "", 1), (None, [1.0] * 4, "", 1),
           (500, [1.0, float("nan"), 2.0, 3.0], "", 1), (600, [1.0, float("inf"), 2.0, 3.0], "", 1), (700, [1.0, 2.0], "", 1),
           (800, [], "", 1)]
    kind = "vec_id long, embedding array<double>, list string, rank int"
    df = spark.createDataFrame(rows + odd, kind)
    got = by_query(postings.search(df, lambda i: i % 5 == 0))
    want = brute_nearest([(i, v) for i, v, *_ in rows], lambda i: i % 5 == 0)
    assert set(got) == set(want)
    for q in want:
        assert [r.vec_id for r in got[q]] == [i for _, i in want[q]]
        assert np.allclose([r.score for r in got[q]], [s for s, _ in want[q]])
    few = spark.createDataFrame(rows[:4], kind)
    assert len(by_query(postings.search(few, lambda i: i == 0))[0]) == 3
    assert postings.search(spark.createDataFrame([], kind), lambda i: i % 5 == 0).count() == 0
    assert postings.search(spark.createDataFrame(odd, kind), lambda i: i % 5 == 0).count() <= 10


def test_hot_vector_is_dealt_out(spark, monkeypatch):
    """A third of the rows are one vector: all parts of its list are searched."""
    monkeypatch.setattr(postings, "PART_ROWS", 50)
    df = spark.range(3000).selectExpr(
        "id as vec_id", "if(id % 3 = 0, array(1d, 2d, 3d), array(cast(id % 13 as double), cast(id % 17 as double), id / 3000d)) "
        "as embedding")
    got = by_query(postings.search(df, lambda i: i % 300 == 0))
    for q, rows in got.items():
        assert [r.vec_id for r in rows] == [i for i in range(0, 36, 3) if i != q][:10]


def test_balanced_lists():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((3000, 8)) * 0.05, rng.standard_normal((1000, 8)) * 3])
    c = postings.fit_centroids(x)
    n = np.bincount(postings.distances(x, c).argmin(1), minlength=len(c))
    assert n.max() <= 6 * postings.PER_LIST
    graph = postings.CentroidGraph(c)
    hits = [graph.search(v, 1)[0][0] == postings.distances(v[None], c).argmin() for v in x[::20]]
    assert np.mean(hits) >= 0.97


# ---- LM scores --------------------------------------------------------------

def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base) of rows (doc_id, text)."""
    docs, count = [], collections.Counter()
    for d, text in rows:
        t = [*(text or "").encode().lower().split(), b""]
        held = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        docs.append((d, held, t))
        if not held:
            count.update(t)
    total, distinct = sum(count.values()), len(count)
    for d, held, t in docs:
        yield (d, held, len(t), sum(count[w] > 0 for w in t), total,
               sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t))


def check_base(df, **sizes):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 3))
    got = sorted(lbl.scored(df, **sizes).collect(), key=key)
    want = sorted(brute_base([(r.doc_id, r.text) for r in df.collect()]), key=key)
    assert [tuple(g)[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g.base_score for g in got], [w[5] for w in want], rtol=1e-7, atol=1e-6)
    assert all(np.isfinite(g.score) and g.score <= 0 for g in got)
    return got


def test_lm_edges(spark):
    check_base(edge.docs(spark))
    check_base(edge.docs(spark), frequent=40, classes=7)
    assert lbl.scored(edge.empty(spark)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    check_base(spark.createDataFrame([(i, "only held out") for i in held], "doc_id long, text string"))


def test_lm_beats_the_base_on_held_out_text(spark):
    rows = check_base(spark.read.parquet(f"{SF1}/documents.parquet"))
    held = [r for r in rows if r.held_out]
    base, score = sum(r.base_score for r in held), sum(r.score for r in held)
    assert score > base + 0.1 * sum(r.n_tokens for r in held)


def test_contexts_begin_at_each_text():
    import pyarrow as pa
    texts = [[3, 4, 0], [0], [5, 6, 7, 0]]
    batch = pa.RecordBatch.from_arrays([pa.array([np.array(t, np.uint16).tobytes() for t in texts])], names=["classes"])
    (u, v, w), = lbl._contexts(iter([batch]), 0)
    assert list(zip(u.tolist(), v.tolist(), w.tolist())) == [
        (0, 0, 3), (0, 3, 4), (3, 4, 0), (0, 0, 0), (0, 0, 5), (0, 5, 6), (5, 6, 7), (6, 7, 0)]


def test_most_frequent_tokens(spark):
    rows = [(b"", 3)] + [(f"w{i}".encode(), n) for i, n in enumerate([9, 9, 5, 5, 5, 1, 1])]
    counts = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "token binary, n long")
    assert lbl.most_frequent(counts, 6) == [(b"", 3), (b"w0", 9), (b"w1", 9), (b"w2", 5), (b"w3", 5), (b"w4", 5)]
    assert lbl.most_frequent(counts, 5) == [(b"", 3), (b"w0", 9), (b"w1", 9)]
    assert lbl.most_frequent(counts, 100)[1:] == [(a, b) for a, b in rows[1:]]
    assert lbl.most_frequent(counts.limit(0), 5) == [(b"", 0)]


def test_lm_probabilities_are_normalised():
    rng = np.random.default_rng(2)
    unigram = rng.random(50)
    m = lbl.Model(50, unigram / unigram.sum(), seed=4)
    m.r *= 8
    near, far, norm = m.tables()
    for u, v in ((0, 1), (7, 3), (49, 49)):
        assert abs(np.exp(near[v] + far[u] - norm[v, u]).sum() - 1) < 1e-4


def test_nce_learns_a_conditional_distribution():
    """A Markov chain: the model gets close to its entropy."""
    rng = np.random.default_rng(6)
    n = 12
    follow = rng.permutation(n)
    s = [0]
    for _ in range(120_000):
        s.append(int(follow[s[-1]]) if rng.random() < 0.8 else int(rng.integers(n)))
    s = np.array(s)
    unigram = np.bincount(s, minlength=n) / len(s)
    t = lbl.Trainer(lbl.Model(n, unigram), unigram, seed=1)
    for at in range(2, len(s), 2048):
        w = np.arange(at, min(at + 2048, len(s)))
        t.step(*(s[i].astype(np.uint16) for i in (w - 2, w - 1, w)))
    near, far, norm = t.m.tables()
    at = np.arange(2, len(s))
    mean = float((near[s[at - 1], s[at]] + far[s[at - 2], s[at]] - norm[s[at - 1], s[at - 2]]).mean())
    best = 0.8 + 0.2 / n
    entropy = -(best * np.log(best) + (n - 1) * (0.2 / n) * np.log(0.2 / n))
    assert mean > -entropy - 0.15


# ---- main text --------------------------------------------------------------

def text_of(page):
    return mainpage.unique_runs([{"text": t, "kind": k} for t, k in mainpage.blocks(page)], None)


def test_blocks_by_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p><b>One &lt;two&gt;&nbsp; <br>three<p>Four &#233;&#x4e2d;</p><aside>Side</aside>
    <section id="comments"><p>reader</p></section><form>Name<input></form></article><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Head & line\n\nOne <two> three\n\nFour é中"
    assert text_of(None) == text_of("") == text_of("<p></p>") == ""
    assert text_of("plain < text & more") == "plain < text & more"
    assert text_of("<p>a<p>b</div></p><ul><li>c<li>d</ul>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert text_of("<div class='cookie-notice'><p>x</div><p class=lead>kept <span class='ad'>inline</span></p>") == "kept inline"
    assert text_of("<article><header><h1>Title</h1></header><p>t</p></article><!-- unclosed <p>x") == "Title\n\nt"


def test_wrappers_do_not_hide_the_article():
    body = "<article><h1>Head</h1><p>the story</p></article>"
    want = "Head\n\nthe story"
    for page in (f"<body><form id=aspnet><div>{body}</div></form></body>",
                 f"<body class='has-sidebar'>{body}<div class=sidebar>side</div></body>",
                 f"<div class='content-with-sidebar'>{body}</div>", f"<div class='ads widget'><div>{body}</div></div>",
                 "<article class='post comments-open'><h1>Head</h1><p>the story</p></article>",
                 "<main id=widget><h1>Head</h1><p>the story</p></main>",
                 "<div class=social><main><h1>Head</h1><p>the story</p></main></div>",
                 f"<main><div class=page-widget>{body}</div></main>",
                 f"<form><form>q</form>{body}</form>",
                 "<body class=has-sidebar><div>Head</div><div>the story</div><nav>menu</nav></body>",
                 "<form><h1>Head</h1><div>the story</div><footer>f</footer></form>",
                 # teasers and comments beside or in an article stay out
                 f"{body}<div class=related><article>teaser</article></div>",
                 "<article><h1>Head</h1><p>the story</p><div class=comments><article>reader</article></div></article>",
                 f"<form>search</form><aside><article>teaser</article></aside>{body}"):
        assert text_of(page) == want, page
    assert text_of("<form>" * 30000 + "x") == ""             # unclosed forms are searched once


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, blocks string")


def test_repeats_of_a_host_are_removed(spark):
    shared = "all rights reserved by the owners of this very site since long ago"
    rows = [(i, f"https://a.example/p{i}", f"<div>story {i} is about topic {i} and nothing else {i}</div><div>{shared}</div>",
             "", "", "") for i in range(40)]
    rows += [(100, "https://b.example/x", f"<div>{shared}</div>", "", "", ""),
             (101, "https://b.example/x?again", f"<div>{shared}</div>", "", "", ""),          # the same page twice
             (102, "HTTP://A.example:80/y", f"<article><p>{shared}</p></article>", "", "", ""),
             (103, None, "", "", "", ""), (104, None, None, "", "", ""), (None, "nohost", "<p>x", "", "", ""),
             rows[0]]
    got = collections.defaultdict(list)
    for r in mainpage.extracted(pages(spark, rows)).collect():
        got[r.page_id].append(r.text)
    assert len(got[0]) == 2
    for i in range(40):
        assert set(got[i]) == {f"story {i} is about topic {i} and nothing else {i}"}
    assert got[100] == got[101] == got[102] == [shared]
    assert got[103] == got[104] == [""] and got[None] == ["x"]
    assert mainpage.extracted(pages(spark, [])).count() == 0


def test_blocks_that_stand_in_most_articles_are_removed(spark):
    notice = "this site uses small files to keep you signed in"
    story = lambda i: f"story {i} is about topic {i} and nothing else {i}"
    page = lambda i, more="": f"<main><p>{story(i)}</p><div>{notice}</div>{more}</main>"
    rows = [(i, f"https://a.example/p{i}", page(i), "", "", "") for i in range(20)]
    # a passage that some articles share stays; so does a short heading that all have
    rows += [(i, f"https://b.example/p{i}", f"<article><h2>Summary</h2><p>{story(i)}</p>"
              + "<p>a passage that only some of the articles share</p>" * (i < 40) + "</article>", "", "", "")
             for i in range(30, 60)]
    # one article under many addresses is no repeat; a host with few articles has no boilerplate
    rows += [(i, f"https://c.example/p{i}", f"<main><p>{story(60)}</p></main><nav>{i}</nav>", "", "", "") for i in range(60, 80)]
    rows += [(i, f"https://d.example/p{i}", page(i), "", "", "") for i in range(80, 83)]
    # beside open text, and twice in one article
    rows += [(90, "https://a.example/open", page(90, f"<p>{notice}</p>") + "<div>open words</div>", "", "", "")]
    got = {r.page_id: r.text.split("\n\n") for r in mainpage.extracted(pages(spark, rows)).collect()}
    assert all(got[i] == [story(i)] for i in range(20))
    assert all(got[i][:2] == ["Summary", story(i)] and len(got[i]) == 2 + (i < 40) for i in range(30, 60))
    assert all(got[i] == [story(60)] for i in range(60, 80))
    assert all(got[i] == [story(i), notice] for i in range(80, 83))
    assert got[90] == [story(90), "open words"]


def test_suffix_array_decides_on_runs_inside_blocks(spark):
    first, second = "this site uses small files for you", "read all about them in our terms"
    story = lambda i: f"story {i} is about topic {i} and nothing else {i}"
    # one notice, set as one block or as two: neither form stands in more than half of the articles
    rows = [(i, f"https://a.example/p{i}", f"<main><p>{story(i)}</p>" + (f"<p>{first} {second}</p>" if i % 2 else
             f"<p>{first}</p><p>{second}</p>") + "</main>", "", "", "") for i in range(20)]
    # a repeat ends with its block, also if the next blocks begin alike
    rows += [(i, f"https://b.example/p{i}", f"<div>{first}</div><div>here now is story {i}</div>", "", "", "") for i in range(30, 40)]
    # a block that goes on after the notice stays whole; so does one beside a copy of its page
    rows += [(40, "https://a.example/on", f"<main><p>{first} forty</p></main>", "", "", ""), rows[0]]
    got = collections.defaultdict(list)
    for r in mainpage.extracted(pages(spark, rows)).collect():
        got[r.page_id].append(r.text)
    assert got[0] == [story(0)] * 2
    assert all(got[i] == [story(i)] for i in range(1, 20))
    assert all(got[i] == [f"here now is story {i}"] for i in range(30, 40))
    assert got[40] == [f"{first} forty"]


def test_neighbours_in_the_array_whatever_the_batches():
    import pyarrow as pa
    rows = sorted([("h", p, i) for i, p in enumerate("aabcccdefff")] + [("k", "f", 50), ("k", "g", 51)])
    schema = pa.schema([("host", "string"), ("prefix", "string"), ("at", "int64")])
    want = [r for i, r in enumerate(rows) if i in (0, len(rows) - 1) or r[:2] in (rows[i - 1][:2], rows[i + 1][:2])]
    for n in (1, 2, 3, 5, 50):
        cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + n])], schema=schema) for i in range(0, len(rows), n)]
        got = [tuple(r.values()) for b in mainpage._neighbours(iter([cut[0].slice(0, 0), *cut])) for r in b.to_pylist()]
        assert got == want, n
    assert list(mainpage._neighbours(iter([]))) == []


def test_repeated_prefixes_against_brute_force(spark):
    import random
    rng = random.Random(4)
    streams = [("h", i, [rng.choice("abc") for _ in range(rng.randint(0, 60))]) for i in range(12)]
    got = {r.page: r.starts for r in mainpage.repeated(
        spark.createDataFrame(streams, "host string, page long, stream array<string>"), 4).collect()}
    grams = collections.defaultdict(set)
    for _, i, s in streams:
        for k in range(len(s) - 3):
            grams[tuple(s[k:k + 4])].add(i)
    for _, i, s in streams:
        want = [k for k in range(len(s) - 3) if len(grams[tuple(s[k:k + 4])]) > 1]
        assert got.get(i, []) == want


def test_real_pages_match_the_article(spark):
    """The pages' generator puts the article between its tags."""
    import html
    import re
    from keyspan.llm.catalog import QUERIES
    got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in parts]
        assert got[r.page_id].text.split("\n\n") == [x for x in want if x]
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


HOSTILE = {"open tags": "<a " * 350_000, "end tags": "</p>" * 250_000, "open quotes": "<a \"" * 250_000,
           "deep, then unmatched ends": "<b>" * 160_000 + "</p>" * 130_000, "names without end": "<aaa" * 250_000,
           "comments": "<!-- " * 200_000, "crossed quotes": "<a '\"" * 200_000 + ">", "list items": "<b><li>" * 140_000,
           "items over inline": "<li><div>" + "<b>" * 100_000 + "<li></li>" * 70_000, "forms": "<form>" * 160_000}


@pytest.mark.parametrize("kind", HOSTILE)
def test_a_bad_page_of_a_megabyte_takes_no_time(kind):
    import time
    began = time.perf_counter()
    mainpage.blocks(HOSTILE[kind])
    assert time.perf_counter() - began < 10


def test_quotes_and_broken_tags():
    text = lambda page: [t for t, _ in mainpage.blocks(page)]
    assert text('<p title="a > b">one</p><p title=\'"\'>two</p>') == ["one", "two"]
    assert text("a < b, 1 <2> 3") == ["a < b, 1 <2> 3"]
    assert text("<p>one <a href='x>two") == ["one <a href='x>two"]
    assert text("x<!-- y --><p>z<!-- never") == ["x", "z"]
    assert text("<![CDATA[a < b]]>") == ["a < b"]
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert text("one</b></i></p>two") == ["one", "two"]
