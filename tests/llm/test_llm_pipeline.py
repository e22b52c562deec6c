"""The pipeline, stage by stage, against what each stage promises."""
import collections

import corpus_pipeline
import edge
import numpy as np
from test_llm_native import brute_mix, WORD
from test_llm_simhash import brute_components, brute_fingerprint
from test_llm_text import whole_ids

from keyspan.llm import cotrain, secrets

SF = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    return out


def check(spark, docs, sf_dir, tmp_path):
    docs, good, single, masked, mixed, packed = stages(spark, docs, sf_dir, tmp_path)
    for x in (good, single, masked, mixed):
        assert x.columns == docs.columns
    count = lambda df: collections.Counter(map(repr, df.collect()))
    # 1: what the classifier keeps, whole rows
    judged = cotrain.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert count(good) == count(judged.where("ct_kept").select(*docs.columns))
    # 2: one row of each component
    rows = good.collect()
    found = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in rows])
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(
        {c for _, _, c in found if c is not None})
    by_row = count(good)
    assert all(by_row[repr(r)] for r in single.collect())
    # 3: the same rows without secrets
    path = secrets.default_vocabulary()
    want = collections.Counter((r.doc_id, secrets.mask(r.text, secrets.find(r.text, path), "<secret>"), r.source)
                               for r in single.collect())
    assert collections.Counter((r.doc_id, r.text, r.source) for r in masked.collect()) == want
    assert all(r.n_chars == len(r.text) for r in masked.collect() if r.text is not None)
    # 4: rows as often as the brute-force mix takes them
    sized = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in masked.collect()]
    want = collections.Counter()
    for r, _, copies in brute_mix(sized):
        want[r] += copies
    got = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert {r: n for r, n in got.items() if r[2]} == {r: n for r, n in want.items() if n and r[2]}
    # 5: every copy's ids, whole, in sequences without gaps
    need, have = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        need.update((r.doc_id, i, t) for i, t in enumerate(whole_ids(r.text)))
    sequences = collections.defaultdict(list)
    for r in packed.collect():
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        have.update((r.doc_id, i, t) for i, t in enumerate(ids, r.start))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert need == have
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    return single


def test_stages(spark, tmp_path):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, tmp_path)


def test_stages_on_awkward_rows(spark, tmp_path):
    check(spark, edge.docs(spark), SF, tmp_path)


def test_run(spark):
    from __spark_entry__ import queries
    assert queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_empty(spark, tmp_path):
    assert stages(spark, edge.empty(spark), SF, tmp_path)[-1].count() == 0
