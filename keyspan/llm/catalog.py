"""Registered queries of the training-data operators (``opN_<name>``), each
over the whole of its table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import cotrain, kdshard, lbl, mainpage, mixing, nra, packing, postings, ppm, rules, secrets, simhash, variants
from keyspan.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_cotraining")
def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotrain.classified(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "ct_scores.*", F.col("ct_kept").alias("kept"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_posting_lists")
def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query("op5_kd_sharding")
def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kdshard.shard(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END
             AS weight FROM s),
-- targets that reach the cap stop there; the rest is shared again by weight until none is above
shares AS (
  SELECT 0 AS step, source, source_size, weight, false AS capped FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         capped OR weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())
                   / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) > 2 * source_size
  FROM shares WHERE step < (SELECT count(*) FROM w)),
f AS (SELECT *, weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER ())
                / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) AS share
      FROM shares WHERE step = (SELECT max(step) FROM shares)),
t AS (SELECT source, source_size, (CASE WHEN capped OR share IS NULL THEN 2 * source_size ELSE share END)::DOUBLE AS target
      FROM f),
b AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
h AS (SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size), 1, 15))::BIGINT
             >> 30 AS p FROM d),
g AS (SELECT source, p, sum(size) AS n FROM h GROUP BY source, p),
c AS (SELECT g.source, p, n, sum(n) OVER (PARTITION BY g.source ORDER BY p) - n AS before,
             target - whole * source_size AS budget FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
-- hashes before the one in which the budget ends, and that one if it ends nearer
k AS (SELECT source, p, before + n <= budget
             OR (before <= budget AND n - (budget - before) < budget - before) AS more FROM c)
SELECT h.doc_id, h.size::BIGINT AS size, b.source_size, b.target,
       (h.size * least(2, b.whole + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken, h.source
FROM h JOIN b ON h.source IS NOT DISTINCT FROM b.source
JOIN k ON h.source IS NOT DISTINCT FROM k.source AND h.p = k.p
"""


@query("op6_mixing", OP6_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


@query("op7_lbl_scores")
def op7_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scored(table(spark, sf_dir, "documents"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.filtered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "rule")


def spans_text(spans, kinds=None):
    """kind:start:end of the spans (of the given kinds), comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(spans_text(F.col("spans"), ("assign", "access", "hex")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT row_id, doc_id, n, term, count(*) AS tf
      FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, s GROUP BY term, n_docs),
c AS (SELECT q.item_id, p.row_id, p.doc_id,
             sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.n_docs) // s.n_terms))))::BIGINT AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON q.term = w.term, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identified(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))
