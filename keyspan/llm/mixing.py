"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  Per source, tokens are summed by hash
bucket; the running sum finds the bucket in which the source's budget ends;
only that boundary bucket is summed again by the next ten hash bits, and so on
for ``LEVELS`` levels.  The budget then is one threshold per source, and the
documents are chosen by comparing their hash with it: no document is sorted,
and a source that holds a third of all rows costs no more than its
(pre-aggregated) 1,024 buckets.

Budgets are nested: copy ``k`` of a source is taken whole before copy ``k+1``
begins, so a document is taken 0, 1 or 2 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import stored, words

WEIGHTS = (3, 1, 2)      # by rank of the source, repeating
SHARE = 1.5              # of all sizes
MOST = 2                 # times its source's size, and a document's size
BITS, LEVELS = 10, 3     # hash bits of a histogram, and how often it is refined


def document_hash(doc_id: Column, size: Column, text: Column) -> Column:
    """60 bits that depend on the document alone, so reruns agree.  Rows with
    equal id and size are repeated rows and are taken together; rows without an
    id are told apart by their texts."""
    nameless = F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), nameless), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> plus target.  Shares go by weight; a target
    stops at ``most`` times its source's size and the excess is reshared.

    The fixed point is a water level: with sources ordered by size over weight
    the capped ones come first, and the level is the first one that caps no
    further source.  The two windows run over one row per *source*, never over
    documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight)
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = ((F.lit(share) * total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    leveled = (ranked.withColumn("level", level)
               .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"),
                                                 F.struct(F.col("source_size") / F.col("weight"), F.col("level"))))
                           .over(everything)["level"]))
    cap = (most * F.col("source_size")).cast("double")
    return leveled.select("source", "source_size",
                          F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, size, h) and (source, target, source_size, ...) -> the budgets
    with ``whole`` (copies that all documents get) and ``threshold``: hashes
    below it get one copy more."""
    span = 1 << BITS
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = stored(budgets.withColumn("whole", whole.cast("long"))
                   .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
                   .withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.lit(True)), "mix-budgets")
    for level in range(1, LEVELS + 1):
        shift = 60 - BITS * level
        s = state.where("open").select(F.col("source").alias("s_source"), "prefix", "left")
        bucket = F.shiftright("h", shift)
        inside = sized.join(s, sized["source"].eqNullSafe(s["s_source"])
                            & (F.shiftright("h", shift + BITS) == F.col("prefix")), "inner")
        hist = (inside.groupBy("source", "left", bucket.alias("bucket")).agg(F.sum("size").alias("n")))
        running = Window.partitionBy("source").orderBy("bucket")
        # the first bucket that the budget does not cover is the boundary
        first = (hist.withColumn("to", F.sum("n").over(running)).where("to > left")
                 .groupBy("source").agg(F.min(F.struct("bucket", (F.col("to") - F.col("n")).alias("before"), "n"))
                                        .alias("b")))
        b = first.select(F.col("source").alias("b_source"), "b.*")
        joined = state.join(b, state["source"].eqNullSafe(b["b_source"]), "left")
        found = F.col("bucket").isNotNull()
        state = joined.select(
            "source", "source_size", "target", "whole",
            F.when(found, F.col("left") - F.col("before")).otherwise(F.col("left")).alias("left"),
            # a source whose budget covers every bucket is closed: all its hashes are below
            F.when(found, F.col("bucket")).otherwise(
                F.when(F.col("open"), (F.col("prefix") + 1) * span).otherwise(F.col("prefix") * span)).alias("prefix"),
            (F.col("open") & found).alias("open"), F.coalesce("n", F.lit(0)).alias("n"))
        if level < LEVELS:
            state = stored(state.drop("n"), f"mix-level{level}")
    # the last bucket goes to the nearer side
    nearer = F.col("open") & (F.col("n") - F.col("left") < F.col("left"))
    return stored(state.select("source", "source_size", "target", "whole",
                               (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold")), "mix-thresholds")


def _hash_prefix(h: Column) -> Column:
    return F.shiftright(h, 60 - BITS * LEVELS)


def _copies(docs: DataFrame, plan: DataFrame, source: str, prefix: Column, most: int) -> DataFrame:
    """``docs`` with the plan's columns (all named ``mix_*``) and mix_copies.
    The plan has a row per source and Spark broadcasts it only if its stored
    size is under the session's threshold."""
    taken = F.col("mix_whole") + F.when(prefix < F.col("mix_threshold"), 1).otherwise(0)
    return (docs.join(plan, docs[source].eqNullSafe(plan["mix_source"]))
            .withColumn("mix_copies", F.least(taken, F.lit(most)).cast("int")))


def _plan(docs, id_col, source_col, text_col, weights, share, most) -> tuple[DataFrame, DataFrame]:
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               F.size(words(F.col(text_col))).cast("long").alias("size"), F.col(text_col).alias("text"))
                   .select("doc_id", "source", "size", document_hash(F.col("doc_id"), F.col("size"), F.col("text")).alias("h")),
                   "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = thresholds(sized, targets(sums, weights, share, most))
    return sized, t.select(*[F.col(c).alias(f"mix_{c}") for c in t.columns])


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size,
    target, copies (0, 1 or 2).

    Null texts have size 0, a null source is a source of its own and ranks
    last, a document with a null id hashes by its text.  Documents of size 0 may be given
    any number of copies; they add no words.  Repeated rows share one fate.  An
    empty table gives an empty result; other columns are not read.
    """
    sized, plan = _plan(docs, id_col, source_col, text_col, weights, share, most)
    return _copies(sized, plan, "source", _hash_prefix(F.col("h")), most).select(
        "doc_id", "source", "size", F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as
    :func:`mix` takes it.  Only the plan (a row per source) meets the
    documents again, so texts are not shuffled.  Columns must not begin with
    ``mix_``."""
    _, plan = _plan(docs, id_col, source_col, text_col, weights, share, most)
    size = F.size(words(F.col(text_col))).cast("long")
    h = document_hash(F.col(id_col), size, F.col(text_col))
    chosen = _copies(docs, plan, source_col, _hash_prefix(h), most)
    return (chosen.where("mix_copies > 0")
            .withColumn("mix_i", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
            .select(*docs.columns))
