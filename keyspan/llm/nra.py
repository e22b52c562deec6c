"""Ranked lexical search by NRA: sequential reads of impact-sorted lists.

One pass over the documents keeps, per document, its number of terms and the
frequencies of the query terms in it.  From that table come the counts the
weights need.  A second pass splits the documents into chunks; a chunk's
postings are sorted by impact, and every query reads its lists from the top,
deeper in each round, never at random:

- a document's **lower** bound is the sum of the impacts read for it;
- its **upper** bound adds, for every list in which it was not met yet, the
  impact at which that list stands (nothing once the list is read out).

A document whose upper bound is below the k-th best lower bound, or below the
k-th best score of the task's earlier chunks, is out, and so are documents that
were not met at all once the lists stand low enough.  Reading goes on until the
bounds of all others are equal: then membership, ties and scores are final.  A
task passes on k rows a query, whatever it read, so postings are never shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from keyspan.llm.common import bounded_batches, stored

K = 50
BLOCK_PAIRS = 400_000        # (item, term) pairs searched for at once; an item is not split
CHUNK_POSTINGS = 1 << 21     # postings sorted and read together
FIRST_DEPTH, DEEPER = 64, 4  # postings of a list read in the first round, and how much deeper the next ones go
PARTS = 256                  # tasks whose best rows are merged in the first of two steps

# A-Z to lower case; ASCII that is neither letter nor digit to a blank; the rest as it is
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text (UTF-8), in order, with repeats."""
    return (text or b"").translate(_TERM_BYTES).split()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> (item, term), a term once for each row."""
    for b in batches:
        rows, terms = [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            found = set(terms_of(text))
            rows += [i] * len(found)
            terms += found
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.binary())],
                                         names=["item", "term"])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """[(item, its terms)] in blocks of about ``BLOCK_PAIRS`` pairs."""
    pairs = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        _pairs, T.StructType([T.StructField("item", items.schema[id_col].dataType), T.StructField("term", T.BinaryType())]))
    block, size = [], 0
    for r in stored(pairs.distinct().orderBy("item", "term"), "nra-items").orderBy("item", "term").toLocalIterator():
        if not block or block[-1][0] != r["item"]:
            if size >= BLOCK_PAIRS:
                yield block
                block, size = [], 0
            block.append((r["item"], []))
        block[-1][1].append(bytes(r["term"]))
        size += 1
    if block:
        yield block


def _frequencies(numbers: dict[bytes, int]):
    """(doc_id, text) -> (doc_id, n, the numbers of its query terms, their frequencies)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1).to_pylist():
                all_terms = terms_of(text)
                n.append(len(all_terms))
                tf = Counter(filter(numbers.__contains__, all_terms))
                terms.append([numbers[t] for t in tf])
                tfs.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def read_lists(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """NRA over impact-sorted lists (docs, impacts): the documents that can be
    among the k best with a score of ``floor`` or more, and their exact scores.
    Documents that tie with the k-th are all among them."""
    lower = np.zeros(n_docs, np.int64)
    at, depth = [0] * len(lists), FIRST_DEPTH
    while True:
        unread = np.zeros(n_docs, np.int64)      # what the lists in which a document was not met can still give
        rest = 0
        for i, (docs, impacts) in enumerate(lists):
            upto = min(depth, len(docs))
            lower[docs[at[i]:upto]] += impacts[at[i]:upto]
            at[i] = upto
            if upto < len(docs):
                front = int(impacts[upto - 1])
                rest += front
                unread[docs[:upto]] -= front
        unread += rest
        least = max(1, floor)
        if n_docs > k:
            least = max(least, int(np.partition(lower, n_docs - k)[n_docs - k]))
        alive = lower + unread >= least
        if not unread[alive].any():
            found = np.flatnonzero(alive)
            return found, lower[found]
        depth *= DEEPER


def _search(block: list[tuple], item_type: pa.DataType, n_docs: int, n_terms: int, weights: np.ndarray,
            term_lists: list[list[int]], k: int):
    """(doc_id, n, terms, tfs) -> (item, part, doc_id, score): a task's k best of every item."""
    def chunks(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten())
            if size >= CHUNK_POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        best: list[list[tuple]] = [[] for _ in block]     # (-score, id is null, id)
        id_type = None
        for b in chunks(batches):
            id_type = b.column(0).type
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = np.diff(b.column(2).offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), held)
            term = b.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            order = np.lexsort((-impact, term))
            order = order[impact[order] > 0]
            doc, term, impact = doc[order], term[order], impact[order]
            starts = np.searchsorted(term, np.arange(len(weights) + 1))
            for i, numbers in enumerate(term_lists):
                lists = [(doc[starts[t]:starts[t + 1]], impact[starts[t]:starts[t + 1]]) for t in numbers
                         if starts[t] < starts[t + 1]]
                floor = -best[i][-1][0] if len(best[i]) == k else 0
                # the first entries bound every score of the chunk
                if not lists or sum(int(x[0]) for _, x in lists) < floor:
                    continue
                found, score = read_lists(lists, b.num_rows, k, floor)
                if len(found):
                    ids = b.column(0).take(pa.array(found)).to_pylist()
                    best[i] = heapq.nsmallest(k, best[i] + [(-s, d is None, d) for s, d in zip(score.tolist(), ids)])
        rows = [(item, s, d) for (item, _), found in zip(block, best) for s, _, d in found]
        if rows:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], item_type), pa.array([part] * len(rows), pa.int32()),
                 pa.array([r[2] for r in rows], id_type), pa.array([-r[1] for r in rows], pa.int64())],
                names=["item", "part", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: every item's k best documents with
    a score above 0, equal scores by ascending id (null ids last).

    Every row of ``docs`` is a document of its own, also where ids or texts
    repeat; null and empty texts have no terms and are never found.  Rows of
    ``items`` that share an id (null is an id like any other) are one item with
    the terms of all of them; an item without terms, or of whose terms none
    stands in a document, has no rows.  Empty tables give an empty result.
    Other columns are not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    out_schema = T.StructType([T.StructField("item", item_type), T.StructField("part", T.IntegerType()),
                               T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    result = None
    for block in _blocks(items, item_col, item_text_col):
        vocabulary = sorted({t for _, terms in block for t in terms})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        kept = stored(texts.mapInArrow(_frequencies(numbers), T.StructType([
            T.StructField("doc_id", id_type), T.StructField("n", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])),
            "nra-frequencies")
        totals = kept.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["terms"]:
            continue
        # at most one row for each term of the block
        dfs = kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in dfs:
            weights[r["term"]] = weight(totals["docs"], r["count"])
        found = kept.where("n > 0").mapInArrow(_search(
            block, to_arrow_type(item_type), totals["docs"], totals["terms"], weights,
            [[numbers[t] for t in terms] for _, terms in block], k), out_schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        result = spark.createDataFrame([], out_schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # two steps, so that no task merges the rows of all tasks
    near = (result.withColumn("part", F.floor(F.col("part") / PARTS))
            .withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
            .where(F.col("rank") <= k))
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .where(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
