"""Language identification by prediction by partial matching.

Every language has a context tree over bytes: which bytes followed each context
of 0 to ``ORDER`` bytes, and how often.  A byte is coded in the longest known
context; if it was never seen there, the code escapes to the next shorter one
(method C: a context seen c times with d distinct successors escapes with
d / (c + d)), where the successors of the longer context are excluded, and in
the end to an even choice among the bytes the tree does not know at all.  The
statistics are frozen: the code length of a text is the sum over its bytes, and
the language with the shortest code wins.

The trees are fitted on a bounded sample of labelled texts (``SAMPLE_BYTES``
over all languages), counted by Spark, so what is sent to the tasks is bounded;
every text is then scored whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.llm.common import bounded_batches

ORDER = 4                    # bytes of the longest context
SAMPLE_BYTES = 8 << 20       # labelled text that the trees are fitted on, over all languages
MOST_LANGUAGES = 1000
UNKNOWN = "und"
PIECE = 1 << 17              # bytes scored at once
START = b"\n" * ORDER        # the context of a text's first bytes


def _held(doc_id: Column) -> Column:
    """Held out from training; a row without an id is neither held out nor trained on."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def keys(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte from the ``ORDER``-th on, it and the ``order`` bytes before it as one number."""
    out = np.zeros(len(data) - ORDER, np.int64)
    for back in range(order, -1, -1):
        out <<= 8
        out |= data[ORDER - back:len(data) - back]
    return out


class Trees:
    """The context trees of all languages, by order.

    ``grams[k]``: sorted numbers of (context of k bytes, byte), ``logn[k]``: the
    logarithm of their count for each language (-inf: never).  ``contexts[k]``:
    sorted contexts with, for each language, whether it is known, the logarithm
    of c + d, the cost of escaping from it as the first context, and, for the
    next shorter context once this one was escaped from, the logarithm of its
    total and the cost of escaping from it, without this one's successors.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts[k]: sorted distinct gram numbers, and a count for each language (columns)."""
        self.grams = [g for g, _ in counts]
        self.languages = counts[0][1].shape[1]
        with np.errstate(divide="ignore"):
            self.logn = [np.log2(n.astype(np.float64)) for _, n in counts]
        self.contexts, self.known, self.total, self.escape, self.next_total, self.next_escape = ([] for _ in range(6))
        for k, (grams, n) in enumerate(counts):
            context, where = np.unique(grams >> 8, return_inverse=True)
            c, d = (np.zeros((len(context), self.languages), np.int64) for _ in range(2))
            np.add.at(c, where, n)
            np.add.at(d, where, n > 0)
            self.contexts.append(context)
            self.known.append(c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.total.append(np.log2((c + d).astype(np.float64)))
                self.escape.append(self.total[-1] - np.log2(d.astype(np.float64)))
                if k:
                    # what the shorter context holds besides the successors of this one
                    shorter = np.searchsorted(self.contexts[k - 1], context & ((1 << 8 * (k - 1)) - 1))
                    same = n_of(counts[k - 1], grams & ((1 << 8 * k) - 1))
                    gone = np.zeros_like(c)
                    np.add.at(gone, where, np.where(n > 0, same, 0))
                    rest, left = c_before[shorter] - gone, d_before[shorter] - d
                    self.next_total.append(np.log2((rest + left).astype(np.float64)))
                    self.next_escape.append(np.where(left > 0, self.next_total[-1] - np.log2(left.astype(np.float64)), 0.0))
                else:
                    self.next_total.append(None)
                    self.next_escape.append(None)
                    self.last = np.log2(np.maximum(256 - d[0], 1).astype(np.float64)) if len(d) else None
            c_before, d_before = c, d
        self.index = Index(self.grams[ORDER], self.cost(self.grams[ORDER]))

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of each byte after its ``ORDER`` bytes, for each language."""
        n = len(grams)
        out = np.zeros((n, self.languages))
        open_ = np.ones((n, self.languages), bool)          # not coded yet
        fresh = np.ones((n, self.languages), bool)          # no context known so far
        total = escape = np.zeros((n, self.languages))
        for k in range(ORDER, -1, -1):
            gram = grams & ((1 << 8 * (k + 1)) - 1)
            at, there = find(self.contexts[k], gram >> 8)
            known = self.known[k][at] & there[:, None]
            total = np.where(fresh, self.total[k][at], total)
            escape = np.where(fresh, self.escape[k][at], escape)
            at_gram, has = find(self.grams[k], gram)
            logn = np.where(has[:, None], self.logn[k][at_gram], -np.inf)
            seen = np.isfinite(logn)
            coded = open_ & known & seen
            out[coded] += (total - np.where(seen, logn, 0))[coded]
            open_ &= ~coded
            missed = open_ & known
            out[missed] += escape[missed]
            fresh &= ~known
            if k:
                total = np.where(known, self.next_total[k][at], total)
                escape = np.where(known, self.next_escape[k][at], escape)
        return out + np.where(open_, self.last, 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (bits) of whole texts, for each language."""
        out = np.zeros((len(texts), self.languages))
        held, rows, size = [], [], 0

        def flush():
            data = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
            gram = keys(np.concatenate([np.zeros(ORDER, np.int64), data]))
            lengths = np.array([len(h) for h in held])
            ends = np.cumsum(lengths)
            mine = np.ones(len(data), bool)
            mine[((ends - lengths)[:, None] + np.arange(ORDER)).ravel()] = False     # contexts in front of a piece
            bits = self.index.look_up(gram[mine], self.cost)
            starts = np.r_[0, np.cumsum(lengths - ORDER)[:-1]]
            for row, total in zip(rows, np.add.reduceat(bits, starts, axis=0)):
                out[row] += total

        for row, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                held.append((START + text[:PIECE] if not at else text[at - ORDER:at + PIECE]))
                rows.append(row)
                size += len(held[-1])
                if size >= PIECE:
                    flush()
                    held, rows, size = [], [], 0
        if held:
            flush()
        return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there)."""
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def n_of(counted: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    return counted[1][np.searchsorted(counted[0], grams)]


class Index:
    """Numbers -> rows of a matrix, by a hash table in numpy; numbers that are
    not in it are computed, once for each call."""

    def __init__(self, numbers: np.ndarray, rows: np.ndarray):
        self.bits = max(8, int(4 * len(numbers)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.numbers = numbers
        self.rows = rows
        left, slot = np.arange(len(numbers)), self._slot(numbers)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]             # of several for one slot the last stays
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, numbers: np.ndarray, compute) -> np.ndarray:
        slot = self._slot(numbers)
        at = self.slots[slot]
        out_at = np.where((at >= 0) & (self.numbers[np.maximum(at, 0)] == numbers), at, -1)
        left = np.flatnonzero((out_at < 0) & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.slots[slot[left]]
            same = (at >= 0) & (self.numbers[np.maximum(at, 0)] == numbers[left])
            out_at[left[same]] = at[same]
            left = left[~same & (at >= 0)]
        out = self.rows[np.maximum(out_at, 0)]
        new = out_at < 0
        if new.any():
            distinct, back = np.unique(numbers[new], return_inverse=True)
            out[new] = compute(distinct)[back]
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language number, text) -> (language, order, gram, n), added up within a batch."""
    for b in batches:
        language = b.column(0).to_numpy(zero_copy_only=False)
        texts = b.column(1).to_pylist()
        for l in np.unique(language):
            mine = [np.frombuffer(START + texts[i], np.uint8).astype(np.int64) for i in np.flatnonzero(language == l)]
            for k in range(ORDER + 1):
                grams, n = np.unique(np.concatenate([keys(t, k) for t in mine]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), l), pa.int32()), pa.array(np.full(len(grams), k), pa.int32()),
                     pa.array(grams), pa.array(n, pa.int64())], names=["language", "order", "gram", "n"])


def trained(labelled: DataFrame, sample: int = SAMPLE_BYTES) -> tuple[list[str], Trees | None]:
    """(id, text, lang) -> languages, in code-point order, and their trees.

    Every language gets an equal part of ``sample`` bytes: whole texts, those
    with the smallest hash of id and text, at least one.  Repeated rows count
    once.  Null or empty texts and null languages are not learned from."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null and text <> ''").select(
        "lang", F.col("text").cast("binary").alias("text"), F.octet_length("text").alias("size"),
        F.xxhash64(F.col("id").cast("string"), "text").alias("hash"))
    of = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).limit(MOST_LANGUAGES + 1).collect()
    if len(of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not of:
        return [], None
    names = sorted((r["lang"] for r in of), key=lambda s: s.encode("utf-8", "surrogatepass"))
    part = sample // len(names)
    # the hash below which about four times the part lies, and then, exactly, the one at which the part ends
    near = [(r["lang"], names.index(r["lang"]), min(2 ** 63 - 1, int(max(4 * part / r["bytes"], 64 / r["rows"]) * 2 ** 64) - 2 ** 63))
            for r in of]
    near = F.broadcast(spark.createDataFrame(near, "lang string, language int, high long"))
    order = Window.partitionBy("language").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    ends = (rows.join(near, "lang").where("hash <= high").select("language", "hash", "size").distinct()
            .withColumn("upto", F.sum("size").over(order)).where((F.col("upto") <= part) | (F.col("upto") == F.col("size")))
            .groupBy("language").agg(F.max("hash").alias("end")).collect())
    ends = F.broadcast(spark.createDataFrame([(names[r["language"]], r["language"], r["end"]) for r in ends],
                                             "lang string, language int, end long"))
    chosen = rows.join(ends, "lang").where("hash <= end").groupBy("language", "hash").agg(F.first("text").alias("text"))
    counted = (chosen.select("language", "text").mapInArrow(_counted, "language int, order int, gram long, n long")
               .groupBy("language", "order", "gram").agg(F.sum("n").alias("n")))
    found = counted.toArrow()          # at most ORDER + 1 grams for each byte of the sample
    language, which, gram, n = (found.column(c).to_numpy() for c in ("language", "order", "gram", "n"))
    counts = []
    for k in range(ORDER + 1):
        mine = which == k
        distinct, at = np.unique(gram[mine], return_inverse=True)
        table = np.zeros((len(distinct), len(names)), np.int64)
        table[at, language[mine]] = n[mine]
        counts.append((distinct, table))
    return names, Trees(counts)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               sample: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (code length under the predicted
    language): one row for each row of ``docs``.

    Trees are learned from the rows whose id's CRC-32 (as text) leaves another
    remainder than 2 by 4; the others are held out.  A row without an id is not
    held out and not learned from.  ``score`` is the predicted language's share
    of the probabilities of the text under all languages; ties go to the
    smallest name.  Texts that are null or have no letter, and all texts if
    there is nothing to learn from, get ``und`` with score 0 and null bits.
    Repeated rows stay, other columns are not read, an empty table gives an
    empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names, trees = trained(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                           .where(~_held(F.col("id"))), sample)
    sent = spark.sparkContext.broadcast(trees)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lettered = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            texts = b.column(2).to_pylist()
            lang, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            rows = np.flatnonzero(lettered) if sent.value is not None else []
            if len(rows):
                cost = sent.value.score([texts[i] for i in rows])
                best = cost.argmin(1)
                least = cost[np.arange(len(rows)), best]
                share = 1 / np.exp2(np.minimum(least[:, None] - cost, 0)).sum(1)
                for i, l, s, c in zip(rows.tolist(), best.tolist(), share.tolist(), least.tolist()):
                    lang[i], score[i], bits[i] = names[l], s, c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
                         T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("bits", T.DoubleType())])
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_held(F.col(id_col)), F.lit(False)).alias("held_out"),
                       text.cast("binary").alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered")
                       ).mapInArrow(predicted, kind)
