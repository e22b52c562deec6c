"""Spelling variants by asymmetric q-chunks.

Two words are near if one edit (a code point inserted, deleted or replaced)
turns one into the other.  Of such a pair the shorter word (of equally long
ones either) contributes its two disjoint chunks, its first and its second
half, each with its position; the other contributes the positional grams that
can equal a chunk of a word as long as itself or one shorter.  One edit spoils
one chunk only, so the other one is found in both words, shifted by one place
at most.  Words meet in a join by chunk and are verified by edit distance.

A chunk that very many words share is too weak a key.  Its words are cut again:
the half that is not the chunk is halved, and the part of it that the edit
leaves alone makes the chunk longer, until a key has few words or leaves a
single code point open.  Every pair is still found, candidates stay in
proportion to the words, and no group is compared whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches, stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
SPOILT = 31                  # one in so many runs of a document loses a code point
STRONGER = 10                # a form is so many times as frequent as its variant
PAIRS_PER_WORD = 4           # candidates of a key, as a multiple of its words, beyond which its words are cut again
HELD_WORDS = 200_000         # distinct words that a task counts before it passes them on

_RUN = re.compile(rb"[A-Za-z\xC0-\xFF]{%d,}" % LEAST_LENGTH)


def words_of(doc_id: str | None, text: str | None) -> Counter:
    """The words of a text (in Latin-1, one byte a code point) and how often
    they occur.  Runs that are too short as they stand stay so."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # code points beyond Latin-1 end a run, as the question mark that replaces them does
    for run, n in Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % SPOILT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (word, n), added up as far as memory is bounded."""
    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()),
                                           pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.update(words_of(doc_id, text))
            if len(held) > HELD_WORDS:
                yield out()
                held = Counter()
    if held:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of all texts with their occurrences, at least two."""
    bounded_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
            .mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def _keyed(rows: DataFrame) -> DataFrame:
    """(word, n, length, longer, lo, hi) with the key of what lies around the
    open places lo to hi of a chunk word of that length.  Equal hashes of
    different keys only add candidates."""
    return rows.withColumn("key", F.xxhash64(
        "length", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("substring(word, hi + longer + 1)")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n) -> a, a_n, b, b_n: every pair of near words once, a the
    shorter one or, of equally long ones, the smaller one."""
    # a word as chunk word and as the other of equal length (longer = 0), and as the other that is one longer
    sized = words.select("word", "n", F.length("word").alias("chars"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    halves = sized.withColumn("length", F.col("chars") - F.col("longer")).drop("chars")
    half = F.floor(F.col("length") / 2).cast("int")
    rows = halves.withColumn("open", F.explode(F.array(
        F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("length").alias("hi")))))
    rows = rows.select("word", "n", "length", "longer", F.col("open.lo").alias("lo"), F.col("open.hi").alias("hi"))
    found = None
    while True:
        keyed = stored(_keyed(rows), "variants-keys")
        sizes = keyed.groupBy("key").agg(F.count(F.when(F.col("longer") == 0, 1)).alias("chunks"), F.count("*").alias("all"))
        sizes = sizes.where("chunks > 0 and all > 1")
        many = F.col("chunks") * F.col("all") > PAIRS_PER_WORD * F.col("all") + 16
        marked = stored(keyed.join(sizes, "key").withColumn("again", many & (F.col("hi") - F.col("lo") > 1))
                        .drop("chunks", "all"), "variants-marked")
        few = marked.where("not again")
        a = few.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = few.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        pairs = (a.join(b, "key").where("longer = 1 or a < b").where(F.levenshtein("a", "b", 1) == 1)
                 .select("a", "a_n", "b", "b_n"))
        found = pairs if found is None else found.unionByName(pairs)
        again = marked.where("again")
        if again.isEmpty():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = again.withColumn("open", F.explode(F.array(
            F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi"))))).select(
            "word", "n", "length", "longer", F.col("open.lo").alias("lo"), F.col("open.hi").alias("hi"))
    # both chunks of a pair survive if the edit lies between them
    return found.distinct()


def _roots(forms: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(word, form) -> (word, root), by pointer doubling.  A form is ten times as
    frequent as its word, so chains are short and have no circle."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max_rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(at.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word of the texts: word, form (its most frequent near
    word, if that is ten times as frequent, ties to the smaller one), root (the
    end of the chain of forms), n, n_near, form_n.

    Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count as often as they stand; other columns are not read.  An
    empty table gives an empty result."""
    words = stored(vocabulary(docs, id_col, text_col), "variants-words")
    pairs = stored(near_pairs(words), "variants-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"),
                                         F.col("a_n").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"),
                                         F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= STRONGER * F.col("n")
    forms = stored(best.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"),
                               F.when(strong, -F.col("best.less")).alias("form_n")), "variants-forms")
    roots = _roots(forms.where("form is not null"))
    return (words.join(forms, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
