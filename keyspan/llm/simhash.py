"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits; two link if they differ in at most ``THRESHOLD``
bits.  Of two such fingerprints one 32-bit half differs in at most
``THRESHOLD // 2`` = 1 bit.  Every half is covered by anchors: its first 31
bits by the codewords of the Hamming code [31, 26], a perfect code with covering
radius 1, and its last bit as it is.  A fingerprint is at home at the anchor
within radius 1 and is replicated to every anchor within covering radius plus
the half's threshold, that is distance 2 (17 on average).  If x and y differ in
one bit of a half, y is within 2 of x's home, so comparing homes with replicas
per anchor finds every link.

Only distinct fingerprints take part, so copies cost nothing.  An anchor with
very many homes is split by the four bytes of the other half: two fingerprints
that differ in at most three bits agree in one of them.  Per anchor a spanning
forest of the links is kept instead of all pairs (a link of each replica, and
those that join homes).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches, stored
from keyspan.llm.components import components

SHINGLE, SEED, THRESHOLD = 3, 42, 3
HASH_BLOCK = 1 << 16         # shingles whose bits are counted at once
HOT_HOMES = 2048             # homes of an anchor beyond which it is split ...
HOT_ANCHORS = 10_000         # ... and the most anchors that can be split so (the bound of what is broadcast)
COMPARE_BLOCK = 1 << 22      # pairs compared at once


def fingerprint_of(text: str | None) -> int:
    """The unsigned SimHash of a text: A-Z lower-cased, words shingled by
    three (fewer words: the whole sequence), XXH64 with seed 42, a bit set if
    it is set in over half the shingles; 0 without words."""
    import xxhash
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(SHINGLE)])) if len(w) >= SHINGLE else iter([b" ".join(w)])
    total, n = np.zeros(64, np.int64), max(1, len(w) - SHINGLE + 1)
    left = n
    while left:
        size = min(left, HASH_BLOCK)
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, size)), "<u8", size)
        bits = np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
        left -= size
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash as a (signed) long; only the text passes through Python."""
    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return simhash(text)


def _syndromes(half: np.ndarray) -> np.ndarray:
    """The Hamming [31, 26] syndrome of the first 31 bits: the XOR of the
    (1-based) positions of the set bits, 0 for a codeword."""
    s = np.zeros(len(half), np.int64)
    for j in range(31):
        s ^= np.where((half >> j) & 1, j + 1, 0)
    return s


def home(half: np.ndarray) -> np.ndarray:
    """The one anchor within distance 1 of each 32-bit half."""
    s = _syndromes(half)
    return np.where(s, half ^ (1 << (np.maximum(s, 1) - 1)), half)


def _pairs_with_syndrome() -> np.ndarray:
    """[s] -> masks of two positions whose XOR is s (15 for every s above 0)."""
    out = np.zeros((32, 15), np.int64)
    for s in range(1, 32):
        out[s] = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s][:15]
    return out


def replicas(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within distance 2 of each half: in the
    first 31 bits distance 0, 1 or 2 with the last bit equal, or at most 1 with
    the last bit flipped."""
    s = _syndromes(half)
    rows = np.arange(len(half))
    near = home(half)
    off = s > 0                                  # at distance 1; the others are codewords
    two = half[off, None] ^ _PAIRS[s[off]]       # codewords at distance 2
    return (np.concatenate([rows, rows, np.repeat(rows[off], two.shape[1])]),
            np.concatenate([near, near ^ (1 << 31), two.ravel()]))


_PAIRS = _pairs_with_syndrome()


def _halves(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u & np.uint64(0xFFFFFFFF)).astype(np.int64), (u >> np.uint64(32)).astype(np.int64)]


def _batch(key, fp, is_home) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(is_home, pa.bool_())],
                                      names=["anchor", "fp", "home"])


def _cover(batches: Iterator[pa.RecordBatch], homes: bool, others: bool) -> Iterator[pa.RecordBatch]:
    """fp -> (anchor, fp, home); an anchor's key is its half's number and code."""
    for b in batches:
        all_fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(all_fp), 10_000):
            fp = all_fp[at:at + 10_000]
            for number, half in enumerate(_halves(fp)):
                if homes:
                    yield _batch((number << 32) | home(half), fp, np.ones(len(fp), bool))
                if others:
                    rows, anchor = replicas(half)
                    yield _batch((number << 32) | anchor, fp[rows], np.zeros(len(rows), bool))


def _linked(homes: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between an anchor's homes and replicas that connect what all its
    links connect: one for every replica that has any, and one for every home
    that joins another home's tree.  Pairs are compared in blocks."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    # the first home that each replica is near to; it stands for all pairs of that replica
    first = np.full(len(others), -1)
    step = max(1, COMPARE_BLOCK // max(1, len(others)))
    for at in range(0, len(homes), step):
        h = homes[at:at + step]
        near = np.bitwise_count((h[:, None] ^ others[None, :]).view(np.uint64)) <= THRESHOLD
        near &= h[:, None] != others[None, :]
        new = near.any(axis=0) & (first < 0)
        first[new] = at + near[:, new].argmax(axis=0)
        i, j = np.nonzero(near)
        # homes that share a replica are linked through it, once for each pair of a home and a first home
        _, once = np.unique((i + at) * len(homes) + first[j], return_index=True)
        for i, j in zip(i[once].tolist(), j[once].tolist()):
            ra, rb = root(at + i), root(int(first[j]))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                yield int(h[i]), int(others[j])
    for j in np.flatnonzero(first >= 0).tolist():
        yield int(homes[first[j]]), int(others[j])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links.  A key that runs over several batches is
    carried on; a task holds one key's fingerprints at a time."""
    def links(key, fp, is_home):
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(key)]
        if not len(starts):
            return []
        homes = np.add.reduceat(is_home.astype(np.int64), starts)
        found = []
        # a home alone with its own replica has nothing to link to
        for i in np.flatnonzero((homes > 0) & (ends - starts > 2)):
            a, b = starts[i], ends[i]
            mine = is_home[a:b]
            found += _linked(fp[a:b][mine], fp[a:b][~mine])
        return found

    def out(found):
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = None
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(zero_copy_only=False),
                        batch.column(1).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
        fp = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        is_home = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        if held is not None:
            key, fp, is_home = (np.concatenate(x) for x in zip(held, (key, fp, is_home)))
        if not len(key):
            continue
        cut = np.searchsorted((key != key[-1]).any(axis=1)[::-1], True)   # rows of the last key
        cut = len(key) - cut
        yield out(links(key[:cut], fp[:cut], is_home[:cut]))
        held = (key[cut:], fp[cut:], is_home[cut:])
    if held is not None:
        yield out(links(*held))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) with the same components as
    all pairs that differ in at most ``THRESHOLD`` bits."""
    spread = "anchor long, fp long, home boolean"
    total = fps.count()
    least = max(HOT_HOMES, 2 * total // HOT_ANCHORS)
    hot = (fps.mapInArrow(lambda b: _cover(b, True, False), spread).groupBy("anchor").count()
           .where(F.col("count") > least).select("anchor"))
    hot = stored(hot, "simhash-hot")             # at most HOT_ANCHORS rows, as there are 2 * total homes
    covered = fps.mapInArrow(lambda b: _cover(b, True, True), spread)
    covered = covered.join(F.broadcast(hot.withColumn("split", F.lit(True))), "anchor", "left")
    other = F.when(F.col("anchor") < (1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    # byte k of the other half, for k in 0..3; anchors that are not hot keep one part
    parts = F.when(F.col("split"), F.array(*[
        F.lit(256 * k) + F.shiftright(other, 8 * k).bitwiseAND(255) for k in range(4)])).otherwise(F.array(F.lit(-1).cast("long")))
    keyed = covered.select("anchor", F.explode(parts).alias("part"), "fp", "home")
    return (keyed.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
            .mapInArrow(_compare, "a long, b long"))


def _components(marked: DataFrame) -> DataFrame:
    """Stored rows (doc_id, fp and others) -> the same with component_id (the
    smallest id that links reach) and root (the component's smallest
    fingerprint)."""
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    trees = stored(links(classes.select("fp")), "simhash-links")
    rooted = stored(classes.join(components(trees).withColumnRenamed("node", "fp"), "fp"), "simhash-members")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("linked_first"))
    linked = rooted.join(smallest, "root").select("fp", "root", "linked_first")
    labelled = classes.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("linked_first")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"))
    return marked.join(labelled, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (the signed fingerprint), component_id
    (the smallest id that links reach from the row's text) and root (the
    smallest fingerprint of the component).

    Null and empty texts have fingerprint 0 and link like any other.  Repeated
    rows stay; rows with a null id have a component like any other, and
    component_id is null only if no row of the component has an id.  An empty
    table gives an empty result.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    marked = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")),
                    "simhash-fingerprints")
    return _components(marked).select("doc_id", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of every component one
    row, that of its smallest id (of repeated rows one).  An id may stand on
    rows of several components: each keeps a row of its own.  A component whose
    rows all lack an id keeps one of them, too.  A column that begins with
    ``sh_`` raises ``ValueError``.

    The rows are written once with a row number and their fingerprint.  What
    stays is decided on those narrow columns; then the texts are shuffled once,
    at any size, to meet the numbers of the rows that stay."""
    if clash := [c for c in docs.columns if c.lower().startswith("sh_")]:
        raise ValueError(f"columns {clash} begin with sh_, which the operator uses itself")
    bounded_batches(docs.sparkSession)
    rows = stored(docs.withColumn("sh_row", F.monotonically_increasing_id())
                  .withColumn("sh_fp", fingerprint(F.col(text_col))), "simhash-rows")
    found = _components(rows.select(F.col(id_col).alias("doc_id"), F.col("sh_fp").alias("fp"), "sh_row"))
    # one row of each component: among those of the smallest id (of all, if none has an id) the first
    first = found.where("doc_id <=> component_id").groupBy("root").agg(F.min("sh_row").alias("sh_row"))
    keep = stored(first.select("sh_row"), "simhash-kept")
    return rows.join(keep.hint("merge"), "sh_row", "left_semi").select(*docs.columns)
