"""Sharding by a k-d tree over document metadata.

The table is split recursively at weighted medians (weight: a document's bytes)
along the metadata dimension that is widest in the node, until the leaves hold
the target bytes.  A median is found without sorting: bytes are summed in
``BINS`` equal bins of the node's key range, the bin in which the quantile
falls is cut into bins again, and so on until that bin is within the tolerance.
All nodes of a level share one aggregation per step, and the driver only sees
(nodes x BINS) sums.

A dimension's key is its coordinate (``COORD_BITS`` bits) followed by a
tie-breaker from the text's checksum, the id's hash and a number that tells
equal rows apart.  A median therefore may cut through a coordinate that many
rows share (a source with a third of all rows) and through a row that is
repeated as often, and equal texts stay neighbours when it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import stored

SHARDS = 24
BINS = 4096
COORD_BITS, TIE_BITS = 20, 42
TEXT_TIE, ID_TIE, ROW_TIE = 20, 10, 12      # bits of the tie-breaker
TOLERANCE = 0.0005        # of a shard's target bytes
SLOT_ROWS = 50_000        # rows that one numbering group holds on average
DIMENSIONS = ("size", "lang", "source", "doc_id")


def _coordinates(meta: DataFrame) -> DataFrame:
    """Adds k_<dimension>: numbers are scaled to their range over the table,
    strings go by their hash, nulls to the lowest coordinate."""
    top = (1 << COORD_BITS) - 1
    lo_hi = meta.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("size", "doc_id") for f in (F.min, F.max)]).first()

    def scaled(c: str) -> Column:
        lo, hi = lo_hi[f"min_{c}"], lo_hi[f"max_{c}"]
        if lo is None or lo == hi:
            return F.lit(0).cast("long")
        x = (F.col(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
        return F.coalesce(F.floor(x * top), F.lit(0)).cast("long")

    def hashed(c: str) -> Column:
        return F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(top)) + 1).cast("long")

    tie = (F.shiftleft(F.col("text_crc32").bitwiseAND((1 << TEXT_TIE) - 1), ID_TIE + ROW_TIE)
           .bitwiseOR(F.shiftleft(F.xxhash64("doc_id").bitwiseAND((1 << ID_TIE) - 1), ROW_TIE))
           .bitwiseOR(F.col("row").bitwiseAND((1 << ROW_TIE) - 1)))
    coords = {"size": scaled("size"), "doc_id": scaled("doc_id"), "lang": hashed("lang"), "source": hashed("source")}
    return meta.select("doc_id", "size", "text_crc32", "row",
                       *[F.shiftleft(coords[d], TIE_BITS).bitwiseOR(tie).alias(f"k_{d}") for d in DIMENSIONS])


class _Node:
    """A node of the tree: the shards below it and, once split, its cut."""

    def __init__(self, first: int, n: int):
        self.first, self.n, self.kids = first, n, None
        self.dim, self.cut = None, None

    def split(self, dim: str, cut: int) -> list[_Node]:
        self.dim, self.cut = dim, cut
        left = self.n // 2
        self.kids = [_Node(self.first, left), _Node(self.first + left, self.n - left)]
        return self.kids

    def label(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if not self.kids:
            return F.lit(self.first)
        return F.when(F.col(f"k_{self.dim}") < F.lit(self.cut), self.kids[0].label()).otherwise(self.kids[1].label())


def build_tree(points: DataFrame, shards: int = SHARDS) -> _Node:
    """Splits level by level; every level takes one aggregation for the nodes'
    extents and a few for their medians."""
    root = _Node(0, shards)
    level = [root]
    total = points.agg(F.sum("size")).first()[0] or 0
    tolerance = TOLERANCE * total / shards
    while level := [x for x in level if x.n > 1]:
        at = root.label()
        extents = points.groupBy(at.alias("node")).agg(
            F.sum("size").alias("bytes"),
            *[f(f"k_{d}").alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).collect()
        by_first = {r["node"]: r for r in extents}
        search, below = {}, []
        for x in level:
            r = by_first.get(x.first)
            if r is None:                       # no rows: any cut will do
                below += x.split(DIMENSIONS[0], 0)
                continue
            dim = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] >> TIE_BITS) - (r[f"min_{d}"] >> TIE_BITS))
            search[x.first] = [x, dim, r[f"min_{dim}"], r[f"max_{dim}"] + 1, r["bytes"] * (x.n // 2) / x.n]
        while search:
            per = lambda f: F.element_at(F.create_map(*[
                F.lit(v) for first, x in search.items() for v in (first, f(x))]), F.col("node"))
            bins = (points.withColumn("node", at)
                    .select("node", "size", F.get(F.array(*[f"k_{d}" for d in DIMENSIONS]),
                                                  per(lambda x: DIMENSIONS.index(x[1]))).alias("key"),
                            per(lambda x: x[2]).cast("long").alias("lo"), per(lambda x: x[3]).cast("long").alias("hi"))
                    .where("key >= lo and key < hi")
                    .withColumn("bin", F.expr(f"(key - lo) div greatest(1, (hi - lo + {BINS - 1}) div {BINS})"))
                    .groupBy("node", "bin").agg(F.sum("size").alias("n")).collect())
            per_node = {}
            for r in bins:
                per_node.setdefault(r["node"], []).append((r["bin"], r["n"]))
            for first in list(search):
                x, dim, a, b, want = search[first]
                step = max(1, -(-(b - a) // BINS))
                got, cut, rest = 0, b, None
                for i, n in sorted(per_node.get(first, [])):
                    lo_i, hi_i = a + i * step, min(b, a + (i + 1) * step)
                    if got + n > want:
                        if step == 1 or n <= tolerance:
                            cut = hi_i if got + n - want < want - got else lo_i
                        else:
                            rest = (lo_i, hi_i, want - got)
                        break
                    got += n
                if rest:
                    search[first][2:] = rest
                else:
                    below += x.split(dim, cut)
                    del search[first]
        level = below
    return root


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and
    slot (gapless from 0 in each shard), one row per input row.

    Null texts count as empty; null ids, languages and sources sort lowest.
    Repeated rows stay neighbours; where a median cuts through them they fall on
    both sides, told apart by a hash of their place in the table.  With fewer rows than
    shards some shards stay empty; an empty table gives an empty result.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                              F.col(source_col).alias("source"),
                              (F.octet_length(text) + 8).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.xxhash64(F.monotonically_increasing_id()).alias("row")), "kd-meta")
    points = stored(_coordinates(meta), "kd-points")
    root = build_tree(points, shards)
    groups = max(1, meta.count() // (shards * SLOT_ROWS))
    placed = points.select(
        "doc_id", "size", "text_crc32", root.label().cast("int").alias("shard"),
        "row",
        F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).cast("int").alias("grp"))
    # slots: numbered inside small groups, plus the rows of the shard's earlier groups
    counts = placed.groupBy("shard", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "grp").orderBy("doc_id", "text_crc32", "size", "row")
    return (placed.withColumn("at", F.row_number().over(inside) - 1).join(start, ["shard", "grp"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("start")).cast("long").alias("slot")))
