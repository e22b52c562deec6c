"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by splitting clusters in two until
none holds more than its fair share, so lists are balanced.  Every vector is
indexed: it goes into the list of its nearest centroid and, if it lies near a
boundary, into a further one whose centroid is at most ``REPLICATE`` times as far
(``COPIES`` lists at most).  Centroids are found through an in-memory graph of
centroids by best-first search.  A query opens the lists whose centroid is at
most ``PROBE`` times as far as the nearest one, however many they are: few where
vectors form clusters, many where they lie evenly.

Lists and queries meet in a join by list.  A list with very many vectors is
dealt out over several parts, its queries to each of them, so a hot vector or
list is no single task.  Distances are computed on the original vectors in
double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.llm.common import stored

NEIGHBOURS = 10
SAMPLE = 20_000             # vectors that fit the centroids
MOST_LISTS = 1024           # bounds the centroids, which every task holds
PER_LIST = 48               # sample vectors of a list
DEGREE, BEAM = 24, 64       # edges of a centroid, and how many the search keeps
COPIES, REPLICATE = 2, 1.06
PROBE, LEAST_PROBES = 1.18, 4
PART_ROWS = 4096            # vectors of a list that one part holds on average
QUERY_BLOCK = 256


def fit_centroids(x: np.ndarray, per_list: int = PER_LIST, most: int = MOST_LISTS, seed: int = 7) -> np.ndarray:
    """Centroids of clusters that hold ``per_list`` sample vectors at most.
    A cluster is split by two-means and cut at the median of the difference of
    the two distances, so that both halves get the same number; then a few
    rounds of Lloyd's algorithm."""
    x = np.unique(x, axis=0)                # copies of one vector need one centroid
    rng = np.random.default_rng(seed)
    limit = max(per_list, -(-len(x) // most) * 2)
    parts, done = [np.arange(len(x))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= limit:
            done.append(rows)
            continue
        v = x[rows]
        c = v[rng.choice(len(v), 2, replace=False)]
        for _ in range(8):
            side = ((v - c[0]) ** 2).sum(1) > ((v - c[1]) ** 2).sum(1)
            if side.all() or not side.any():
                break
            c = np.stack([v[~side].mean(0), v[side].mean(0)])
        order = np.argsort(((v - c[0]) ** 2).sum(1) - ((v - c[1]) ** 2).sum(1), kind="stable")
        half = len(rows) // 2
        parts += [rows[order[:half]], rows[order[half:]]]
    c = np.stack([x[r].mean(0) for r in done])
    for _ in range(4):
        near = np.concatenate([distances(x[at:at + 1024], c).argmin(1) for at in range(0, len(x), 1024)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, by one matrix product."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


class CentroidGraph:
    """Nearest centroids by best-first search on a graph: every centroid is
    linked to its ``DEGREE`` nearest ones, in both directions, and entries are
    spread over the centroids."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float64)
        n = len(self.c)
        near = [set() for _ in range(n)]
        for at in range(0, n, 1024):
            d = distances(self.c[at:at + 1024], self.c)
            for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :DEGREE + 1], at):
                for j in row.tolist():
                    if j != i:
                        near[i].add(j)
                        near[j].add(i)
        self.edges = [np.array(sorted(s), np.int64) for s in near]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, v: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the k nearest, nearest first."""
        beam = max(beam, k)
        seen = np.zeros(len(self.c), bool)
        seen[self.entries] = True
        d = ((self.c[self.entries] - v) ** 2).sum(1)
        found = sorted(zip(d.tolist(), self.entries.tolist()))
        best = [(-x, i) for x, i in found[:beam]]
        heapq.heapify(best)
        heapq.heapify(found)
        while found:
            x, i = heapq.heappop(found)
            if len(best) >= beam and x > -best[0][0]:
                break
            new = self.edges[i][~seen[self.edges[i]]]
            if not len(new):
                continue
            seen[new] = True
            for x, j in zip(((self.c[new] - v) ** 2).sum(1).tolist(), new.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(found, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(found, (x, j))
        out = sorted((-x, i) for x, i in best)[:k]
        return np.array([i for _, i in out]), np.array([x for x, _ in out])


_graphs: dict[bytes, CentroidGraph] = {}


def _graph(centroids: np.ndarray) -> CentroidGraph:
    """One graph per worker process and set of centroids."""
    key = centroids.tobytes()
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = CentroidGraph(centroids)
    return _graphs[key]


def _near_lists(graph: CentroidGraph, v: np.ndarray, least: int, ratio: float, most: int | None) -> np.ndarray:
    """The lists of a vector: those within the ratio of the nearest one's
    distance, ``least`` at least and ``most`` at most, nearest first."""
    k = most or 4 * least
    while True:
        near, d = graph.search(v, k)
        n = int(np.searchsorted(d, ratio * ratio * d[0] + 1e-12, side="right"))
        if most or n < len(d) or len(d) == len(graph.c):
            return near[:max(least, n)]
        k *= 2                       # all that was found lies within the ratio: look further


def _lists(centroids: np.ndarray, least: int, ratio: float, most: int | None = None):
    """(vec_id, vec) batches -> (list, vec_id, vec) for a vector's lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = _graph(centroids)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                vectors = np.asarray(part.column(1).flatten(), np.float64)
                vectors = vectors.reshape(part.num_rows, -1)
                found = [_near_lists(graph, v, least, ratio, most) for v in vectors]
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
                out = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int32()), out.column(0), out.column(1)],
                                                 names=["list", "vec_id", "vec"])
    return run


def _nearest(k: int):
    def run(_, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """A part of a list and its queries -> every query's k nearest in it."""
        out = []
        if len(vectors) and len(queries):
            x, ids = np.stack(vectors["vec"].to_numpy()).astype(np.float64), vectors["vec_id"].to_numpy()
            q, q_ids = np.stack(queries["vec"].to_numpy()).astype(np.float64), queries["vec_id"].to_numpy()
            for at in range(0, len(q), QUERY_BLOCK):
                d = distances(q[at:at + QUERY_BLOCK], x)
                for i, (row, own) in enumerate(zip(d, q_ids[at:at + QUERY_BLOCK]), at):
                    other = np.flatnonzero(ids != own)
                    if not len(other):
                        continue
                    # the matrix product's rounding must not decide: all about as near as the k-th are computed exactly
                    near = row[other]
                    edge = np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1]
                    other = other[near <= edge + 1e-9 * (1 + (q[i] * q[i]).sum())]
                    exact = np.sqrt(((x[other] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[other], exact))[:k]
                    out.append(pd.DataFrame({"query_id": own, "vec_id": ids[other][best], "score": exact[best]}))
        if not out:
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64),
                                 "score": np.array([], np.float64)})
        return pd.concat(out)
    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part: an id, and a vector
    of the commonest length without null or non-finite components that is not
    zero.  Of rows that repeat id and vector one stays."""
    v = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
         .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
                & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                & F.exists("vec", lambda x: x != 0)))
    lengths = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    return v.where(F.size("vec") == dim).dropDuplicates(["vec_id", "vec"])


def search(vectors: DataFrame, queries, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every
    query, ties to the smaller id.  ``queries``: a condition on vec_id that
    marks the rows of ``vectors`` to search for.

    All rows are candidates but a query's own id.  Vectors that are null,
    zero, of an odd length or hold null or non-finite components take no part,
    neither do null ids; if an id has several vectors the nearest counts, and a
    query id with several vectors keeps the best of all.  With fewer than k
    candidates all of them are returned; an empty table gives an empty result.
    """
    v = stored(usable(vectors, id_col, vec_col), "postings-vectors")
    fitted = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()   # at most ``sample``
    result = "query_id long, vec_id long, score double"
    if not fitted:
        found = v.sparkSession.createDataFrame([], result)
    else:
        centroids = fit_centroids(np.array([r["vec"] for r in fitted], np.float64))
        spread = "list int, vec_id long, vec array<double>"
        lists = v.mapInArrow(_lists(centroids, 1, REPLICATE, COPIES), spread)
        index = stored(lists, "postings-index")
        asked = v.where(queries(F.col("vec_id"))).mapInArrow(
            _lists(centroids, LEAST_PROBES, PROBE), spread)
        # at most MOST_LISTS + 1 rows; a list's parts hold about PART_ROWS vectors each
        parts = F.broadcast(stored(index.groupBy("list").agg(
            F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("parts")), "postings-parts"))
        dealt = index.join(parts, "list").select(
            "list", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "vec")
        sent = asked.join(parts, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "vec")
        found = (dealt.groupBy("list", "part").cogroup(sent.groupBy("list", "part"))
                 .applyInPandas(_nearest(k), result))
    # a vector may be found in several lists
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
