"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

A token's class is its rank among the ``CLASSES`` most frequent training tokens
or the class of all others.  The model predicts a class from the two before it:

    s(w | u, v) = q_w . (R_u * a + R_v * b) + bias_w

with class vectors R, target vectors q and diagonal position weights a, b.
Texts are split and looked up once; what training and scoring read again is a
table of class numbers, two bytes a token.

Every training document is used.  The training partitions run stochastic
gradient steps of noise-contrastive estimation on their own tokens, all from
the same start; their parameters are averaged by tokens in a grouped Spark
aggregation, block by block, and the next round begins with the average.

Exponentiated scores factor into a term for u and a term for v, so the
normalisers of all context pairs are one matrix product, and probabilities are
exactly normalised.  A token outside the frequent ones has its class's
probability times its share of that class's smoothed counts.  Those counts
(and all others) cover the whole corpus: frequent tokens are looked up in a
table of bounded size, the others meet their counts in a join by token.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches, stored

CLASSES = 2048              # frequent tokens that the neural model knows, the end first; 16 bits must hold them
FREQUENT = 131_072          # frequent tokens whose counts are looked up in memory
DIM = 16
NOISE = 64                  # noise classes shared by a minibatch
BATCH = 4096
ROUNDS = 2
RATE = 0.25                 # of the Adagrad steps
COUNT_FLUSH = 400_000       # distinct tokens that a counting task holds
BLOCK = 128                 # rows of a parameter block
END = b""                   # the end token: no word is empty
FOLDS, HELD = 5, 1


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 1; null ids train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---- counts ---------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                       names=["token", "n"])
        held.clear()
        return b

    for batch in batches:
        for text in batch.column(0):
            held.update(tokens(text.as_py()))
            held[END] += 1
            if len(held) > COUNT_FLUSH:
                yield out()
    yield out()


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary), n: over all documents, each followed by one end; tasks
    count their own texts first."""
    return (docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "token binary, n long")
            .groupBy("token").agg(F.sum("n").alias("n")))


# ---- model ----------------------------------------------------------------------

class Model:
    """Parameters, and log-probabilities of classes after two classes."""

    def __init__(self, classes: int, unigram: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.r = (rng.standard_normal((classes, DIM)) * 0.1).astype(np.float32)
        self.q = (rng.standard_normal((classes, DIM)) * 0.1).astype(np.float32)
        self.a = np.ones(DIM, np.float32)
        self.b = np.full(DIM, 0.5, np.float32)
        self.bias = np.log(unigram).astype(np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([self.r, self.q, np.stack([self.a, self.b]),
                               np.pad(self.bias, (0, -len(self.bias) % DIM)).reshape(-1, DIM)]).astype(np.float32)

    def unpack(self, rows: np.ndarray) -> Model:
        n = len(self.bias)
        self.r, self.q = rows[:n].copy(), rows[n:2 * n].copy()
        self.a, self.b = rows[2 * n].copy(), rows[2 * n + 1].copy()
        self.bias = rows[2 * n + 2:].reshape(-1)[:n].copy()
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, log normaliser): near[v, w] + far[u, w] - norm[v, u] is
        log p(w | u, v).  The normalisers are one matrix product."""
        near = (self.r * self.a) @ self.q.T + self.bias
        far = (self.r * self.b) @ self.q.T
        hi, lo = near.max(1, keepdims=True), far.max(1, keepdims=True)
        norm = np.log(np.exp(near - hi) @ np.exp(far - lo).T) + hi + lo.T
        return near, far, norm.astype(np.float32)


class Trainer:
    """Minibatches of noise-contrastive estimation with Adagrad.  The noise is
    the unigram distribution; a minibatch shares its noise classes."""

    def __init__(self, model: Model, unigram: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.log_noise = np.log(unigram).astype(np.float32)
        self.cumulative = np.cumsum(unigram)
        self.g = {k: np.full_like(getattr(model, k), 0.1) for k in ("r", "q", "a", "b", "bias")}

    def _step(self, name: str, rows, grad: np.ndarray):
        p, g = getattr(self.m, name), self.g[name]
        if rows is None:
            g += grad * grad
            p += RATE * grad / np.sqrt(g)
        else:
            g[rows] += grad * grad
            p[rows] += RATE * grad / np.sqrt(g[rows])

    @staticmethod
    def _summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of equal rows added up (16-bit rows sort by radix)."""
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        return r[starts], np.add.reduceat(grad[order], starts, axis=0)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        m, n = self.m, len(w)
        k = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]),
                       len(self.cumulative) - 1).astype(np.uint16)
        ru, rv, qw, qk = m.r[u], m.r[v], m.q[w], m.q[k]
        h = rv * m.a + ru * m.b
        # p(data) = s(s(w) - log(NOISE p_noise(w)))
        data = (h * qw).sum(1) + m.bias[w] - self.log_noise[w] - np.float32(np.log(NOISE))
        noise = h @ qk.T + m.bias[k] - self.log_noise[k] - np.float32(np.log(NOISE))
        with np.errstate(over="ignore"):                             # an overflow is a probability of 0
            gd = 1 / (1 + np.exp(data))                              # 1 - p
            gn = -1 / (1 + np.exp(-noise))                           # -p
        gh = (gd[:, None] * qw + gn @ qk) / n
        gq = np.concatenate([gd[:, None] * h, gn.T @ h]) / n
        gb = np.concatenate([gd, gn.sum(0)]) / n
        scale = np.float32(n / 64)                                   # steps do not shrink with the batch
        rows, both = self._summed(np.concatenate([w, k]), np.concatenate([gq, gb[:, None]], 1) * scale)
        ctx, gr = self._summed(np.concatenate([v, u]), np.concatenate([gh * m.a, gh * m.b]) * scale)
        ga, gb2 = (gh * rv).sum(0) * scale, (gh * ru).sum(0) * scale
        self._step("q", rows, both[:, :-1])
        self._step("bias", rows, both[:, -1])
        self._step("r", ctx, gr)
        self._step("a", None, ga)
        self._step("b", None, gb2)


def _contexts(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple]:
    """(u, v, w) class arrays of about a million tokens each; every text
    begins after two ends."""
    pad = np.array([end], np.uint16)             # context of the next text only, no token
    parts, size = [pad, pad], 0
    for batch in batches:
        for classes in batch.column(0):
            # the text's own end and the padding are the next text's context
            parts += [np.frombuffer(classes.as_buffer(), np.uint16), pad]
            size += len(parts[-2])
            if size > 1 << 20:
                yield _cut(parts)
                parts, size = [pad, pad], 0
    yield _cut(parts)


def _cut(parts: list[np.ndarray]) -> tuple:
    s = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    keep = np.ones(len(s), bool)
    keep[:2] = False
    keep[ends[3::2] - 1] = False                 # the paddings
    at = np.flatnonzero(keep)
    return s[at - 2], s[at - 1], s[at]


def _train(unigram: np.ndarray, start: np.ndarray, end: int, number: int):
    """Texts' classes -> blocks of the parameters that this partition ends
    with, each with the partition's number of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        model = Model(len(unigram), unigram).unpack(start)
        trainer = Trainer(model, unigram, seed=1000 * number + pid)
        total = 0
        for u, v, w in _contexts(batches, end):
            # tokens in random order, so that a minibatch mixes documents
            order = trainer.rng.permutation(len(w))
            for at in range(0, len(w), BATCH):
                part = order[at:at + BATCH]
                trainer.step(u[part], v[part], w[part])
            total += len(w)
        if total:
            rows = model.pack()
            blocks = [rows[i:i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([pid % 64] * n, pa.int32()),
                 pa.array([float(total)] * n, pa.float64()), pa.array(blocks, pa.binary())],
                names=["block", "lane", "weight", "params"])
    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block to their mean, weighted by tokens."""
    weight = rows["weight"].sum()
    total = sum(w / weight * np.frombuffer(p, np.float32).astype(np.float64)
                for w, p in zip(rows["weight"], rows["params"]))
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "lane": [0], "weight": [weight],
                         "params": [total.astype(np.float32).tobytes()]})


def train(texts: DataFrame, unigram: np.ndarray, end: int, rounds: int = ROUNDS) -> np.ndarray:
    """(classes: binary) rows, one a training text -> the parameters."""
    params = Model(len(unigram), unigram).pack()
    shape = "block int, lane int, weight double, params binary"
    for number in range(rounds):
        own = texts.mapInArrow(_train(unigram, params, end, number), shape)
        # two steps, so that no group holds a row of every partition
        lanes = own.groupBy("block", "lane").applyInPandas(_average, shape)
        blocks = sorted(lanes.groupBy("block").applyInPandas(_average, shape).collect(), key=lambda r: r["block"])
        if not blocks:
            break
        params = np.frombuffer(b"".join(r["params"] for r in blocks), np.float32).reshape(-1, DIM)
    return params


# ---- scoring --------------------------------------------------------------------

ENCODED = ("doc_id long, held_out boolean, n_tokens long, n_in long, n_other long, base_in double, other_in double, "
           "classes binary, rare array<struct<token:binary,k:int>>")
LOGS = "row long, lm double"

_tables: dict[int, tuple] = {}


def _encode(frequent: list[tuple[bytes, int]], classes: int):
    """(doc_id, held_out, text) -> the text's classes (16 bits a token) and
    what of its base needs no join: n_in frequent tokens with the sum base_in
    of log10(c + 0.5), other_in of it for those in the class of the others,
    n_other tokens in that class, and the rare tokens with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, (w, _) in enumerate(frequent)}
        rare_at, get, other = len(index), index.get, min(classes, len(index))
        logs = np.log10(np.array([n for _, n in frequent] + [0], float) + 0.5)
        shape = pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int32())]))
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.binary(), shape]
        names = [x.split()[0] for x in ENCODED.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, held, text in zip(*(batch.column(i) for i in range(3))):
                t = tokens(text.as_py())
                t.append(END)
                at = np.fromiter((get(w, rare_at) for w in t), np.int64, len(t))
                w = np.minimum(at, other)                    # frequent tokens stand in order of their classes
                inside = at < rare_at
                rare = Counter(t[i] for i in np.flatnonzero(~inside))
                rows.append((doc_id.as_py(), held.as_py(), len(t), int(inside.sum()), int((w == other).sum()),
                             float(logs[at[inside]].sum()), float(logs[at[inside & (w == other)]].sum()),
                             w.astype(np.uint16).tobytes(), [{"token": x, "k": k} for x, k in rare.items()]))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return run


def _log_probabilities(unigram: np.ndarray, params: np.ndarray, end: int):
    """(row, classes) -> lm, the sum of the classes' log10 probabilities."""
    key = zlib.crc32(params.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tables:
            _tables.clear()
            _tables[key] = Model(len(unigram), unigram).unpack(params).tables()
        near, far, norm = _tables[key]
        for batch in batches:
            sums = []
            for classes in batch.column(1):
                w = np.frombuffer(classes.as_buffer(), np.uint16).astype(np.int64)
                c = np.concatenate([[end, end], w])
                u, v = c[:-2], c[1:-1]
                sums.append(float((near[v, w].astype(np.float64) + far[u, w] - norm[v, u]).sum()) / np.log(10))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["row", "lm"])
    return run


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The end and the tokens with the highest counts, ``most`` at most, by
    falling count; a count whose tokens would not all fit is left out.  The
    least count comes from the sizes of the counts' groups, so that tasks only
    send tokens that are taken."""
    ends = counts.where(F.col("token") == F.lit(END)).collect()
    if not ends:
        return [(END, 0)]
    others = counts.where(F.col("token") != F.lit(END))
    room, least = most - 1, None
    # every group has a token, so no more than ``most`` groups can be taken
    for r in others.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.col("n").desc()).limit(most).collect():
        if r["k"] > room:
            break
        room, least = room - r["k"], r["n"]
    taken = others.where(F.col("n") >= least).collect() if least is not None else []
    found = [(bytes(r["token"]), r["n"]) for r in taken]
    return [(END, ends[0]["n"]), *sorted(found, key=lambda x: (-x[1], x[0]))]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
           classes: int = CLASSES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null and empty texts are the end token alone.  Rows with a null id train.
    Repeated rows count as often as they stand there.  Without training
    documents all counts are zero and every token shares one class.  An empty
    table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    counts = stored(token_counts(read.where("not held_out")), "lbl-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = most_frequent(counts, frequent)
    in_class = [n for _, n in common[:classes]]
    unigram = np.array([*in_class, max(total - sum(in_class), 0)], float) + 0.5
    unigram /= unigram.sum()
    encoded = stored(read.mapInArrow(_encode(common, classes), ENCODED)
                     .withColumn("row", F.monotonically_increasing_id()), "lbl-encoded")
    params = train(encoded.where("not held_out").select("classes"), unigram, end=0)
    logs = encoded.select("row", "classes").mapInArrow(_log_probabilities(unigram, params, 0), LOGS)
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.k")
    n = F.coalesce("n", F.lit(0))
    met = rare.join(counts, "token", "left").select(
        "row", (F.col("k") * F.log10(n + F.lit(0.5))).alias("rare_logs"),
        F.when(n > 0, F.col("k")).otherwise(0).alias("rare_known"), F.lit(0.0).alias("lm"))
    # both meet in one aggregation by row
    none = [F.lit(0.0).alias("rare_logs"), F.lit(0).alias("rare_known")]
    sums = logs.select("row", *none, "lm").unionByName(met).groupBy("row").agg(
        F.sum("rare_logs").alias("rare_logs"), F.sum("rare_known").alias("rare_known"), F.sum("lm").alias("lm"))
    spread = np.log10(total + 0.5 * (distinct + 1))
    # the class of the others: its tokens' smoothed counts and the unseen token's half
    rest = np.log10(max(total - sum(in_class), 0) + 0.5 * (max(distinct - len(in_class), 0) + 1))
    known = F.col("n_in") if total else F.lit(0)
    return encoded.drop("classes", "rare").join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", (known + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_in") + F.col("rare_logs") - F.col("n_tokens") * F.lit(float(spread))).alias("base_score"),
        (F.col("lm") + F.col("other_in") + F.col("rare_logs") - F.col("n_other") * F.lit(float(rest))).alias("score"))
