"""Quality classifier by co-training.

Two logistic models see each document from one side only: its text, or its
page metadata (source, language, length).  Both begin with the labelled
documents.  In every round each of them judges *all* documents without a label
and marks those of which it is sure, by probabilities calibrated on labelled
documents kept apart; these pseudo-labels go into the *other* model's training
set.  In the end both views' calibrated log-odds are combined, again on labels
kept apart, and all documents are scored in one pass without a shuffle.

Every document's features are written once and read again in each round.  What
a model is fitted on is a bounded sample of rows with labels: ``LABELLED``
labelled documents, and of the documents marked in a round ``EXCHANGED`` of
each label, in both cases those with the smallest hash of their id.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches, stored

LABELLED = 12_000                   # labelled documents that a model is fitted on, at most
ROUNDS = 4
EXCHANGED = 600                     # pseudo-labelled documents of a class that a round adds to them, at most
CONFIDENT = 0.98                    # calibrated probability from which a view is sure
WORD_BUCKETS, META_BUCKETS = 512, 64

_TEXT_STATS = 8
TEXT_SIZE = 256 + _TEXT_STATS + WORD_BUCKETS
META_SIZE = 2 * META_BUCKETS + 24

def text_features(text: str | None) -> np.ndarray:
    """Byte frequencies, shape statistics and hashed word frequencies of the
    whole text; zeros for null and empty texts."""
    out = np.zeros(TEXT_SIZE, np.float32)
    if not text:
        return out
    encoded = text.encode("utf-8", "surrogatepass")
    out[:256] = 10 * np.sqrt(np.bincount(np.frombuffer(encoded, np.uint8), minlength=256) / len(encoded))
    w = text.split()
    if w:
        lines = text.count("\n") + 1
        out[256:256 + _TEXT_STATS] = (
            np.log1p(len(w)), len(set(w)) / len(w), len(text) / len(w) / 10, np.log1p(len(w) / lines),
            sum(map(str.isupper, w)) / len(w), sum(map(str.isalpha, w)) / len(w),
            sum(a == b for a, b in zip(w, w[1:])) / len(w), sum(map(str.isdigit, w)) / len(w))
        hashes = np.fromiter(map(zlib.crc32, encoded.split()), np.int64)
        out[256 + _TEXT_STATS:] = 10 * np.sqrt(np.bincount(hashes % WORD_BUCKETS, minlength=WORD_BUCKETS) / max(1, len(hashes)))
    return out


def meta_features(source: str | None, lang: str | None, n_chars) -> np.ndarray:
    """Hashed source and language and the length's power of two; a null is a
    value of its own."""
    out = np.zeros(META_SIZE, np.float32)
    for i, v in enumerate((source, lang)):
        bucket = 0 if v is None else 1 + zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % (META_BUCKETS - 1)
        out[i * META_BUCKETS + bucket] = 1
    n = 0 if n_chars is None or n_chars != n_chars else max(0, int(n_chars))
    out[2 * META_BUCKETS + min(23, n.bit_length())] = 1
    return out


class Logistic:
    """Logistic regression fitted by Newton steps (conjugate gradients on the
    normal equations) with an L2 penalty; rows may have weights."""

    def __init__(self, penalty: float = 1e-3):
        self.penalty, self.w, self.b = penalty, None, 0.0
        self.mean, self.scale = None, None

    def fit(self, z: np.ndarray, y: np.ndarray, steps: int = 12) -> Logistic:
        """``z`` is scaled in place: the caller hands over its copy."""
        self.mean, self.scale = z.mean(0), z.std(0) + np.float32(1e-2)
        z -= self.mean
        z /= self.scale
        # classes count alike up to a factor of four
        bad = max(1e-3, float((y == 0).mean()))
        c = np.where(y == 0, min(4.0, max(1.0, (1 - bad) / bad)), 1.0).astype(np.float32)
        c /= c.mean()
        w, b = np.zeros(z.shape[1], np.float32), 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
            r = c * (y - p)
            g = z.T @ r / len(y) - self.penalty * w
            gb = r.mean()
            h = c * p * (1 - p) + 1e-4
            # conjugate gradients for (Z'HZ/n + penalty) d = g, the offset apart
            d, res = np.zeros_like(w), g.copy()
            q, rs = res.copy(), float(res @ res)
            for _ in range(20):
                if rs < 1e-12:
                    break
                a = z.T @ (h * (z @ q)) / len(y) + self.penalty * q
                alpha = rs / float(q @ a)
                d += alpha * q
                res -= alpha * a
                new = float(res @ res)
                q, rs = res + new / rs * q, new
            size = min(1.0, 10 / (1e-9 + float(np.abs(d).max())))
            w += np.float32(size) * d
            b += float(gb / h.mean())
            if float(np.abs(d).max()) < 1e-3:
                break
        self.w, self.b = w / self.scale, b - float(self.mean @ (w / self.scale))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x[at:at + 2048].astype(np.float32) @ self.w + self.b
                               for at in range(0, max(1, len(x)), 2048)])


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset of the log-odds on rows kept apart, with
    smoothed targets so that a separated sample does not give infinite odds."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    return tuple(_newton(np.stack([score, np.ones_like(score)], 1), t, np.array([1e-3, 1e-6])))


def _newton(x: np.ndarray, t: np.ndarray, penalty: np.ndarray, steps: int = 60) -> np.ndarray:
    x = x.astype(np.float64)
    w = np.zeros(x.shape[1])

    def loss(w):
        s = x @ w
        return float((np.logaddexp(0, s) - t * s).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (t - p) - penalty * w
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6), g)
        step = 1.0
        while step > 1e-6 and loss(w + step * d) > now:
            step /= 2
        w = w + step * d
        new = loss(w)
        if now - new < 1e-9:
            break
        now = new
    return w


class CoTrained:
    """The two fitted views with their calibration and combination."""

    def __init__(self, views: list[Logistic], scales: list[tuple], combined: np.ndarray):
        self.views, self.scales, self.combined = views, scales, combined

    def log_odds(self, i: int, score: np.ndarray) -> np.ndarray:
        a, b = self.scales[i]
        return a * score + b

    def probability(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [np.clip(self.log_odds(i, s), -30, 30) for i, s in enumerate(scores)]
        both = self.combined[0] * odds[0] + self.combined[1] * odds[1] + self.combined[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (*odds, both))


SURE = float(np.log(CONFIDENT / (1 - CONFIDENT)))       # the log-odds of CONFIDENT


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray,
             rounds: int = ROUNDS) -> CoTrained | None:
    """Labelled rows (y: 1 good, 0 bad) and pool rows, each in both views, all
    in memory; see :func:`fit` for tables."""
    pools = (pool_text, pool_meta)
    order = np.random.default_rng(0).permutation(len(pool_text))
    taken: list[set] = [set(), set()]

    def exchange(model: CoTrained) -> list[tuple[np.ndarray, np.ndarray]]:
        found: list = [None, None]
        for i in (0, 1):
            odds = model.log_odds(i, model.views[i].score(pools[i]))
            free = [r for r in order if r not in taken[1 - i]]
            bad = [r for r in free if odds[r] <= -SURE][:EXCHANGED]
            good = [r for r in free if odds[r] >= SURE][:EXCHANGED]
            taken[1 - i].update(bad + good)
            found[1 - i] = (pools[1 - i][np.array(bad + good, np.int64)], np.repeat([0, 1], [len(bad), len(good)]))
        return found

    return _co_train(text, meta, y, exchange, rounds if len(pool_text) else 0)


def _co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray,
              exchange: Callable[[CoTrained], list[tuple[np.ndarray, np.ndarray]]], rounds: int) -> CoTrained | None:
    """``exchange`` gives what each view learns from the other in a round: its
    features of documents of which the other one is sure, and their labels.
    Every third labelled row calibrates and combines and trains nothing.  None
    without rows of both labels on both sides."""
    apart = np.arange(len(y)) % 3 == 2
    if len(y) < 6 or any(len(set(y[m].tolist())) < 2 for m in (apart, ~apart)):
        return None
    labelled = (text, meta)
    learned: list[list] = [[(x[~apart], y[~apart])] for x in labelled]
    for step in range(rounds + 1):
        views, scales = [], []
        for i in (0, 1):
            x = np.concatenate([x for x, _ in learned[i]], dtype=np.float32)     # a copy: fitting scales it in place
            views.append(Logistic().fit(x, np.concatenate([t for _, t in learned[i]]).astype(np.float32)))
            del x
            scales.append(calibrate(views[i].score(labelled[i][apart]), y[apart]))
        model = CoTrained(views, scales, np.zeros(3))
        if step < rounds:
            for i, more in enumerate(exchange(model)):
                learned[i].append(more)
    odds = [model.log_odds(i, views[i].score(labelled[i][apart])) for i in (0, 1)]
    model.combined = _newton(np.stack([*odds, np.ones_like(odds[0])], 1), y[apart].astype(float),
                             np.array([1e-2, 1e-2, 1e-6]))
    return model


def _split(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Stored features to both views."""
    x = np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), TEXT_SIZE + META_SIZE)
    return x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]


def _sure(model: CoTrained):
    """(ct_id, ct_x) -> (ct_id, ct_side, ct_y): what a view is sure of, for
    the other one (``ct_side``) to learn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(_split(batch.column(1).to_pylist())):
                odds = model.log_odds(i, model.views[i].score(x))
                rows = np.flatnonzero(np.abs(odds) >= SURE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), 1 - i, np.int32)),
                     pa.array((odds[rows] > 0).astype(np.int32))], names=["ct_id", "ct_side", "ct_y"])
    return run


def _features_udf():
    @F.pandas_udf("binary")
    def features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, source, lang, n in batches:
            yield pd.Series([np.concatenate([text_features(t), meta_features(s, g, c)]).astype(np.float16).tobytes()
                             for t, s, g, c in zip(text, source, lang, n)], dtype=object)
    return features


def _meta_columns(docs: DataFrame, names: tuple[str, str, str]) -> list[Column]:
    source, lang, n_chars = names
    return [F.col(source).cast("string"), F.col(lang).cast("string"), F.col(n_chars).cast("double")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        meta: tuple[str, str, str] = ("source", "lang", "n_chars"), label_col: str = "quality",
        labelled: int = LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> CoTrained | None:
    """Co-trains on the driver with the features of at most ``labelled`` +
    2 x ``rounds`` x ``exchanged`` documents a view (half precision, some 1.9
    KB each); judging, in each round, runs over all documents without a label.
    A document with several labels counts by their mean; null labels and ids
    are left out, and of rows that repeat an id one is used."""
    spark = docs.sparkSession
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast(docs.schema[id_col].dataType).alias("ct_id"))
             .agg((F.avg(label_col) >= 0.5).cast("int").alias("ct_y")))
    features = stored(docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("ct_id"), _features_udf()(F.col(text_col), *_meta_columns(docs, meta)).alias("ct_x")), "ct-features")
    order = F.xxhash64("ct_id")
    # labels of other documents must not use up the sample
    sample = known.join(features.select("ct_id").distinct(), "ct_id", "left_semi").orderBy(order, "ct_id").limit(labelled)
    rows = (features.join(F.broadcast(sample), "ct_id")             # at most ``labelled`` rows
            .groupBy("ct_id").agg(F.min(F.struct("ct_y", "ct_x")).alias("r")).select("ct_id", "r.*").orderBy(order, "ct_id").collect())
    if not rows:
        return None
    y = np.array([r["ct_y"] for r in rows])
    text, about = _split([r["ct_x"] for r in rows])
    del rows
    kind = features.schema["ct_id"].dataType.simpleString()
    learner = f"ct_id {kind}, ct_side int"
    taken: list[tuple] = []

    def exchange(model: CoTrained) -> list[tuple[np.ndarray, np.ndarray]]:
        marked = (features.mapInArrow(_sure(model), f"{learner}, ct_y int").distinct()
                  .join(known.select("ct_id"), "ct_id", "left_anti")
                  .join(spark.createDataFrame(taken, learner), ["ct_id", "ct_side"], "left_anti"))
        marked = stored(marked.withColumn("ct_h", F.pmod(order, F.lit(1 << 40))), "ct-marked")
        counts = marked.groupBy("ct_side", "ct_y").count().collect()
        # twice as many as needed lie below the threshold, so the first ones are there
        near = F.lit(False)
        for r in counts:
            least = -(-(2 * exchanged << 40) // r["count"]) if r["count"] > 2 * exchanged else 1 << 40
            near = near | ((F.col("ct_side") == r["ct_side"]) & (F.col("ct_y") == r["ct_y"]) & (F.col("ct_h") < least))
        groups: dict[tuple, list] = {}
        for r in marked.where(near).orderBy("ct_h", "ct_id").collect():
            group = groups.setdefault((r["ct_side"], r["ct_y"]), [])
            if len(group) < exchanged:
                group.append(r["ct_id"])
        chosen = [(doc, side, label) for (side, label), ids in groups.items() for doc in ids]
        taken.extend(c[:2] for c in chosen)
        told = spark.createDataFrame(chosen, f"{learner}, ct_y int")
        got = (features.join(F.broadcast(told), "ct_id")             # at most 4 x ``exchanged`` rows
               .groupBy("ct_id", "ct_side", "ct_y").agg(F.min("ct_x").alias("ct_x")).orderBy("ct_side", "ct_y", order, "ct_id").collect())
        return [(_split([r["ct_x"] for r in got if r["ct_side"] == i])[i],
                 np.array([r["ct_y"] for r in got if r["ct_side"] == i], int)) for i in (0, 1)]

    return _co_train(text, about, y, exchange, rounds)


def scores(docs: DataFrame, model: CoTrained | None, text_col: str = "text",
           meta: tuple[str, str, str] = ("source", "lang", "n_chars")) -> Column:
    """struct<text_score, meta_score, score>: the calibrated probabilities of
    good quality by either view and by both.  Without a model all are 1."""
    kind = "text_score double, meta_score double, score double"
    if model is None:
        one = F.lit(1.0)
        return F.struct(one.alias("text_score"), one.alias("meta_score"), one.alias("score"))

    @F.pandas_udf(kind)
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, n in batches:
            parts = []
            for at in range(0, len(text), 256):
                part = slice(at, at + 256)
                xt = np.stack([text_features(t) for t in text.iloc[part]])
                xm = np.stack([meta_features(*v) for v in zip(source.iloc[part], lang.iloc[part], n.iloc[part])])
                parts.append(np.stack(model.probability([model.views[0].score(xt), model.views[1].score(xm)]), 1))
            both = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pd.DataFrame(both.astype(float), columns=["text_score", "meta_score", "score"])

    return score(F.col(text_col), *_meta_columns(docs, meta))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               meta: tuple[str, str, str] = ("source", "lang", "n_chars"), label_col: str = "quality",
               least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ct_scores (see :func:`scores`) and ct_kept
    (both views' probability is at least ``least``).

    Null and empty texts are zeros in the text view and are judged by what the
    labels say of such documents; null metadata are values of their own.
    Repeated rows are judged alike.  An empty table gives an empty result;
    without labels of both kinds on its documents everything is kept, with a
    warning.  A column of ``docs`` that begins with ``ct_`` raises ``ValueError``.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("ct_")]:
        raise ValueError(f"columns {clash} begin with ct_, which the operator uses itself")
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, meta, label_col)
    if model is None:
        warnings.warn("no documents labelled of both kinds: every document is kept", stacklevel=2)
    out = docs.withColumn("ct_scores", scores(docs, model, text_col, meta))
    return out.withColumn("ct_kept", F.col("ct_scores.score") >= least)
