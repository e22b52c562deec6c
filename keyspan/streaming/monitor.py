"""Stateful stream monitors: caught-up detection (I3), live command counters
(I5) and re-delivery safety (I7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- Fixed values ---------------------------------------------------------------
CAUGHT_UP_POLLS = 3
CATCH_UP_TIMEOUT_S = 21600
CHUNK = 8192                # polls of a node, by number, that are put in order together
# the only store with maps, and one bound for the memory of all its instances in an executor
STATE_STORE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "rocksdb.boundedMemoryUsage": "true"}
# ---------------------------------------------------------------------------------

CAUGHT_UP_OUT = "node string, status string, polls long, at_seq long"
#: next: the number that is waited for; held: polls that came before their turn, sorted by number
CAUGHT_UP_STATE = ("next long, zeros long, polls long, done boolean, held_no array<bigint>, held_seq array<bigint>, "
                   "held_lag array<double>")


def _caught_up_fn(polls_needed: int, timeout_ms: int | None, gap_ms: int | None = None, first: int = 0):
    def fresh():
        return first, 0, 0, False, [], [], []

    def taken(node, nos, seqs, lags, state, out):
        """One more lot of polls: what is in turn is judged, the rest is held."""
        nxt, zeros, polls, done, *held = state
        no = np.concatenate([np.asarray(held[0], np.int64), nos])
        order = np.argsort(no, kind="stable")
        no, seq, lag = no[order], np.concatenate([np.asarray(held[1], np.int64), seqs])[order], \
            np.concatenate([np.asarray(held[2], float), lags])[order]
        keep = (no >= nxt) & np.r_[True, no[1:] != no[:-1]]           # those in turn already, and repeated ones, go
        no, seq, lag = no[keep], seq[keep], lag[keep]
        n = int((no == nxt + np.arange(len(no))).argmin()) if len(no) and (no != nxt + np.arange(len(no))).any() else len(no)
        if n:
            x = lag[:n]
            broken, zero = np.isnan(x), x == 0
            # zero polls since the last positive lag; broken polls neither count nor reset
            counts = np.cumsum(zero) + zeros
            counts -= np.maximum.accumulate(np.where(~broken & ~zero, counts, 0))
            hits = np.flatnonzero(zero & (counts >= polls_needed))
            last = int(hits[0]) if len(hits) else n - 1
            out += [(node, "broken", polls + int(i) + 1, int(seq[i])) for i in np.flatnonzero(broken[:last + 1])]
            if len(hits):
                done = True
                out.append((node, "caught_up", polls + last + 1, int(seq[last])))
            nxt, zeros, polls = nxt + n, int(counts[last]), polls + last + 1
        if done:
            return nxt, zeros, polls, True, [], [], []
        return nxt, zeros, polls, False, no[n:].tolist(), seq[n:].tolist(), lag[n:].tolist()

    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, out = key[0], []
        now = state.get if state.exists else fresh()
        if state.hasTimedOut:
            if gap_ms is not None and len(now[4]):                     # the poll that is waited for is given up
                out.append((node, "gap", now[2], int(now[5][0])))
                now = taken(node, np.array([], np.int64), np.array([], np.int64), np.array([], float),
                            (int(now[4][0]), *now[1:]), out)
            else:
                state.remove()
                if not now[3]:
                    yield pd.DataFrame({"node": [node], "status": ["timeout"], "polls": [now[2]], "at_seq": [None]})
                return
        for pdf in batches:
            if not now[3] and len(pdf):
                number = pdf["number" if "number" in pdf else "seq"].to_numpy(np.int64)
                now = taken(node, number, pdf["seq"].to_numpy(np.int64),
                            pdf["lag"].to_numpy(float), now, out)
        state.update(tuple(now))
        wait = gap_ms if gap_ms is not None and len(now[4]) else timeout_ms
        if not now[3] and wait is not None:
            state.setTimeoutDuration(wait)
        if out:
            yield pd.DataFrame(out, columns=["node", "status", "polls", "at_seq"])
    return fn


ZERO, POSITIVE, BROKEN = 0, 1, 2
#: polls of a chunk that came before their turn, by their place in the chunk
CHUNK_STATE = "next long, held_at array<int>, held_seq array<bigint>, held_kind array<int>"
#: polls in turn, n from number at on: the first zeros of those before a positive lag, and all; the first hit after one (-1: none)
#: and the zeros since the last; the broken ones (places count from at)
STRETCH = ("at long, n long, lead array<bigint>, lead_seq array<bigint>, zeros long, positive boolean, hit long, hit_seq long, "
           "tail long, broken array<bigint>, broken_seq array<bigint>")


def _stretch(at: int, seq: np.ndarray, kind: np.ndarray, polls_needed: int) -> tuple:
    """What the detector has to know of polls that follow each other, whatever came before them."""
    zero, positive = kind == ZERO, kind == POSITIVE
    first = int(positive.argmax()) if positive.any() else len(kind)
    lead = np.flatnonzero(zero[:first])
    counts = np.cumsum(zero)
    counts -= np.maximum.accumulate(np.where(positive, counts, 0))
    hits = np.flatnonzero(zero[first:] & (counts[first:] >= polls_needed)) + first
    hit = int(hits[0]) if len(hits) else -1
    broken = np.flatnonzero((kind[:hit] if hit >= 0 else kind) == BROKEN)
    return (at, len(kind), lead[:polls_needed].tolist(), seq[lead[:polls_needed]].tolist(), len(lead), first < len(kind), hit,
            int(seq[hit]) if hit >= 0 else -1, int(counts[-1]), broken.tolist(), seq[broken].tolist())


def _chunk_fn(polls_needed: int, first: int, chunk: int):
    """Polls of one chunk of a node -> the stretches that are in turn within it."""
    names = ["node", *(c.split()[0] for c in STRETCH.split(", "))]

    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node, begins = key[0], first + int(key[1]) * chunk
        nxt, *held = state.get if state.exists else (0, [], [], [])
        at, seq, kind = (np.asarray(h, np.int64) for h in held)
        out = []
        for pdf in batches:
            at = np.concatenate([at, pdf["number"].to_numpy(np.int64) - begins])
            order = np.argsort(at, kind="stable")
            at, seq, kind = at[order], np.concatenate([seq, pdf["seq"].to_numpy(np.int64)])[order], \
                np.concatenate([kind, pdf["kind"].to_numpy(np.int64)])[order]
            keep = (at >= nxt) & np.diff(at, prepend=-1).astype(bool)     # those in turn already, and repeated ones, go
            at, seq, kind = at[keep], seq[keep], kind[keep]
            n = int(np.count_nonzero(at == nxt + np.arange(len(at))))     # at is ascending, so these come first
            if n:
                out.append((node, *_stretch(begins + nxt, seq[:n], kind[:n], polls_needed)))
                nxt, at, seq, kind = nxt + n, at[n:], seq[n:], kind[n:]
        state.update((nxt, at.tolist(), seq.tolist(), kind.tolist()))
        if out:
            yield pd.DataFrame(out, columns=names)
    return fn


class Stretches(StatefulProcessor):
    """A node's stretches, in any order -> its statuses.  Those ahead of their
    turn wait in a map by number, which is read one by one."""

    def __init__(self, polls_needed: int, first: int):
        self.polls_needed, self.first = polls_needed, first

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "next long, zeros long, polls long, done boolean")
        self.waiting = handle.getMapState("waiting", "number long", STRETCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        node, out, columns = key[0], [], [c.split()[0] for c in STRETCH.split(", ")]
        nxt, zeros, polls, done = self.now.get() if self.now.exists() else (self.first, 0, 0, False)
        for pdf in rows:
            came = {} if done else {int(s[0]): s for s in pdf[columns].itertuples(index=False, name=None)}
            while not done and (nxt in came or self.waiting.containsKey((nxt,))):
                at = nxt
                _, n, lead, lead_seq, led, positive, hit, hit_seq, tail, broken, broken_seq = \
                    came.pop(at) if at in came else self.waiting.getValue((at,))
                if zeros + led >= self.polls_needed:
                    hit, hit_seq = lead[self.polls_needed - zeros - 1], lead_seq[self.polls_needed - zeros - 1]
                done = hit >= 0
                out += [(node, "broken", polls + int(b) + 1, int(q)) for b, q in zip(broken, broken_seq) if not done or b < hit]
                if done:
                    out.append((node, "caught_up", polls + int(hit) + 1, int(hit_seq)))
                nxt, polls, zeros = nxt + int(n), polls + int(n), int(tail) if positive else zeros + int(led)
                self.waiting.removeKey((at,))
            if not done:
                for at, s in came.items():
                    self.waiting.updateValue((at,), tuple([int(x) for x in v] if np.ndim(v) else bool(v) if name == "positive"
                                                          else int(v) for name, v in zip(columns, s)))
        if done:
            self.waiting.clear()
        self.now.update((nxt, zeros, polls, done))
        if out:
            yield pd.DataFrame(out, columns=["node", "status", "polls", "at_seq"])

    def close(self) -> None:
        pass


def caught_up_stream(polls: DataFrame, node: str, seq: str, lag: str,
                     polls_needed: int = CAUGHT_UP_POLLS,
                     timeout_s: int | None = CATCH_UP_TIMEOUT_S, number: str | None = None, first: int = 0,
                     gap_s: int | None = None) -> DataFrame:
    """Per node, emit ``caught_up`` once ``polls_needed`` polls in a row
    report zero lag (a positive lag resets the count, a NULL one does not), ``broken`` for a NULL
    lag, and ``timeout`` when no decision came within ``timeout_s`` of
    processing time (``None``: no timeout -- use this with the available-now
    trigger, where pending timers would keep scheduling empty batches).

    ``number`` (default: ``seq``) counts a node's polls without gaps from
    ``first``.  Polls are judged in that order whatever the files and batches in
    which they come: one that is ahead of its turn is held in the node's state
    until those before it are there, and a repeated one is dropped.  So the
    answer does not depend on arrival, and the state is as large as the disorder,
    not as the history.  With ``gap_s`` a poll that does not come for so long is
    given up (status ``gap``, at the poll that follows).

    Without timers, polls are held and put in order by chunks of ``CHUNK``
    numbers, so one task never holds more of a node than a chunk, and what
    a chunk comes to goes on to the node's state.  A timer acts on all that a
    node holds, so with one the held polls stand in the node's own state."""
    p = polls.select(F.col(node).cast("string").alias("node"), F.col(seq).cast("long").alias("seq"),
                     F.col(lag).cast("double").alias("lag"), F.col(number or seq).cast("long").alias("number"))
    fn = _caught_up_fn(polls_needed, None if timeout_s is None else timeout_s * 1000, None if gap_s is None else gap_s * 1000, first)
    if timeout_s is not None or gap_s is not None:
        return p.groupBy("node").applyInPandasWithState(fn, CAUGHT_UP_OUT, CAUGHT_UP_STATE, "append",
                                                        GroupStateTimeout.ProcessingTimeTimeout)
    kind = F.when(F.col("lag").isNull() | F.isnan("lag"), BROKEN).when(F.col("lag") == 0, ZERO).otherwise(POSITIVE)
    for name, value in STATE_STORE.items():                   # settings of the session; they hold for what runs after it
        polls.sparkSession.conf.set(f"spark.sql.streaming.stateStore.{name}", value)
    ahead = F.greatest(F.col("number") - first, F.lit(0))
    stretches = p.select("node", ((ahead - ahead % CHUNK) / CHUNK).cast("long").alias("chunk"), "number", "seq", kind.alias("kind")) \
        .groupBy("node", "chunk").applyInPandasWithState(_chunk_fn(polls_needed, first, CHUNK), f"node string, {STRETCH}",
                                                         CHUNK_STATE, "append", GroupStateTimeout.NoTimeout)
    return stretches.groupBy("node").transformWithStateInPandas(Stretches(polls_needed, first), CAUGHT_UP_OUT, "Append", "None")


def command_counters(events: DataFrame, ts: str, node: str, kind: str,
                     kinds=("select", "insert", "delete"), watermark: str | None = None) -> DataFrame:
    """Per node and one-second window, how many commands of each kind
    (``count(when...)`` columns; streams cannot pivot).  Without a
    ``watermark`` no row is ever too late: run it in ``complete`` or ``update``
    mode.  With one, windows are emitted once and later rows are lost."""
    # watermarks need TIMESTAMP (zone-aware); the tables carry TIMESTAMP_NTZ
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        e = e.withWatermark(ts, watermark)
    aggs = [F.count(F.when(F.lower(F.col(kind)) == k, 1)).alias(f"com_{k}") for k in kinds]
    return e.groupBy(F.window(ts, "1 second"), F.col(node)).agg(*aggs)


def cumulative_counters(counts: DataFrame, node: str, second: str, kinds: list[str]) -> DataFrame:
    """I5 as the counters stand: one row a node and second with the running
    totals of each kind, and one row for each stretch of seconds without any
    report of a node that comes back later, with NULL totals (N/A) from
    ``second`` to ``until``.  ``counts``: a node's counts by second, such as the
    sink of :func:`command_counters`; a late second only adds to what follows.
    Two ordered scans in range partitions, so a node with a third of all rows is
    spread over many tasks; silent seconds are stretches, never a row each."""
    from keyspan.operators.scan import grouped_lag, grouped_scan
    per = counts.groupBy(node, second).agg(*[F.sum(k).cast("long").alias(k) for k in kinds])
    run = grouped_scan(per, [node], [second], kinds, "sum", [f"__{k}" for k in kinds])
    run = run.select(node, F.col(second).cast("long").alias(second), *[F.col(f"__{k}").alias(k) for k in kinds])
    seen = grouped_lag(run, [node], [second], second, "__before")
    rows = seen.select(node, second, F.col(second).alias("until"), *kinds)
    silent = seen.where(F.col(second) > F.col("__before") + 1).select(
        node, (F.col("__before") + 1).alias(second), (F.col(second) - 1).alias("until"),
        *[F.lit(None).cast("long").alias(k) for k in kinds])
    return rows.unionByName(silent)


def dedup_redelivery(stream: DataFrame, pk: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """Drop a change delivered twice (same key).  Without a watermark every
    key is remembered and no row is lost; with one (on ``ts``) only that long,
    and rows behind it are dropped."""
    if watermark is None:
        return stream.dropDuplicates(pk)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) \
        .dropDuplicatesWithinWatermark(pk)
