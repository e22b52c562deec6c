"""C10 as a job that survives its process: the checksum audit of two copies.

The key span is cut into chunks, chunks into batches.  Each batch reads its own
key range of both copies (pushed down to the scan), compares the checksums of
its chunks in one aggregation, and commits them: written beside the folder of
results and renamed into it.  A run that dies leaves whole batches; the next
one finds them and does the open ones only.  When all are done the results of
every run are looked at together.  They are dropped if no chunk differs and
kept for review if one does.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.operators.audit import compare_chunks
from keyspan.plans.jobs import JobError, rename
from keyspan.sources.files import delete, exists, names_in, read_text, write_new_text

LEASE_S = 600                # a run that has not committed anything for so long counts as dead


class AlreadyRunning(JobError):
    pass


@dataclass
class AuditResult:
    clean: bool
    resumed: bool            # earlier results were found and used
    batches: int             # batches this run compared
    differing: DataFrame     # chunk_min, chunk_max, a_rows, b_rows


class ChecksumAudit:
    """Audits copy ``b`` against ``a`` over the chunks of ``[lo, hi]``; rows
    outside it and rows without a key are a batch of their own.  ``root`` is a
    folder in a shared store that holds the audit's state."""

    def __init__(self, spark: SparkSession, root: str, key: str, lo: int, hi: int, chunks: int,
                 cols: list[str], batch_chunks: int = 50, lease_s: float = LEASE_S):
        self.spark, self.root, self.key, self.lo, self.hi, self.chunks = spark, root.rstrip("/"), key, lo, hi, chunks
        self.cols, self.batch_chunks, self.lease_s = list(cols), batch_chunks, lease_s
        self.run_id = uuid.uuid4().hex

    # --- the plan --------------------------------------------------------------
    def _plan(self) -> list[tuple[str, F.Column]]:
        """(name, condition on the key) of every batch."""
        width = max((self.hi - self.lo + 1) // self.chunks, 1) * self.batch_chunks
        k = F.col(self.key)
        inside = [(f"b{i:08d}", k.between(start, min(start + width - 1, self.hi)))
                  for i, start in enumerate(range(self.lo, self.hi + 1, width))]
        return [*inside, ("outside", k.isNull() | (k < self.lo) | (k > self.hi))]

    def _parameters(self) -> str:
        return json.dumps([self.key, self.lo, self.hi, self.chunks, self.batch_chunks, self.cols])

    # --- one run at a time --------------------------------------------------------
    def _beat(self) -> str:
        """Says that this run is alive, and takes back what it said before."""
        before = [n for n in names_in(self.spark, f"{self.root}/runs") if n.endswith(self.run_id)]
        now = f"{time.time_ns():020d}-{self.run_id}"
        write_new_text(self.spark, f"{self.root}/runs/{now}", self.run_id)
        for n in before:
            delete(self.spark, f"{self.root}/runs/{n}")
        return now

    def _others_alive(self) -> list[str]:
        since = time.time_ns() - self.lease_s * 1e9
        return [n for n in names_in(self.spark, f"{self.root}/runs")
                if not n.startswith(".") and not n.endswith(self.run_id) and int(n.split("-")[0]) > since]

    # --- running ---------------------------------------------------------------------
    def open_batches(self) -> list[str]:
        done = set(self._done())
        return [n for n, _ in self._plan() if n not in done]

    def _done(self) -> list[str]:
        return [n.removeprefix("batch=") for n in names_in(self.spark, f"{self.root}/results") if n.startswith("batch=")]

    def run(self, a: DataFrame, b: DataFrame, after_batch: Callable[[str], None] | None = None) -> AuditResult:
        """Compares the open batches.  ``after_batch`` is called with the name
        of each one committed.  Raises :class:`AlreadyRunning` while another run
        on the folder is alive, and ``JobError`` if the folder holds the state
        of an audit with other parameters."""
        if others := self._others_alive():
            raise AlreadyRunning(f"{self.root} is being audited by run {others[-1].split('-')[1]}")
        if not exists(self.spark, f"{self.root}/parameters.json"):
            write_new_text(self.spark, f"{self.root}/parameters.json", self._parameters())
        elif read_text(self.spark, f"{self.root}/parameters.json") != self._parameters():
            raise JobError(f"{self.root} holds an audit with other parameters")
        resumed, done = bool(self._done()), 0
        mine = self._beat()
        if earlier := [n for n in self._others_alive() if n < mine]:      # of two that start at once the first goes on
            self._gone()
            raise AlreadyRunning(f"{self.root} is being audited by run {earlier[0].split('-')[1]}")
        conditions = dict(self._plan())
        try:
            for name in self.open_batches():
                found = compare_chunks(a.where(conditions[name]), b.where(conditions[name]), self.key, self.lo, self.hi,
                                       self.chunks, self.cols)
                beside = f"{self.root}/results/.{name}-{self.run_id}"
                found.withColumn("run", F.lit(self.run_id)).write.parquet(beside)
                rename(self.spark, beside, f"{self.root}/results/batch={name}")
                done += 1
                self._beat()
                if after_batch is not None:
                    after_batch(name)
        finally:
            self._gone()
        differing = self.results().where("not same").select("chunk_min", "chunk_max", "a_rows", "b_rows")
        clean = differing.isEmpty()
        if clean:
            differing = self.spark.createDataFrame([], differing.schema)
            delete(self.spark, self.root)
        return AuditResult(clean, resumed, done, differing)

    def _gone(self) -> None:
        for n in names_in(self.spark, f"{self.root}/runs"):
            if n.endswith(self.run_id):
                delete(self.spark, f"{self.root}/runs/{n}")

    def results(self) -> DataFrame:
        """batch, chunk_min, chunk_max, a_rows, b_rows, same, run: the chunks
        compared so far, by whichever run; empty chunks have no row."""
        kind = "chunk_min long, chunk_max long, a_rows long, b_rows long, same boolean, run string, batch string"
        if not self._done():
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.root}/results")
