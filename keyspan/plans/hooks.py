"""Job hooks (J1, J2): ordered ``before`` / ``after`` callbacks around any
job step.

A callback takes and returns a DataFrame (or returns None to keep it).
Callbacks run from high to low priority (default 100).  :class:`Abort` in a
*before* callback skips the step; in an *after* callback it only skips the
callbacks that are left, and the finished step's result stands.  Overridable steps (J2) are plain callables passed to the jobs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

DEFAULT_PRIORITY = 100

#: The steps of the jobs and what a callback of theirs is given: rows that are
#: about to be written or have been, or the shard map before and after.
STEPS = {
    "split_write": "K1: rows routed to the children",
    "merge_write": "K2: rows of all shards",
    "cutover_map": "K4: the shard map",
    "cleanup_prune": "K5: the rows of one child",
    "rebuild_write": "K6: the table's rows",
    "alter_shards": "K7: the altered rows of the preflight shard, then of the rest",
    "plan_history": "K8: the stored history",
    "check_copy": "K9: the copy that is checked",
    "count_rows": "K10: the report",
}


class Abort(Exception):
    """Raised by a callback to stop the step."""


@dataclass
class Hooks:
    _before: dict[str, list] = field(default_factory=lambda: defaultdict(list))
    _after: dict[str, list] = field(default_factory=lambda: defaultdict(list))

    def before(self, step: str, priority: int = DEFAULT_PRIORITY):
        def deco(fn: Callable[[DataFrame], DataFrame | None]):
            self._before[step].append((priority, len(self._before[step]), fn))
            return fn
        return deco

    def after(self, step: str, priority: int = DEFAULT_PRIORITY):
        def deco(fn: Callable[[DataFrame], DataFrame | None]):
            self._after[step].append((priority, len(self._after[step]), fn))
            return fn
        return deco

    @staticmethod
    def _run(chain, df):
        for _, _, fn in sorted(chain, key=lambda t: (-t[0], t[1])):
            out = fn(df)
            df = df if out is None else out
        return df

    def wrap(self, step: str, body: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame | None:
        """Run ``before`` callbacks, the step, then ``after`` callbacks, each
        threading the DataFrame through ``df.transform``-style calls.
        Returns None when a ``before`` callback aborted: the step did not run."""
        try:
            df = self._run(self._before.get(step, []), df)
        except Abort:
            return None
        df = body(df)
        for _, _, fn in sorted(self._after.get(step, []), key=lambda t: (-t[0], t[1])):
            try:
                out = fn(df)
            except Abort:
                break
            df = df if out is None else out
        return df


NO_HOOKS = Hooks()


class JobAborted(RuntimeError):
    """A *before* callback stopped a step that the job cannot do without."""


def step(hooks: Hooks, name: str, body: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """One step of a job, with its callbacks; raises :class:`JobAborted` if one
    of them aborts it, so nothing of the step has happened then."""
    if name not in STEPS:
        raise ValueError(f"{name} is no step of a job")
    out = hooks.wrap(name, body, df)
    if out is None:
        raise JobAborted(f"{name} aborted by a callback")
    return out
