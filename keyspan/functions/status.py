"""Status of long jobs as JSON text: one document a node, written with
``to_json`` and read back without regard to the case of its names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: fields of the status documents ------------------------------
RUN_STATUS = "from_host string, from_pid bigint, timestamp bigint"
ALTER_STATUS = "current_state string"
IDLE_STATE = "can_be_altered"
# -------------------------------------------------------------------------------


def run_status_json(host: Column, pid: Column, timestamp: Column) -> Column:
    """A checksum run's status document."""
    return F.to_json(F.struct(host.alias("from_host"), pid.cast("long").alias("from_pid"),
                              timestamp.cast("long").alias("timestamp")))


def parse_run_status(text: Column) -> Column:
    """``struct<from_host, from_pid, timestamp>`` of a status document, all
    lower-cased; NULL for NULL and empty text (no run before), and an error at
    run time for text that is no JSON or names no process."""
    run = F.from_json(F.lower(text), RUN_STATUS, {"mode": "FAILFAST"})
    some = F.coalesce(text, F.lit("")) != ""
    return F.when(some & run["from_pid"].isNull(), F.raise_error(F.lit("no previous pid found in the status of a run"))
                  .cast(run_type())).when(some, run)


def run_type() -> str:
    return f"struct<{RUN_STATUS.replace(' ', ':').replace(',:', ',')}>"


def alter_state(text: Column) -> Column:
    """The state that a schema change's status document names; without a
    document the table can be altered."""
    state = F.from_json(text, ALTER_STATUS, {"mode": "FAILFAST"})["current_state"]
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(IDLE_STATE)).otherwise(state)


def set_alter_state(text: Column, state: Column) -> Column:
    """The document with another state; NULL takes it away."""
    return F.when(state.isNull(), F.lit("")).otherwise(F.to_json(F.struct(state.alias("current_state"))))
