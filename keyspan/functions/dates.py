"""Epoch-second formatting used by the reports (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: report formats -----------------------------------------------
DAY_FORMAT = "yyyy-MM-dd"              # %Y-%m-%d
REPORT_TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"  # %m/%d/%Y %H:%M:%S
# ---------------------------------------------------------------------------------


def epoch_day(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), DAY_FORMAT)


def epoch_report_time(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), REPORT_TIME_FORMAT)
