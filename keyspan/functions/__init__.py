"""Scalar and text functions (survey §2.H), all built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen."""

from keyspan.functions.text import (  # noqa: F401
    client_output, hit_rate, logfile_number, parse_vertical, parse_vertical_rows, position_ahead, status_sections,
    strip_ws, version_cmp, version_tuple,
)
from keyspan.functions.arrays import element_pairs, expand_roles, sorted_set  # noqa: F401
from keyspan.functions.status import alter_state, parse_run_status, run_status_json, set_alter_state  # noqa: F401
from keyspan.functions.maps import deep_merge  # noqa: F401
from keyspan.functions.dates import epoch_day, epoch_report_time  # noqa: F401,E402
