"""Date-shaped scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.scoring import age_days
from ranktide.functions.util import as_col


def iso_week(ts) -> Column:
    """``YYYY-Www`` with the ISO week-numbering year (2026-12-31 -> 2026-W53)."""
    d = as_col(ts)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def activity_label(last_pr_merged_at, as_of) -> Column:
    """"unknown" or ``last PR merged <whole days>d ago`` (days truncated toward zero)."""
    days = age_days(last_pr_merged_at, as_of)
    return F.when(as_col(last_pr_merged_at).isNull(), F.lit("unknown")).otherwise(
        F.concat(F.lit("last PR merged "), days.cast("int").cast("string"), F.lit("d ago"))
    )
