"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (a bare SQL ``0.6`` would be DECIMAL)."""
    return F.lit(float(x))


def ts_ntz(value: str) -> Column:
    """TIMESTAMP_NTZ literal: no session time zone is involved."""
    return F.to_timestamp_ntz(F.lit(value))


def r6(c) -> Column:
    """Round a double to 6 places for cross-engine comparison."""
    return F.round(as_col(c), 6)


def let(value, fn) -> Column:
    """Bind ``value`` once and build ``fn(value)``: keeps expression trees linear in size.

    (``transform`` over a one-element array is the only expression-level binding
    Spark SQL offers; it is evaluated per row without any shuffle.)
    """
    return F.get(F.transform(F.array(as_col(value)), fn), 0)
