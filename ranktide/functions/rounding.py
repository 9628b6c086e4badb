"""Decimal rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import as_col, let


def round_one_place(x) -> Column:
    """``x`` rounded to one decimal place, ties to even, where only a double that is exactly halfway ties.

    10 x is 8 x + 2 x, of which both parts are exact; their sum's rounding error is
    known exactly, too (Knuth's two-sum), so the two terms together are 10 x itself.
    0.35, which lies below 35 hundredths as a double, gives 0.3; 0.25 gives 0.2.
    Doubles below 9e17 in size; null stays null.
    """

    def near(t: Column) -> Column:
        s, e = t["s"], t["e"]
        whole = F.floor(s).cast("double")
        part = s - whole
        up = (part > 0.5) | ((part == 0.5) & ((e > 0) | ((e == 0) & (whole % 2 == 1))))
        return (whole + up.cast("int")) / F.lit(10.0)

    def error(t: Column) -> Column:
        back = t["s"] - t["a"]
        return F.struct(t["s"], ((t["a"] - (t["s"] - back)) + (t["b"] - back)).alias("e"))

    size = F.abs(as_col(x).cast("double"))
    rounded = let(F.struct((size * 8).alias("a"), (size * 2).alias("b"), (size * 8 + size * 2).alias("s")), lambda t: let(error(t), near))
    return F.when(as_col(x) < 0, -rounded).otherwise(rounded)
