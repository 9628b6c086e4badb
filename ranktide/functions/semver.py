"""Minimal semver range matching as Column expressions (higher-order array functions).

* ``parse_version``: strip leading ``v``s, trim, cut at the first ``-`` then the
  first ``+``, split on dots; every part must be ASCII digits (surrounding
  whitespace allowed) or the result is NULL. Parts are DECIMAL(38,0) so
  date-like versions do not overflow.
* ``version_cmp``: zero-pad to equal length, compare lexicographically (-1/0/1).
* ``version_in_range``: comma-separated clauses, evaluated left to right. The
  first clause that cannot be parsed gives NULL, the first that fails gives
  false, and no failure gives true. Blank clauses are skipped.

Every intermediate value is bound once (``let``) so the expression tree stays
linear in size: the optimizer never sees the same sub-expression twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import as_col, let

PART_TYPE = "decimal(38,0)"
# Comparison operators, tried in this order (longest first).
OP_PATTERN = r"^(<=|>=|<|>|=)"


def _strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_version(value) -> Column:
    v = _strip_ws(F.regexp_replace(as_col(value), r"^v+", ""))
    core = F.substring_index(F.substring_index(v, "-", 1), "+", 1)

    def body(c: Column) -> Column:
        parts = F.split(c, r"\.")
        ok = (c != "") & F.forall(parts, lambda p: p.rlike(r"^\s*[0-9]+\s*$"))
        return F.when(ok, F.transform(parts, lambda p: _strip_ws(p).cast(PART_TYPE)))

    return let(core, body)


def version_cmp(a, b) -> Column:
    """-1 / 0 / 1 after zero-padding both arrays to the same length (NULL if either is NULL)."""
    a, b = as_col(a), as_col(b)
    zero = F.lit(0).cast(PART_TYPE)

    def body(n: Column) -> Column:
        pa = F.concat(a, F.array_repeat(zero, n - F.size(a)))
        pb = F.concat(b, F.array_repeat(zero, n - F.size(b)))
        return F.when(pa < pb, -1).when(pa > pb, 1).otherwise(0)

    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(let(F.greatest(F.size(a), F.size(b)), body))


# op -> set of comparison results that satisfy it
_SATISFY = {"<": (-1,), "<=": (-1, 0), ">": (1,), ">=": (0, 1), "=": (0,)}


def _satisfies(op: Column, c: Column) -> Column:
    expr = F.lit(False)
    for name, ok in _SATISFY.items():
        expr = F.when(op == name, c.isin(*ok)).otherwise(expr)
    return expr


def version_in_range_parsed(target, range_str) -> Column:
    """Range check against an already parsed target (``ARRAY<DECIMAL>``): true / false / NULL."""
    t = as_col(target)
    clauses = F.filter(F.transform(F.split(as_col(range_str), ","), _strip_ws), lambda c: c != "")
    with_op = F.transform(clauses, lambda c: F.struct(F.regexp_extract(c, OP_PATTERN, 1).alias("op"), c.alias("c")))
    parsed = F.transform(
        with_op, lambda x: F.struct(x["op"].alias("op"), parse_version(_strip_ws(F.substr(x["c"], F.length(x["op"]) + 1))).alias("b"))
    )
    codes = F.transform(
        parsed,
        lambda x: F.when((x["op"] == "") | x["b"].isNull(), F.lit(-1))
        .when(_satisfies(x["op"], version_cmp(t, x["b"])), F.lit(1))
        .otherwise(F.lit(0)),
    )
    # Left to right: the first code that is not 1 decides; none -> 1.
    first = F.aggregate(codes, F.lit(1), lambda acc, x: F.when(acc != 1, acc).otherwise(x))
    verdict = F.create_map(F.lit(1), F.lit(True), F.lit(0), F.lit(False))[first]
    return F.when(t.isNotNull() & as_col(range_str).isNotNull(), verdict)


def version_in_range(version, range_str) -> Column:
    """True / False / NULL (unknown) per the left-to-right rules above."""
    return let(parse_version(version), lambda t: version_in_range_parsed(t, range_str))


def render_version(parts) -> Column:
    """Parsed version back to dotted text (for display and comparison)."""
    return F.array_join(F.transform(as_col(parts), lambda p: p.cast("string")), ".")
