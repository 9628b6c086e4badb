"""Folding a text's lines inside its row, as Column code.

A state machine over lines is a fold: ``step`` takes the state before a line and
gives the state after it and what the line adds to the result. The lines are cut
into chunks; a chunk starts from the state that the one before it left and collects
its own results, so appending copies a chunk's results only, and a text of n lines
costs n steps and (n / CHUNK) short arrays. No line is a row, and none is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import let

CHUNK = 256


def fold_lines(
    text: Column, start: dict[str, Column], found: str, step: Callable[[Column, Column, Column], Column],
    finish: Callable[[Column], Column] | None = None, chunk: int = CHUNK,
) -> Column:
    """All that ``step`` finds, in order, as ``array<found>`` (null text: null).

    ``step(state, line, number)`` gives a struct of the fields of ``start``, after
    the line, and ``found``, an array; lines are numbered from 1. ``finish(state)``
    makes the result of the last state, which has all that was found as ``found``.
    """
    none = F.array().cast(f"array<{found}>")
    fields = list(start)

    def joined(state: Column, after: Column, *more: Column) -> Column:
        every = (
            F.when(F.size(after["found"]) == 0, state["found"]).when(F.size(state["found"]) == 0, after["found"])
            .otherwise(F.concat(state["found"], after["found"]))
        )
        return F.struct(*[after[f].alias(f) for f in fields], every.alias("found"), *more)

    def one(state: Column, line: Column) -> Column:
        number = state["number"] + 1
        return let(step(state, line, number), lambda after: joined(state, after, number.alias("number")))

    def part(state: Column, piece: Column) -> Column:
        begin = F.struct(*[state[f].alias(f) for f in fields], none.alias("found"), piece["before"].alias("number"))
        return let(F.aggregate(piece["lines"], begin, one), lambda after: joined(state, after))

    def whole(lines: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / chunk).cast("int")),
            lambda i: F.struct((i * chunk).alias("before"), F.slice(lines, i * chunk + 1, chunk).alias("lines")),
        )
        begin = F.struct(*[c.alias(f) for f, c in start.items()], none.alias("found"))
        return F.aggregate(pieces, begin, part, finish or (lambda state: state["found"]))

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), whole))


def first_of_each(items: Column, *key: str) -> Column:
    """The first of the structs in an array with each value of the ``key`` fields, in their order; null keys are equal.

    Sorted by key and place, the heads of equal runs are taken and put back in
    order: n log n, however many there are.
    """

    def keyed(array: Column) -> Column:
        marked = F.transform(array, lambda x, i: F.struct(F.struct(*[x[k].alias(k) for k in key]).alias("key"), i.alias("place"), x.alias("item")))
        return F.array_sort(F.transform(marked, lambda x: F.struct(x["key"], x["place"])))

    def heads(array: Column, turns: Column) -> Column:
        first = F.filter(turns, lambda x, i: (i == 0) | ~F.get(turns, i - 1)["key"].eqNullSafe(x["key"]))
        return F.transform(F.array_sort(F.transform(first, lambda x: x["place"])), lambda p: F.get(array, p))

    return let(items, lambda array: let(keyed(array), lambda turns: heads(array, turns)))
