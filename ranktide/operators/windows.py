"""Ranking windows: latest-row, first-seen dedupe, top-k per group.

Every ``row_number`` here is followed by a ``<= k`` filter, so Catalyst plants a
partial ``WindowGroupLimit`` *before* the shuffle: a hot key (one package
holding a third of all rows) leaves each map task as at most ``k`` rows, so no
single reducer ever receives the whole group. Orderings always end in a unique
key so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.functions.util import as_col


def _order(cols: Sequence) -> list[Column]:
    return [as_col(c) for c in cols]


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order`` (row_number <= k)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The single newest row per key (``ROW_NUMBER ... = 1``)."""
    return top_k_per_group(df, keys, order, 1)


def win_latest_advisory(advisories: DataFrame) -> DataFrame:
    """Newest snapshot per advisory id; ties on date fall to the project purl."""
    return latest_per_key(advisories, ["id"], [F.col("ingest_date").desc(), F.col("project_purl").asc()])


def win_latest_project(projects: DataFrame) -> DataFrame:
    return latest_per_key(projects, ["purl"], [F.col("ingest_date").desc()])


def win_latest_transition(transitions: DataFrame) -> DataFrame:
    """Newest transition per dedupe key: transition time, then ingest date (then reason, for determinism)."""
    return latest_per_key(
        transitions,
        ["dedupe_key"],
        [F.col("transitioned_at").desc(), F.col("ingest_date").desc(), F.col("reason").desc()],
    )


def win_dedupe_first(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """First seen row per key in arrival order ``seq``."""
    return latest_per_key(df, keys, [F.col(seq).asc()])
