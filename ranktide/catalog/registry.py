"""Registry of user-visible queries: key -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables (landing, staging and pipeline builders write their stages
when called). Output columns are flat (arrays rendered as sorted or
ordered strings, doubles rounded to 6 places) so results compare across
engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, doc: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(fn, sql, doc or (fn.__doc__ or "").strip())
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules fills REGISTRY.
    from ranktide.catalog import (  # noqa: F401
        q_advisories,
        q_audits,
        q_briefs,
        q_fanout,
        q_landing,
        q_manifests,
        q_marts,
        q_pipeline,
    )

    return REGISTRY
