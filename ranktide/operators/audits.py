"""Blocking data-quality audits. Each audit returns its violation rows (empty = pass).

``run_audits`` evaluates a list of audits into one small summary DataFrame
``(audit, model, violations)``; ``assert_audits`` raises when any count is > 0.
All rules on single rows and on uniqueness of a model are counted in one scan of
it: a row's own violations are sums, its values that have to be unique go into one
aggregate by rule and value. Only the per-audit counts (one row per audit) ever
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.operators.windows import win_latest_project

# Lifecycle vocabulary.
STATES = ("new", "acknowledged", "resolved", "rejected", "duplicate")
# End of fixed values.


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def aud_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(any_null(cols))


def aud_unique_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column unique on its own: (column, value, n) for every duplicated value."""
    parts = [
        df.groupBy(F.col(c).cast("string").alias("value")).count().where(F.col("count") > 1)
        .select(F.lit(c).alias("column"), "value", F.col("count").cast("bigint").alias("n"))
        for c in cols
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def aud_unique_combo(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column combination unique: the duplicated combinations with their count."""
    return df.groupBy(*cols).count().where(F.col("count") > 1).withColumnRenamed("count", "n")


def out_of_range(col: str = "score") -> Column:
    s = F.col(col)
    return s.isNull() | (s < 0) | (s > 1)


def aud_score_range(df: DataFrame, col: str = "score") -> DataFrame:
    return df.where(out_of_range(col))


def join_audit_archived(mart: DataFrame, projects: DataFrame) -> DataFrame:
    """Mart rows whose newest project snapshot is archived (inner join, archived only)."""
    p = win_latest_project(projects.select("purl", "archived", "ingest_date")).where(F.col("archived") == True)  # noqa: E712
    return mart.join(p, mart.project_purl == p.purl).select(mart["*"])


def aud_no_archived(mart: DataFrame, projects: DataFrame) -> DataFrame:
    return join_audit_archived(mart, projects).select("id")


def no_state(col: str = "state") -> Column:
    s = F.col(col)
    return s.isNull() | ~s.isin(*STATES)


def aud_state(df: DataFrame, col: str = "state") -> DataFrame:
    return df.where(no_state(col)).select(col)


def aud_to_state(transitions: DataFrame) -> DataFrame:
    return aud_state(transitions, "to_state")


@dataclass(frozen=True)
class Audit:
    """An audit of a model: a rule on rows, sets of columns that have to be unique, or a query of its violations."""

    name: str
    model: str
    row: Column | None = None
    unique: Sequence[Sequence[str]] = ()
    run: Callable[[], DataFrame] | None = None


def audit_model(df: DataFrame, audits: Sequence[Audit]) -> DataFrame:
    """The counts of all row and uniqueness audits of a model in one scan: (audit, model, violations).

    A row gives one record for itself, with its row violations, and one for each
    set of columns that has to be unique; of these, values met more than once count.
    """
    rows = [a for a in audits if a.row is not None]
    sets = [(a, cols) for a in audits for cols in a.unique]
    own = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("value"),
                   *[a.row.cast("int").alias(f"r{i}") for i, a in enumerate(rows)])
    keyed = [
        F.struct(F.lit(str(i)).alias("rule"), F.to_json(F.struct(*cols)).alias("value"), *[F.lit(0).alias(f"r{k}") for k in range(len(rows))])
        for i, (_, cols) in enumerate(sets)
    ]
    records = df.select(F.inline(F.array(own, *keyed)))
    by_value = records.groupBy("rule", "value").agg(F.count("*").alias("n"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rows))])
    total = by_value.agg(
        *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(rows))],
        *[F.count_if((F.col("rule") == str(i)) & (F.col("n") > 1)).alias(f"u{i}") for i in range(len(sets))],
    )
    out = []
    for a in audits:
        parts = [F.col(f"r{i}") for i, x in enumerate(rows) if x is a] + [F.col(f"u{i}") for i, (x, _) in enumerate(sets) if x is a]
        out.append(F.struct(F.lit(a.name).alias("audit"), F.lit(a.model).alias("model"), reduce(lambda x, y: x + y, parts).cast("bigint").alias("violations")))
    return total.select(F.inline(F.array(*out)))


def run_audits(audits: Sequence[Audit], models: dict[str, DataFrame]) -> DataFrame:
    """One row per audit: (audit, model, violations). One scan a model, and one query for each audit over several."""
    parts = []
    for name in dict.fromkeys(a.model for a in audits):
        own = [a for a in audits if a.model == name and a.run is None]
        parts += [audit_model(models[name], own)] if own else []
    for a in audits:
        if a.run is not None:
            found = a.run().agg(F.count(F.lit(1)).cast("bigint").alias("violations"))
            parts.append(found.select(F.lit(a.name).alias("audit"), F.lit(a.model).alias("model"), "violations"))
    return reduce(lambda x, y: x.unionByName(y), parts)


def assert_audits(audits: Sequence[Audit], models: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """Block the plan: raise when any audit has violations. Collects one row per audit."""
    rows = [(r.audit, r.model, r.violations) for r in run_audits(audits, models).collect()]
    bad = [r for r in rows if r[2] > 0]
    if bad:
        raise AssertionError(f"audits failed: {bad}")
    return rows


def model_audits(models: dict[str, DataFrame]) -> list[Audit]:
    """The audits attached to the staging models and the two marts; those of a model that isn't given are left out."""
    adv, proj, tr = "staging.advisories", "staging.projects", "staging.opportunity_transitions"
    dep, rep, mart, state = "staging.dependents", "staging.replacements", "marts.opportunities", "marts.opportunity_state"
    every = [
        Audit("not_null", adv, row=any_null(["id", "project_purl", "ingest_date"])),
        Audit("unique_combination_of_columns", adv, unique=[["id", "ingest_date"]]),
        Audit("not_null", proj, row=any_null(["purl", "ecosystem", "name", "ingest_date"])),
        Audit("not_null", tr, row=any_null(["dedupe_key", "to_state", "transitioned_at", "ingest_date"])),
        Audit("valid_to_state", tr, row=no_state("to_state")),
        Audit("not_null", dep, row=any_null(["parent_purl", "dependent_purl", "ingest_date"])),
        Audit("unique_combination_of_columns", dep, unique=[["parent_purl", "dependent_purl", "ingest_date"]]),
        Audit("not_null", rep, row=any_null(["id", "from_purl", "axis", "effort", "ingest_date"])),
        Audit("unique_combination_of_columns", rep, unique=[["id", "from_purl", "ingest_date"]]),
        Audit("not_null", mart, row=any_null(["id", "kind", "project_purl", "dedupe_key", "score"])),
        Audit("unique_values", mart, unique=[["id"], ["dedupe_key"]]),
        Audit("score_in_range", mart, row=out_of_range()),
        Audit("not_null", state, row=any_null(["dedupe_key", "kind", "project_purl", "first_seen_at", "last_seen_at", "state"])),
        Audit("unique_values", state, unique=[["dedupe_key"]]),
        Audit("valid_opportunity_state", state, row=no_state()),
    ]
    if proj in models:
        every.append(Audit("no_archived_active_opps", mart, run=lambda: aud_no_archived(models[mart], models[proj])))
    return [a for a in every if a.model in models]


def block(models: dict[str, DataFrame]) -> None:
    """Raise if any audit of the models has violations."""
    assert_audits(model_audits(models), models)
