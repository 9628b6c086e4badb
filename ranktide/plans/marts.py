"""Warehouse marts: scored opportunities and their cross-run lifecycle state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.functions import scoring as S
from ranktide.functions.util import as_col, ts_ntz
from ranktide.operators import windows as W
from ranktide.session import DEFAULT_AS_OF, cut_lineage
from ranktide.sources.versions import BucketedTable

VULN_KIND = "vulnerability-fix"


def dedupe_key(purl, finding_id) -> Column:
    """``<purl>|<finding id>``; NULL when either part is NULL (as SQL ``||``)."""
    return F.concat(as_col(purl), F.lit("|"), as_col(finding_id))


def join_left_latest_project(latest_adv: DataFrame, latest_proj: DataFrame) -> DataFrame:
    """Latest advisory LEFT JOIN latest project on purl (advisories without a project survive)."""
    p = latest_proj.select(
        F.col("purl").alias("p_purl"), "ecosystem", F.col("name").alias("p_name"), "stars",
        "downloads_weekly", "dependents", "archived", "last_pr_merged_at",
    )
    return latest_adv.join(p, latest_adv.project_purl == p.p_purl, "left")


def flt_archived_mart(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("archived"), F.lit(False)))


def mart_opportunities(advisories: DataFrame, projects: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Latest advisories LEFT JOIN latest projects, archived dropped, scored (0..1)."""
    a = W.win_latest_advisory(
        advisories.select("id", "project_purl", "severity", "cvss", "summary", "fixed_versions", "published_at", "ingest_date")
    )
    p = W.win_latest_project(
        projects.select("purl", "ecosystem", "name", "stars", "downloads_weekly", "dependents", "archived", "last_pr_merged_at", "ingest_date")
    )
    j = flt_archived_mart(join_left_latest_project(a, p))
    now = ts_ntz(as_of)
    return j.select(
        F.col("id"),
        F.lit(VULN_KIND).alias("kind"),
        dedupe_key("project_purl", "id").alias("dedupe_key"),
        F.col("project_purl"),
        F.col("ecosystem"),
        F.col("p_name").alias("project_name"),
        F.col("severity").alias("advisory_severity"),
        F.col("cvss").alias("advisory_cvss"),
        F.col("summary").alias("advisory_summary"),
        F.col("fixed_versions").alias("advisory_fixed_versions"),
        F.col("stars").alias("project_stars"),
        F.col("downloads_weekly").alias("project_downloads_weekly"),
        F.col("dependents").alias("project_dependents"),
        S.score_macro("cvss", "downloads_weekly", "stars", "fixed_versions", "summary", "last_pr_merged_at", now).alias("score"),
        now.alias("computed_at"),
    )


def agg_lifecycle(advisories: DataFrame) -> DataFrame:
    """Per (project, id): first/last ingest date and number of distinct partitions.

    Rows are brought together by (project, id) once, for both levels of hash
    aggregation: the distinct count is planned as one keyed by (project, id, date),
    so no group is materialised. A pair is landed on a date once, so nothing could
    be combined before that.
    """
    return advisories.select("project_purl", "id", "ingest_date").repartition("project_purl", "id").groupBy("project_purl", "id").agg(
        F.min("ingest_date").alias("first_seen"),
        F.max("ingest_date").alias("last_seen"),
        F.count_distinct("ingest_date").alias("partition_count"),
    )


LIFECYCLE = "project_purl string, id string, days array<int>"


def lifecycle_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    """The mergeable state of ``agg_lifecycle``: per (project, id) the ordered set of days that it was landed on."""
    return BucketedTable(spark, path, LIFECYCLE, ["project_purl", "id"], buckets)


def update_lifecycle(table: BucketedTable, landed: DataFrame, dates: Sequence[date]) -> int:
    """Bring the state up to date after ``dates`` were landed, or landed again (with other rows, or none).

    ``landed`` is read on these dates only. A key's days on other dates stay; on
    these dates they become what is landed now. Buckets are written that hold a
    key landed on them, or one that was before.
    """
    days = sorted({(d - date(1970, 1, 1)).days for d in dates})
    if not days:
        return table.versions.current()[0]
    day = F.date_diff("ingest_date", F.lit("1970-01-01").cast("date"))
    fresh = landed.where(F.col("ingest_date").isin(*sorted(set(dates)))).groupBy("project_purl", "id")
    fresh = cut_lineage(fresh.agg(F.array_sort(F.collect_set(day)).alias("days")))  # at most as many as ``dates``
    renewed = F.array(*[F.lit(d) for d in days])

    def touched(rows: DataFrame) -> DataFrame:
        return rows.where(F.arrays_overlap("days", renewed)).select(*table.key)

    def combine(rows: DataFrame) -> DataFrame:
        kept = rows.withColumn("days", F.array_except("days", renewed))
        both = table.clustered(kept.unionByName(fresh)).groupBy("_bucket", *table.key)
        both = both.agg(F.array_sort(F.flatten(F.collect_list("days"))).alias("days"))
        return both.where(F.size("days") > 0)

    return table.update(touched, combine, new=fresh.select(*table.key))


def read_lifecycle(table: BucketedTable) -> DataFrame:
    """What ``agg_lifecycle`` gives over all dates landed so far."""
    on = lambda i: F.date_add(F.lit("1970-01-01").cast("date"), F.element_at("days", i))
    return table.read().select(
        "project_purl", "id", on(1).alias("first_seen"), on(-1).alias("last_seen"), F.size("days").cast("bigint").alias("partition_count")
    )


def join_lifecycle(opps: DataFrame, lifecycle: DataFrame) -> DataFrame:
    l = lifecycle.withColumnRenamed("project_purl", "l_purl").withColumnRenamed("id", "l_id")
    return opps.join(l, (opps.project_purl == l.l_purl) & (opps.id == l.l_id), "left")


def join_latest_transition(df: DataFrame, latest_transitions: DataFrame) -> DataFrame:
    t = latest_transitions.select(
        F.col("dedupe_key").alias("t_key"), "to_state", "transitioned_at", "actor", "reason"
    )
    return df.join(t, df.dedupe_key == t.t_key, "left")


def models(staged: dict[str, DataFrame], as_of: str = DEFAULT_AS_OF) -> dict:
    """The staging models and the marts over them, in the order in which they are built; marts are functions of what was
    built before."""
    adv, proj, tr = "staging.advisories", "staging.projects", "staging.opportunity_transitions"
    return {f"staging.{name}": df for name, df in staged.items()} | {
        "marts.opportunities": lambda m: mart_opportunities(m[adv], m[proj], as_of),
        "marts.opportunity_state": lambda m: mart_opportunity_state(m["marts.opportunities"], m[adv], m[tr], as_of),
    }


def mart_opportunity_state(
    opportunities: DataFrame, advisories: DataFrame | None, transitions: DataFrame, as_of: str = DEFAULT_AS_OF,
    lifecycle: DataFrame | None = None,
) -> DataFrame:
    """Lifecycle (first/last seen, partition count) + newest transition state per dedupe key.

    ``lifecycle`` is that of a kept state (``read_lifecycle``); without it all advisories are aggregated.
    """
    o = opportunities.select("id", "dedupe_key", "kind", "project_purl")
    lc = lifecycle if lifecycle is not None else agg_lifecycle(advisories.select("project_purl", "id", "ingest_date"))
    lt = W.win_latest_transition(transitions)
    j = join_latest_transition(join_lifecycle(o, lc), lt)
    return j.select(
        F.col("dedupe_key"),
        F.col("kind"),
        F.col("project_purl"),
        F.col("first_seen").cast("timestamp_ntz").alias("first_seen_at"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen_at"),
        F.col("partition_count").cast("bigint").alias("partition_count"),
        F.coalesce(F.col("to_state"), F.lit("new")).alias("state"),
        F.col("transitioned_at").alias("state_transitioned_at"),
        F.col("actor").alias("state_actor"),
        F.col("reason").alias("state_reason"),
        ts_ntz(as_of).alias("computed_at"),
    )
