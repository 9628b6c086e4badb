"""Triage listing over published briefs: slim rows, optional filters, multi-key sort, facets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.functions import scoring as S
from ranktide.functions.rounding import round_one_place
from ranktide.functions.util import ts_ntz
from ranktide.plans.briefs import agg_tags
from ranktide.session import DEFAULT_AS_OF

# Score bands.
BAND_HIGH = 70
BAND_MID = 50
# End of fixed values.


def _round1(x) -> Column:
    """Round half up to one decimal (the listing's display rounding)."""
    return F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)


def prj_triage_row(briefs: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Slim listing row per brief."""
    conf = S.confidence("last_pr_merged_at", ts_ntz(as_of))
    tags = F.col("tags") if "tags" in briefs.columns else agg_tags(briefs)
    return briefs.select(
        F.col("slug"),
        F.col("ecosystem"),
        # The published numbers are rounded half to even first, and these are shown.
        _round1(round_one_place("score")).alias("score"),
        _round1(round_one_place("impact")).alias("impact"),
        _round1(round_one_place("effort")).alias("effort"),
        F.floor(F.bround(conf, 0) + F.lit(0.5)).cast("bigint").alias("confidence"),
        F.col("opp_count").cast("bigint").alias("opps"),
        F.coalesce(F.col("top_kind"), F.lit("")).alias("top_kind"),
        F.coalesce(F.date_format("last_pr_merged_at", "yyyy-MM-dd"), F.lit("")).alias("last_pr_merged"),
        F.when(F.col("has_benchmarks") == True, "yes").when(F.col("has_benchmarks") == False, "no").otherwise("?").alias("bench"),  # noqa: E712
        F.when(F.coalesce(F.col("archived"), F.lit(False)), "yes").otherwise("no").alias("archived"),
        tags.alias("tags"),
        F.date_format(ts_ntz(as_of), "yyyy-MM-dd").alias("date"),
        F.coalesce(F.col("repo_url"), F.lit("")).alias("repo_url"),
    )


def published_rows(published: DataFrame) -> DataFrame:
    """The slim listing row of each published brief, from its frontmatter alone (``publish.src_briefs_read``)."""
    fm, text = F.col("fm"), lambda c: F.coalesce(c, F.lit(""))
    has = fm["benchmarks"]["has"]
    return published.select(
        F.col("slug"),
        F.col("ecosystem"),
        *[_round1(fm["score"][c]).alias(name) for c, name in (("total", "score"), ("impact", "impact"), ("effort", "effort"))],
        fm["score"]["confidence"].cast("bigint").alias("confidence"),
        fm["opportunities"]["count"].cast("bigint").alias("opps"),
        text(F.col("top_kind")).alias("top_kind"),
        text(F.substring(fm["maintainer_activity"]["last_pr_merged_at"], 1, 10)).alias("last_pr_merged"),
        F.when(has, "yes").when(~has, "no").otherwise("?").alias("bench"),
        F.when(F.coalesce(fm["project"]["archived"], F.lit(False)), "yes").otherwise("no").alias("archived"),
        F.col("tags"),
        fm["date"].alias("date"),
        text(fm["project"]["repo_url"]).alias("repo_url"),
    )


def prj_score_band(score="score") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= BAND_HIGH, "high").when(s >= BAND_MID, "mid").otherwise("low")


@dataclass(frozen=True)
class TriageFilter:
    ecosystem: str | None = None
    kind: str | None = None
    tag: str | None = None
    bench: str | None = None  # "yes" / "no" / None
    hide_archived: bool = True
    min_score: float = 0.0
    search: str | None = None


def flt_triage(rows: DataFrame, f: TriageFilter) -> DataFrame:
    """Conjunction of the optional filters (each absent filter is a no-op)."""
    cond = F.lit(True)
    if f.ecosystem:
        cond = cond & (F.col("ecosystem") == f.ecosystem)
    if f.kind:
        cond = cond & (F.col("top_kind") == f.kind)
    if f.tag:
        cond = cond & F.array_contains("tags", f.tag)
    if f.bench in ("yes", "no"):
        cond = cond & (F.col("bench") == f.bench)
    if f.hide_archived:
        cond = cond & (F.col("archived") != "yes")
    cond = cond & (F.col("score") >= F.lit(float(f.min_score or 0)))
    if f.search:
        cond = cond & F.lower(F.col("slug")).contains(f.search.lower())
    return rows.where(cond)


def sort_multi_key(rows: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Stable multi-key sort (user directions); missing strings sort as ''; ties fall back to score, slug."""
    string_cols = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    order = []
    for col, desc in keys:
        c = F.coalesce(F.col(col), F.lit("")) if col in string_cols else F.col(col)
        order.append(c.desc() if desc else c.asc())
    order += [F.col("score").desc(), F.col("slug").asc()]
    return rows.orderBy(*order)


def agg_triage_facets(rows: DataFrame) -> DataFrame:
    """Distinct sorted ecosystems, top kinds and tags (one row; each a small distinct set)."""
    rows = rows.select("ecosystem", "top_kind", F.explode_outer("tags").alias("tag")).distinct()
    return rows.agg(
        F.array_sort(F.collect_set(F.when(F.col("ecosystem") != "", F.col("ecosystem")))).alias("ecosystems"),
        F.array_sort(F.collect_set(F.when(F.col("top_kind") != "", F.col("top_kind")))).alias("kinds"),
        F.array_sort(F.collect_set("tag")).alias("tags"),
    )


def triage_listing(rows: DataFrame, f: TriageFilter = TriageFilter(), keys: Sequence[tuple[str, bool]] = (("score", True),)) -> DataFrame:
    """Filtered and sorted listing rows with their score band."""
    return sort_multi_key(flt_triage(rows, f), keys).withColumn("band", prj_score_band("score"))
