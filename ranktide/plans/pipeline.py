"""End-to-end ranking: findings -> projects -> opportunities -> briefs -> quota selection.

Ordering semantics: every "first seen" / "stable" rule of the reference is an
explicit ``order`` struct carried on each finding::

    order = STRUCT<src INT, k1 BIGINT, k2 BIGINT, k3 STRING, k4 BIGINT>

advisories use ``(0, severity class, page position, id, package position)``,
fan-outs ``(1, -from-package downloads, first appearance, '', dependent rank)``. Every sort
ends in this struct, so results are deterministic and equal to the reference's
insertion-ordered loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.functions import scoring as S
from ranktide.functions.hashes import uuid5
from ranktide.functions.strings import canonical_repo, permalink_locations, pr_title, purl_name, repo_name, repo_owner, slug
from ranktide.functions.util import ts_ntz
from ranktide.operators.filters import MIN_WEEKLY_DOWNLOADS, eligible
from ranktide.operators.windows import top_k_per_group
from ranktide.plans.marts import dedupe_key
from ranktide.session import DEFAULT_AS_OF
from ranktide.sources.lookups import one_per_repository

VULN = "vulnerability-fix"
PERF = "perf-replacement"
DEP = "dep-replacement"
# Fixed values (run defaults).
MAX_OPPS_PER_PROJECT = 6
TOP_N = 20
# End of fixed values.

def _order(src: int, k1, k2, k3, k4) -> Column:
    return F.struct(
        F.lit(src).cast("int").alias("src"), k1.cast("bigint").alias("k1"), k2.cast("bigint").alias("k2"),
        k3.cast("string").alias("k3"), k4.cast("bigint").alias("k4"),
    )


# ---- findings -------------------------------------------------------------------------------

def vuln_findings(advisories: DataFrame) -> DataFrame:
    """Flattened advisories keyed by package purl, with their emission order."""
    return advisories.withColumn(
        "order", _order(0, F.col("sev_rank"), F.col("page_pos"), F.col("id"), F.col("vuln_pos"))
    )


def fan_findings(fan: DataFrame) -> DataFrame:
    """Verified (replacement, dependent) pairs keyed by the dependent's purl, in candidate order."""
    return fan.withColumn(
        "order", _order(1, -F.coalesce(F.col("from_downloads"), F.lit(0)), F.col("first_seq"), F.lit(""), F.col("dep_rank"))
    )


def set_union_findings(vf: DataFrame, ff: DataFrame) -> DataFrame:
    """Advisories and fan-outs as one finding stream keyed by project purl."""
    a = vf.select(F.col("project_purl"), F.col("repo_url"), F.col("order"), F.lit(False).alias("is_fanout"))
    b = ff.select(F.col("dep_purl").alias("project_purl"), F.col("dep_repo_url").alias("repo_url"), F.col("order"), F.lit(True).alias("is_fanout"))
    return a.unionByName(b)


def agg_by_project(findings: DataFrame) -> DataFrame:
    """One row per project: first appearance, first non-empty repo URL (advisories first), has fan-outs.

    ``min`` over structs is an ordinary partial/final aggregate, so a project
    with millions of findings still shuffles one row per map task.
    """
    has_repo = F.coalesce(F.col("repo_url"), F.lit("")) != ""
    return findings.groupBy("project_purl").agg(
        F.min("order").alias("first_order"),
        F.min(F.when(has_repo, F.struct(F.col("order"), F.col("repo_url")))).alias("__repo"),
        F.max(F.col("is_fanout").cast("int")).cast("boolean").alias("has_replacements"),
        F.count(F.lit(1)).alias("n_findings"),
    ).select("project_purl", "first_order", F.col("__repo.repo_url").alias("repo_url"), "has_replacements", "n_findings")


# ---- hydrate + eligibility --------------------------------------------------------------------

def hydrate_projects(by_project: DataFrame, downloads: DataFrame, repo_meta: DataFrame, bench: DataFrame | None = None,
                     ecosystem: str = "npm") -> DataFrame:
    """Attach downloads (by short name), repository metadata (by repo URL) and bench info.

    Unknown repo -> not archived, no merge time, no SHA. Bench info is read only
    for projects with replacements and a repo URL; unreachable -> (false, NULL).
    Stars are never filled by this pipeline (they stay NULL).
    """
    p = by_project.withColumn("name", purl_name("project_purl"))
    d = downloads.select(F.col("name").alias("__dn"), F.col("downloads_weekly"))
    p = p.join(d, p["name"] == d["__dn"], "left").drop("__dn")
    # Metadata is looked up by the parsed (owner, repo), one row per repository.
    m = one_per_repository(repo_meta).select(
        F.col("owner").alias("__mo"), F.col("repo").alias("__mr"), F.col("is_archived"), F.col("last_merged_pr_at"), F.col("head_sha")
    )
    p = p.withColumn("__ow", repo_owner("repo_url")).withColumn("__rp", repo_name("repo_url"))
    p = p.join(m, (p["__ow"] == m["__mo"]) & (p["__rp"] == m["__mr"]), "left").drop("__ow", "__rp", "__mo", "__mr")
    probe = F.col("has_replacements") & (F.coalesce(F.col("repo_url"), F.lit("")) != "")
    if bench is not None:
        b = bench.select(F.col("repo_url").alias("__bu"), F.col("has_benchmarks").alias("__bh"), F.col("bench_signal").alias("__bs"))
        p = p.join(b, canonical_repo(p["repo_url"]) == b["__bu"], "left").drop("__bu")
    else:
        p = p.withColumn("__bh", F.lit(None).cast("boolean")).withColumn("__bs", F.lit(None).cast("string"))
    return p.select(
        F.col("project_purl").alias("purl"),
        F.lit(ecosystem).alias("ecosystem"),
        F.col("name"),
        F.col("repo_url"),
        F.lit(None).cast("bigint").alias("stars"),
        F.col("downloads_weekly"),
        F.col("last_merged_pr_at").alias("last_pr_merged_at"),
        F.coalesce(F.col("is_archived"), F.lit(False)).alias("archived"),
        F.col("head_sha"),
        F.when(probe, F.coalesce(F.col("__bh"), F.lit(False))).alias("has_benchmarks"),
        F.when(probe, F.col("__bs")).alias("bench_signal"),
        F.col("first_order"),
        F.col("has_replacements"),
    )


def eligible_projects(projects: DataFrame, floor: int = MIN_WEEKLY_DOWNLOADS) -> DataFrame:
    return projects.where(eligible("archived", "downloads_weekly", floor))


# ---- opportunities ------------------------------------------------------------------------------

def _project_cols(p: DataFrame) -> DataFrame:
    return p.select(
        F.col("purl").alias("p_purl"), F.col("name").alias("project_name"), "stars", "downloads_weekly",
        "last_pr_merged_at", F.col("repo_url").alias("p_repo_url"), "head_sha",
    )


def opp_vulnerability(vf: DataFrame, projects: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """Scored vulnerability opportunities (same advisory id inside one project: first seen wins)."""
    first = top_k_per_group(vf, ["project_purl", "id"], [F.col("order").asc()], 1)
    p = _project_cols(projects)
    j = first.join(p, first.project_purl == p.p_purl)
    now = ts_ntz(as_of)
    key = dedupe_key("project_purl", "id")
    # Stepwise columns: each sub-score is computed once and referenced by name.
    j = (
        j.withColumn("__imp", S.impact(S.popularity("downloads_weekly", "stars"), S.severity("cvss")))
        .withColumn("__eff", S.effort("fixed_versions", "summary"))
        .withColumn("__conf", S.confidence("last_pr_merged_at", now))
        .withColumn("__key", key)
    )
    imp, eff, conf, key = F.col("__imp"), F.col("__eff"), F.col("__conf"), F.col("__key")
    return j.select(
        uuid5(key).alias("opp_id"),
        F.lit(VULN).alias("kind"),
        F.col("project_purl"),
        F.col("project_name"),
        F.col("id").alias("finding_id"),
        key.alias("dedupe_key"),
        imp.alias("impact"),
        eff.alias("effort"),
        S.final_score(imp, eff, conf).alias("score"),
        F.col("order"),
        F.struct("id", "severity", "cvss", "summary", "affected_versions", "fixed_versions", "repo_url").alias("advisory"),
        F.lit(None).cast("struct<id:string,from_purl:string,to_purls:array<string>,axis:string,effort:string,manifest:string,manifest_line:bigint>").alias("replacement"),
        F.array().cast("array<struct<file:string,line:int,url:string>>").alias("dependency_locations"),
        pr_title(F.lit(VULN), F.col("project_name"), F.col("id"), F.col("fixed_versions"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("pr_title"),
    )


def opp_replacement(ff: DataFrame, projects: DataFrame, as_of: str = DEFAULT_AS_OF, locations: DataFrame | None = None) -> DataFrame:
    """Scored replacement opportunities for the dependent project (one per from-package: easiest wins)."""
    w = Window.partitionBy("dep_purl", "from_purl")
    ranked = ff.withColumn("first_order", F.min("order").over(w))
    best = top_k_per_group(ranked, ["dep_purl", "from_purl"], [F.col("effort_score").desc(), F.col("order").asc()], 1)
    p = _project_cols(projects)
    j = best.join(p, best.dep_purl == p.p_purl)
    if locations is not None:
        l = locations.select(F.col("dep_purl").alias("__ld"), F.col("from_purl").alias("__lf"), F.col("locations"))
        j = j.join(l, (j.dep_purl == l["__ld"]) & (j.from_purl == l["__lf"]), "left").drop("__ld", "__lf")
    else:
        j = j.withColumn("locations", F.lit(None).cast("array<struct<file:string,line:int>>"))
    now = ts_ntz(as_of)
    kind = F.when(F.col("axis") == "perf", F.lit(PERF)).otherwise(F.lit(DEP))
    j = (
        j.withColumn("__imp", S.impact(S.popularity("downloads_weekly", "stars"), S.replacement_severity("axis", S.is_native("to_purls"))))
        .withColumn("__eff", S.effort_band_score("effort"))
        .withColumn("__conf", S.confidence("last_pr_merged_at", now))
        .withColumn("__key", dedupe_key("dep_purl", "rep_id"))
    )
    imp, eff, conf, key = F.col("__imp"), F.col("__eff"), F.col("__conf"), F.col("__key")
    return j.select(
        uuid5(key).alias("opp_id"),
        kind.alias("kind"),
        F.col("dep_purl").alias("project_purl"),
        F.col("project_name"),
        F.col("rep_id").alias("finding_id"),
        key.alias("dedupe_key"),
        imp.alias("impact"),
        eff.alias("effort"),
        S.final_score(imp, eff, conf).alias("score"),
        F.col("first_order").alias("order"),
        F.lit(None).cast("struct<id:string,severity:string,cvss:double,summary:string,affected_versions:string,fixed_versions:array<string>,repo_url:string>").alias("advisory"),
        F.struct(
            F.col("rep_id").alias("id"), "from_purl", "to_purls", "axis", "effort", "manifest",
            F.col("manifest_line").cast("bigint").alias("manifest_line"),
        ).alias("replacement"),
        permalink_locations(F.col("p_repo_url"), F.col("head_sha"), F.col("locations")).alias("dependency_locations"),
        pr_title(kind, F.col("project_name"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col("from_purl"), F.col("to_purls")).alias("pr_title"),
    )


def win_top_opps(opps: DataFrame, k: int = MAX_OPPS_PER_PROJECT) -> DataFrame:
    """Best k per project by score; ties keep advisories first, then first appearance."""
    return top_k_per_group(opps, ["project_purl"], [F.col("score").desc(), F.col("order").asc()], k, rank_col="opp_rank")


# ---- briefs ---------------------------------------------------------------------------------

def agg_brief(top_opps: DataFrame, projects: DataFrame) -> DataFrame:
    """One brief per project: ordered opportunities (<= k, so the collect is bounded), head numbers."""
    opp = F.struct(
        "opp_rank", "opp_id", "kind", "finding_id", "dedupe_key", "impact", "effort", "score",
        "advisory", "replacement", "dependency_locations", "pr_title",
    )
    g = top_opps.groupBy("project_purl").agg(
        F.sort_array(F.collect_list(opp)).alias("opportunities"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    head = F.col("opportunities")[0]
    p = projects.select(
        F.col("purl").alias("__p"), "name", "ecosystem", "repo_url", "downloads_weekly", "archived",
        "has_benchmarks", "bench_signal", "last_pr_merged_at", "first_order", "head_sha",
    )
    j = g.join(p, g.project_purl == p["__p"]).drop("__p")
    return j.select(
        "project_purl", "name", slug(F.col("name")).alias("slug"), "ecosystem", "repo_url", "downloads_weekly",
        "archived", "has_benchmarks", "bench_signal", "last_pr_merged_at", "first_order",
        head["score"].alias("score"), head["impact"].alias("impact"), head["effort"].alias("effort"),
        F.size("opportunities").alias("opp_count"), "kinds", head["kind"].alias("top_kind"),
        F.col("opportunities"),
    )


def sort_briefs(briefs: DataFrame) -> DataFrame:
    """All briefs by score desc; ties by first appearance (range-partitioned global sort)."""
    return briefs.orderBy(F.col("score").desc(), F.col("first_order").asc())


def top_axis_quota(briefs: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Top-N briefs with a floor of ``top_n // 3`` replacement-led ones; unused vuln slots spill over.

    Each class is cut to its own top N first (``TakeOrderedAndProject``), so the
    closed-form selection below sees at most ``2 * top_n`` rows - a bound set by
    the parameter, not by the data. With V, R the class sizes capped at N and
    q = N div 3: ``r = min(q, R)``, ``v = min(V, N - r)``, ``r = min(R, r + (N - r - v))``.
    """
    is_vuln = F.col("top_kind") == VULN
    order = [F.col("score").desc(), F.col("first_order").asc()]
    v = briefs.where(is_vuln).orderBy(*order).limit(top_n).withColumn("cls", F.lit(0))
    r = briefs.where(~is_vuln).orderBy(*order).limit(top_n).withColumn("cls", F.lit(1))
    both = v.unionByName(r)
    # Bounded (<= 2N rows): class counts and in-class ranks via small windows.
    all_w = Window.partitionBy(F.lit(1))
    cls_w = Window.partitionBy("cls").orderBy(*order)
    x = (
        both.withColumn("in_cls_rank", F.row_number().over(cls_w))
        .withColumn("n_v", F.sum(1 - F.col("cls")).over(all_w))
        .withColumn("n_r", F.sum("cls").over(all_w))
    )
    q = top_n // 3
    r_take0 = F.least(F.lit(q), F.col("n_r"))
    v_take = F.least(F.col("n_v"), F.lit(top_n) - r_take0)
    r_take = F.least(F.col("n_r"), F.lit(top_n) - v_take)
    chosen = x.where(
        ((F.col("cls") == 0) & (F.col("in_cls_rank") <= v_take)) | ((F.col("cls") == 1) & (F.col("in_cls_rank") <= r_take))
    )
    return chosen.drop("n_v", "n_r")


def agg_selected_summary(all_briefs: DataFrame, selected: DataFrame) -> DataFrame:
    """total / selected / vuln-led / replacement-led counts (two global aggregates, one row each)."""
    t = all_briefs.agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    s = selected.agg(
        F.count(F.lit(1)).cast("bigint").alias("top"),
        F.count_if(F.col("top_kind") == VULN).cast("bigint").alias("vuln"),
        F.count_if(F.col("top_kind") != VULN).cast("bigint").alias("replacement"),
    )
    return t.withColumn("__k", F.lit(1)).join(s.withColumn("__k", F.lit(1)), "__k").drop("__k")


# ---- composition ----------------------------------------------------------------------------

def rank_briefs(advisories: DataFrame, fan: DataFrame, downloads: DataFrame, repo_meta: DataFrame,
                as_of: str = DEFAULT_AS_OF, floor: int = MIN_WEEKLY_DOWNLOADS, bench: DataFrame | None = None,
                locations: DataFrame | None = None, max_opps: int = MAX_OPPS_PER_PROJECT,
                stage: Callable[[DataFrame], DataFrame] = lambda d: d, ecosystem: str = "npm") -> dict[str, DataFrame]:
    """Filtered advisories + verified fan-out pairs -> every intermediate of the ranking.

    ``stage`` is applied at the two natural boundaries (hydrated projects,
    scored opportunities); pass ``session.cut_lineage`` to checkpoint them into
    the cluster's checkpoint folder so a lost executor recomputes only the
    current stage and the optimizer sees short plans.
    """
    vf = vuln_findings(advisories)
    ff = fan_findings(fan)
    findings = set_union_findings(vf, ff)
    by_project = agg_by_project(findings)
    projects = stage(hydrate_projects(by_project, downloads, repo_meta, bench, ecosystem))
    ok = eligible_projects(projects, floor)
    ov = opp_vulnerability(vf, ok, as_of)
    orp = opp_replacement(ff, ok, as_of, locations)
    opps = stage(ov.unionByName(orp))
    top = win_top_opps(opps, max_opps)
    briefs = agg_brief(top, ok)
    return {
        "findings": findings, "by_project": by_project, "projects": projects, "eligible": ok,
        "opp_vulnerability": ov, "opp_replacement": orp, "opps": opps, "top_opps": top, "briefs": briefs,
    }
