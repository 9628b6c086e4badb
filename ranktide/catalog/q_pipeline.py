"""Phase 5 queries: opportunities, per-project briefs, ranking and the axis quota."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ranktide.catalog import q_advisories as QA
from ranktide.catalog import q_fanout as QF
from ranktide.catalog import repo_sql as RS
from ranktide.catalog import sqlfn as Q
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.registry import register
from ranktide.functions.util import r6
from ranktide.operators import windows as W
from ranktide.plans import fanout as FO
from ranktide.plans import pipeline as P
from ranktide.plans import run as R
from ranktide.sources import bridge as B
from ranktide.sources import lookups as L

TOP_N = 20

# ---------------------------------------------------------------------------------------------
# Spark side


def landed(spark, sf):
    """The bridge's frames as a run's landed tables."""
    return R.Landed(
        advisories=B.nested_advisories(spark, sf), registry=B.registry_docs(spark, sf), replacements=B.replacements(spark, sf),
        downloads=L.src_weekly_downloads(W.win_latest_project(B.projects(spark, sf))),
        dependents_cache=B.dependents_cache(spark, sf), sbom_edges=B.sbom_edges(spark, sf),
        repositories=B.repositories(spark, sf), registry_dependents=B.registry_dependents(spark, sf),
        repo_files=B.repo_files(spark, sf), repo_meta=B.repo_meta_docs(spark, sf),
    )


OPTIONS = R.Options(week=QF.CACHE_WEEK, top_n=TOP_N)


def fanout_candidates(spark, sf, top_n=FO.FANOUT_TOP_N):
    """Replacement candidates (the top ``top_n``; None: all) x their tiered dependents, before verification."""
    return R.candidates(landed(spark, sf), replace(OPTIONS, fanout_top_n=top_n))


def ranked(spark, sf):
    """A whole run; its stages are written when this is called."""
    return R.run(landed(spark, sf), OPTIONS)


def _brief_out(df):
    return df.select(
        "project_purl", "slug", r6("score").alias("score"), r6("impact").alias("impact"), r6("effort").alias("effort"),
        "top_kind", F.col("opp_count").cast("bigint").alias("opp_count"), F.array_join("kinds", ",").alias("kinds"),
    )


# ---------------------------------------------------------------------------------------------
# Oracle side: the same chain as CTEs

_ADV_SQL = f"""
adv AS (
  SELECT id, 'pkg:' || lower(eco) || '/' || pkg_name AS project_purl, severity,
         coalesce(CASE WHEN v4_score <> 0 THEN v4_score END, CASE WHEN v3_score <> 0 THEN v3_score END,
                  CASE WHEN legacy_score <> 0 THEN legacy_score END) AS cvss,
         coalesce(summary, '') AS summary, vrange AS affected_versions,
         CASE WHEN has_fix THEN [fixed] ELSE CAST([] AS VARCHAR[]) END AS fixed_versions,
         CASE WHEN source_code_location <> '' THEN source_code_location END AS repo_url,
         (doc_has_fix AND NOT has_fix) AS has_patched_sibling, sev_rank, page_pos, vuln_pos
  FROM flat_docs
  WHERE pkg_name IS NOT NULL AND pkg_name <> '' AND lower(coalesce(eco, '')) = 'npm' AND NOT has_fix
),
adv_ok AS (
  SELECT a.* FROM adv a LEFT JOIN latest l ON l.name = {Q.purl_name('a.project_purl')}
  WHERE NOT coalesce(a.has_patched_sibling, FALSE)
    AND (coalesce(a.affected_versions, '') = '' OR l.latest IS NULL
         OR coalesce({Q.version_in_range('l.latest', 'a.affected_versions')}, TRUE))
),
fanx_all AS (
  SELECT f.from_purl, f.id AS rep_id, f.axis, f.effort, f.to_purls, f.manifest, f.manifest_line, f.seq, f.first_seq,
         f.downloads_weekly, {Q.band_score('f.effort')} AS effort_score,
         t.purl AS dep_purl, t.name AS dep_name, t.repo_url AS dep_repo_url, t.rank AS dep_rank
  FROM top_fanout f JOIN tiered t ON t.parent = {Q.purl_name('f.from_purl')}
),
fcases AS (
  SELECT f.*,
         CASE WHEN coalesce(f.dep_repo_url, '') = '' THEN 'no_repo'
              WHEN v.verdict IS NULL OR v.verdict = 'unknown' THEN 'unknown'
              WHEN v.verdict = 'not_js' THEN 'not_js'
              WHEN v.verdict = 'monorepo' THEN 'monorepo'
              WHEN d.name IS NOT NULL THEN 'direct' ELSE 'transitive' END AS dep_case
  FROM fanx_all f
  LEFT JOIN rverd v ON v.repo_url = {RS.same_repo('f.dep_repo_url')}
  LEFT JOIN dnames d ON d.repo_url = {RS.same_repo('f.dep_repo_url')} AND d.name = {Q.purl_name('f.from_purl')}
),
fanx AS (SELECT * FROM fcases WHERE dep_case IN ('no_repo', 'unknown', 'monorepo', 'direct')),
floc AS (
  SELECT f.dep_purl, f.from_purl, l.locations FROM fanx f
  JOIN rlocs l ON l.repo_url = {RS.same_repo('f.dep_repo_url')} AND l.name = {Q.purl_name('f.from_purl')}
  WHERE f.dep_case = 'direct'
),
findings AS (
  SELECT project_purl, repo_url, 0 AS src, CAST(sev_rank AS BIGINT) AS k1, CAST(page_pos AS BIGINT) AS k2, id AS k3,
         CAST(vuln_pos AS BIGINT) AS k4, FALSE AS is_fanout FROM adv_ok
  UNION ALL
  SELECT dep_purl, dep_repo_url, 1, -coalesce(downloads_weekly, 0), first_seq, '', CAST(dep_rank AS BIGINT), TRUE FROM fanx
),
byp AS (
  SELECT f.project_purl, f.src AS f_src, f.k1 AS f_k1, f.k2 AS f_k2, f.k3 AS f_k3, f.k4 AS f_k4, r.repo_url,
         x.has_repl, x.n_findings
  FROM (SELECT *, row_number() OVER (PARTITION BY project_purl ORDER BY src, k1, k2, k3, k4) AS rn FROM findings) f
  LEFT JOIN (SELECT project_purl, repo_url FROM (
               SELECT *, row_number() OVER (PARTITION BY project_purl ORDER BY src, k1, k2, k3, k4) AS rn
               FROM findings WHERE coalesce(repo_url, '') <> '') WHERE rn = 1) r ON r.project_purl = f.project_purl
  JOIN (SELECT project_purl, bool_or(is_fanout) AS has_repl, count(*) AS n_findings FROM findings GROUP BY project_purl) x
    ON x.project_purl = f.project_purl
  WHERE f.rn = 1
),
hydr AS (
  SELECT b.project_purl AS purl, {Q.purl_name('b.project_purl')} AS name, b.repo_url, CAST(NULL AS BIGINT) AS stars,
         d.downloads_weekly, m.last_merged_pr_at AS last_pr_merged_at, coalesce(m.is_archived, FALSE) AS archived,
         m.head_sha, CASE WHEN b.has_repl AND coalesce(b.repo_url, '') <> '' THEN coalesce(rb.has, FALSE) END AS has_benchmarks,
         CASE WHEN b.has_repl AND coalesce(b.repo_url, '') <> '' THEN rb.sig END AS bench_signal,
         b.has_repl, b.f_src, b.f_k1, b.f_k2, b.f_k3, b.f_k4
  FROM byp b
  LEFT JOIN downloads d ON d.name = {Q.purl_name('b.project_purl')}
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, repo ORDER BY repo_url) AS mrn FROM meta WHERE known)
             WHERE mrn = 1) m
    ON m.owner = nullif(regexp_extract(trim(b.repo_url), '^https?://github\\.com/([^/]+)/([^/?#]+?)(?:\\.git)?/?$', 1), '')
   AND m.repo = nullif(regexp_extract(trim(b.repo_url), '^https?://github\\.com/([^/]+)/([^/?#]+?)(?:\\.git)?/?$', 2), '')
  LEFT JOIN rbench rb ON rb.repo_url = {RS.same_repo('b.repo_url')}
),
elig AS (SELECT * FROM hydr WHERE NOT archived AND coalesce(downloads_weekly >= 50000, TRUE)),
ov AS (
  SELECT a.project_purl, a.id AS finding_id, 'vulnerability-fix' AS kind, a.project_purl || '|' || a.id AS dedupe_key,
         {Q.impact(Q.popularity('p.downloads_weekly', 'p.stars'), Q.severity('a.cvss'))} AS impact,
         {Q.effort('a.fixed_versions', 'a.summary')} AS effort,
         {Q.final(Q.impact(Q.popularity('p.downloads_weekly', 'p.stars'), Q.severity('a.cvss')), Q.effort('a.fixed_versions', 'a.summary'), Q.confidence('p.last_pr_merged_at'))} AS score,
         0 AS src, CAST(a.sev_rank AS BIGINT) AS k1, CAST(a.page_pos AS BIGINT) AS k2, a.id AS k3, CAST(a.vuln_pos AS BIGINT) AS k4,
         p.name AS project_name, a.id AS adv_id, a.fixed_versions, CAST(NULL AS VARCHAR) AS from_purl, CAST(NULL AS VARCHAR[]) AS to_purls
  FROM (SELECT *, row_number() OVER (PARTITION BY project_purl, id ORDER BY sev_rank, page_pos, id, vuln_pos) AS rn FROM adv_ok) a
  JOIN elig p ON p.purl = a.project_purl
  WHERE a.rn = 1
),
orp AS (
  SELECT r.dep_purl AS project_purl, r.rep_id AS finding_id,
         CASE WHEN r.axis = 'perf' THEN 'perf-replacement' ELSE 'dep-replacement' END AS kind,
         r.dep_purl || '|' || r.rep_id AS dedupe_key,
         {Q.impact(Q.popularity('p.downloads_weekly', 'p.stars'), Q.repl_severity('r.axis', Q.is_native('r.to_purls')))} AS impact,
         {Q.band_score('r.effort')} AS effort,
         {Q.final(Q.impact(Q.popularity('p.downloads_weekly', 'p.stars'), Q.repl_severity('r.axis', Q.is_native('r.to_purls'))), Q.band_score('r.effort'), Q.confidence('p.last_pr_merged_at'))} AS score,
         1 AS src, r.fk1 AS k1, r.fk2 AS k2, '' AS k3, r.fk4 AS k4,
         p.name AS project_name, CAST(NULL AS VARCHAR) AS adv_id, CAST(NULL AS VARCHAR[]) AS fixed_versions, r.from_purl, r.to_purls
  FROM (SELECT *,
               row_number() OVER (PARTITION BY dep_purl, from_purl
                                  ORDER BY effort_score DESC, -coalesce(downloads_weekly, 0), first_seq, dep_rank) AS rn,
               first_value(-coalesce(downloads_weekly, 0)) OVER w AS fk1,
               first_value(first_seq) OVER w AS fk2,
               first_value(CAST(dep_rank AS BIGINT)) OVER w AS fk4
        FROM fanx
        WINDOW w AS (PARTITION BY dep_purl, from_purl ORDER BY -coalesce(downloads_weekly, 0), first_seq, dep_rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) r
  JOIN elig p ON p.purl = r.dep_purl
  WHERE r.rn = 1
),
opps AS (SELECT * FROM ov UNION ALL SELECT * FROM orp),
topo AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY project_purl ORDER BY score DESC, src, k1, k2, k3, k4) AS opp_rank FROM opps)
  WHERE opp_rank <= 6
),
briefs AS (
  SELECT t.project_purl, e.name, replace(replace(e.name, '/', '__'), '@', '') AS slug,
         max(CASE WHEN t.opp_rank = 1 THEN t.score END) AS score,
         max(CASE WHEN t.opp_rank = 1 THEN t.impact END) AS impact,
         max(CASE WHEN t.opp_rank = 1 THEN t.effort END) AS effort,
         max(CASE WHEN t.opp_rank = 1 THEN t.kind END) AS top_kind,
         CAST(count(*) AS BIGINT) AS opp_count,
         array_to_string(list_sort(list_distinct(list(t.kind))), ',') AS kinds,
         e.f_src, e.f_k1, e.f_k2, e.f_k3, e.f_k4
  FROM topo t JOIN elig e ON e.purl = t.project_purl
  GROUP BY t.project_purl, e.name, e.f_src, e.f_k1, e.f_k2, e.f_k3, e.f_k4
)"""


def quota_ctes(n: int, suffix: str = "") -> str:
    """Closed-form axis-quota selection of the top ``n`` briefs (CTE names end in ``suffix``)."""
    return f"""
qv{suffix} AS (SELECT *, 0 AS cls FROM briefs WHERE top_kind = 'vulnerability-fix'
       ORDER BY score DESC, f_src, f_k1, f_k2, f_k3, f_k4 LIMIT {n}),
qr{suffix} AS (SELECT *, 1 AS cls FROM briefs WHERE top_kind <> 'vulnerability-fix'
       ORDER BY score DESC, f_src, f_k1, f_k2, f_k3, f_k4 LIMIT {n}),
qboth{suffix} AS (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, f_src, f_k1, f_k2, f_k3, f_k4) AS in_cls_rank,
         sum(1 - cls) OVER () AS n_v, sum(cls) OVER () AS n_r
  FROM (SELECT * FROM qv{suffix} UNION ALL SELECT * FROM qr{suffix})
),
selected{suffix} AS (
  SELECT * FROM (
    SELECT *, least(n_v, {n} - least({n // 3}, n_r)) AS v_take FROM qboth{suffix})
  WHERE (cls = 0 AND in_cls_rank <= v_take) OR (cls = 1 AND in_cls_rank <= least(n_r, {n} - v_take))
)"""


_VIEWS = ["nested_flat", "registry_docs", "replacements", "projects", "dependents_cache", "sbom_edges", "repositories",
          "registry_dependents", "repo_meta_docs"]
_CTES = [QA._FLAT_DOCS, QA._LATEST_SQL, QF._DEDUPE_SQL, QF._DL_SQL, QF._TOP_FANOUT_SQL, QF._REG_SQL, QF._PRIM_SQL,
         QF._TIER_SQL, QA._META_SQL, RS.REPO_CTES, RS.REPO_BENCH_CTE, RS.LOC_CTE, _ADV_SQL, quota_ctes(TOP_N)]


def _sql(body: str) -> str:
    return with_views(_VIEWS, body, _CTES)


_BRIEF_COLS = ("project_purl, slug, round(score, 6) AS score, round(impact, 6) AS impact, round(effort, 6) AS effort, "
               "top_kind, opp_count, kinds")


@register("set_union_findings", _sql("SELECT project_purl, is_fanout, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY project_purl, is_fanout"))
def set_union_findings(spark, sf):
    """Advisories (by package) and fan-outs (by dependent) as one finding stream; counts per project and source."""
    f = ranked(spark, sf)["findings"]
    return f.groupBy("project_purl", "is_fanout").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("agg_by_project", _sql("SELECT project_purl, repo_url, has_repl AS has_replacements, CAST(n_findings AS BIGINT) AS n_findings FROM byp"))
def agg_by_project(spark, sf):
    """Per project: first non-empty repo URL (advisories first), has fan-outs, number of findings."""
    b = ranked(spark, sf)["by_project"]
    return b.select("project_purl", "repo_url", "has_replacements", F.col("n_findings").cast("bigint").alias("n_findings"))


@register("opp_vulnerability", _sql("SELECT dedupe_key, project_purl, round(impact, 6) AS impact, effort, round(score, 6) AS score FROM ov"))
def opp_vulnerability(spark, sf):
    o = ranked(spark, sf)["opp_vulnerability"]
    return o.select("dedupe_key", "project_purl", r6("impact").alias("impact"), "effort", r6("score").alias("score"))


@register("opp_replacement", _sql("SELECT dedupe_key, project_purl, kind, round(impact, 6) AS impact, effort, round(score, 6) AS score FROM orp"))
def opp_replacement(spark, sf):
    o = ranked(spark, sf)["opp_replacement"]
    return o.select("dedupe_key", "project_purl", "kind", r6("impact").alias("impact"), "effort", r6("score").alias("score"))


@register("fn_uuid5", _sql(f"SELECT dedupe_key, {Q.uuid5('dedupe_key')} AS opp_id FROM opps"))
def fn_uuid5(spark, sf):
    """Opportunity id = UUIDv5 (URL namespace) of ``<project purl>|<finding id>``."""
    return ranked(spark, sf)["opps"].select("dedupe_key", "opp_id")


_TITLE_SQL = """
SELECT dedupe_key,
  CASE WHEN kind = 'vulnerability-fix' AND adv_id IS NOT NULL THEN
         CASE WHEN len(fixed_versions) > 0 THEN 'fix(deps): bump ' || project_name || ' to ' || fixed_versions[1] || ' (' || adv_id || ')'
              ELSE 'fix: address ' || adv_id || ' in ' || project_name END
       WHEN kind IN ('dep-replacement', 'perf-replacement') AND from_purl IS NOT NULL THEN
         CASE WHEN tgt = 'native' THEN scope || ': drop ' || fname || ' dep (use native API)'
              ELSE scope || '(deps): replace ' || fname || ' with ' || coalesce(tgt, '') END
       ELSE 'chore(' || project_name || '): improvement opportunity' END AS pr_title
FROM (
  SELECT *, CASE WHEN kind = 'perf-replacement' THEN 'perf' ELSE 'deps' END AS scope,
         CASE WHEN starts_with(from_purl, 'pkg:npm/') THEN substr(from_purl, 9) ELSE from_purl END AS fname,
         regexp_replace(regexp_replace(split_part(to_purls[1], '/', -1), '^<+', ''), '>+$', '') AS tgt
  FROM opps)"""


@register("fn_pr_title", _sql(_TITLE_SQL))
def fn_pr_title(spark, sf):
    """Suggested PR title for every opportunity (five shapes)."""
    return ranked(spark, sf)["opps"].select("dedupe_key", "pr_title")


@register("win_top_opps", _sql("SELECT project_purl, dedupe_key, CAST(opp_rank AS BIGINT) AS opp_rank FROM topo"))
def win_top_opps(spark, sf):
    """Best 6 opportunities per project; ties keep advisories first, then first appearance."""
    t = ranked(spark, sf)["top_opps"]
    return t.select("project_purl", "dedupe_key", F.col("opp_rank").cast("bigint").alias("opp_rank"))


@register("agg_brief", _sql(f"SELECT {_BRIEF_COLS} FROM briefs"))
def agg_brief(spark, sf):
    """One brief per eligible project: head score/impact/effort, count, sorted kinds, top kind."""
    return _brief_out(ranked(spark, sf)["briefs"])


@register("sort_briefs", _sql(f"SELECT {_BRIEF_COLS} FROM briefs ORDER BY score DESC, f_src, f_k1, f_k2, f_k3, f_k4"))
def sort_briefs(spark, sf):
    return _brief_out(P.sort_briefs(ranked(spark, sf)["briefs"]))


@register("top_axis_quota", _sql(f"SELECT {_BRIEF_COLS}, CAST(cls AS BIGINT) AS cls FROM selected"))
def top_axis_quota(spark, sf):
    """Top 20 briefs, at least 20 div 3 replacement-led; unused vulnerability slots spill over."""
    s = P.top_axis_quota(ranked(spark, sf)["briefs"], TOP_N)
    return _brief_out(s).join(s.select("project_purl", F.col("cls").cast("bigint").alias("cls")), "project_purl")


@register("set_union_quota", _sql("SELECT CAST(cls AS BIGINT) AS cls, CAST(count(*) AS BIGINT) AS n FROM selected GROUP BY cls"))
def set_union_quota(spark, sf):
    """Vulnerability slice + replacement slice of the selection (sizes per slice)."""
    s = P.top_axis_quota(ranked(spark, sf)["briefs"], TOP_N)
    return s.groupBy(F.col("cls").cast("bigint").alias("cls")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register(
    "agg_selected_summary",
    _sql("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM briefs) AS total, CAST(count(*) AS BIGINT) AS top,
       CAST(count(*) FILTER (WHERE top_kind = 'vulnerability-fix') AS BIGINT) AS vuln,
       CAST(count(*) FILTER (WHERE top_kind <> 'vulnerability-fix') AS BIGINT) AS replacement
FROM selected"""),
)
def agg_selected_summary(spark, sf):
    b = ranked(spark, sf)["briefs"]
    return P.agg_selected_summary(b, P.top_axis_quota(b, TOP_N))


@register("pipe_briefs", _sql(f"SELECT {_BRIEF_COLS} FROM selected"))
def pipe_briefs(spark, sf):
    """End-to-end: advisories + fan-outs -> scored, capped, quota-balanced top-20 briefs."""
    return _brief_out(P.top_axis_quota(ranked(spark, sf)["briefs"], TOP_N))
