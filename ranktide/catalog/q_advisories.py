"""Phase 2/3 queries: advisory flatten, semver, outdated / eligibility filters, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.catalog import sqlfn as Q
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.registry import register
from ranktide.functions import semver as V
from ranktide.functions import strings as STR
from ranktide.functions.dates import iso_week
from ranktide.functions.util import r6
from ranktide.operators import filters as FL
from ranktide.operators import windows as W
from ranktide.sources import advisories as ADV
from ranktide.sources import bridge as B
from ranktide.sources import lookups as L


def _flat_out(df):
    return df.select(
        "id", "project_purl", "severity", r6("cvss").alias("cvss"), "summary", "affected_versions",
        F.array_join("fixed_versions", ",").alias("fixed_versions"), F.array_join("refs", ",").alias("refs"),
        "published_at", "repo_url", "has_patched_sibling", F.col("vuln_pos").cast("bigint").alias("vuln_pos"),
    )


_FLAT_DOCS = """
flat_docs AS (
  SELECT *, CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 END AS sev_rank,
         (fixed IS NOT NULL AND fixed <> '') AS has_fix
  FROM nested_flat
  WHERE (withdrawn_at IS NULL OR withdrawn_at = '') AND lower(severity) IN ('critical', 'high', 'medium')
)"""


def _flat_rows_sql(patched: bool) -> str:
    fix_pred = "has_fix" if patched else "NOT has_fix"
    return f"""
SELECT id, 'pkg:' || lower(eco) || '/' || pkg_name AS project_purl, severity,
       round(coalesce(CASE WHEN v4_score <> 0 THEN v4_score END, CASE WHEN v3_score <> 0 THEN v3_score END,
                      CASE WHEN legacy_score <> 0 THEN legacy_score END), 6) AS cvss,
       coalesce(summary, '') AS summary, vrange AS affected_versions,
       CASE WHEN has_fix THEN fixed ELSE '' END AS fixed_versions, ref AS refs,
       CAST(regexp_replace(published_at, 'Z$', '') AS TIMESTAMP) AS published_at,
       CASE WHEN source_code_location <> '' THEN source_code_location END AS repo_url,
       (doc_has_fix AND NOT has_fix) AS has_patched_sibling, vuln_pos, sev_rank, page_pos
FROM flat_docs
WHERE pkg_name IS NOT NULL AND pkg_name <> '' AND lower(coalesce(eco, '')) = 'npm' AND {fix_pred}"""


_FLAT_COLS = "id, project_purl, severity, cvss, summary, affected_versions, fixed_versions, refs, published_at, repo_url, has_patched_sibling, vuln_pos"


@register("src_advisories_flatten", with_views(["nested_flat"], f"SELECT {_FLAT_COLS} FROM ({_flat_rows_sql(False)}) x", [_FLAT_DOCS]))
def src_advisories_flatten(spark, sf):
    """Nested advisory documents -> one unpatched npm advisory per affected package."""
    return _flat_out(ADV.flatten(B.nested_advisories(spark, sf), only_unpatched=True))


@register("src_advisories_flatten_patched", with_views(["nested_flat"], f"SELECT {_FLAT_COLS} FROM ({_flat_rows_sql(True)}) x", [_FLAT_DOCS]))
def src_advisories_flatten_patched(spark, sf):
    """Patched mode: keep only packages with a first patched version."""
    return _flat_out(ADV.flatten(B.nested_advisories(spark, sf), only_unpatched=False))


@register(
    "src_cvss_pick",
    with_views(["nested_flat"], """
SELECT DISTINCT id, round(coalesce(CASE WHEN v4_score <> 0 THEN v4_score END, CASE WHEN v3_score <> 0 THEN v3_score END,
                      CASE WHEN legacy_score <> 0 THEN legacy_score END), 6) AS cvss
FROM nested_flat"""),
)
def src_cvss_pick(spark, sf):
    """CVSS v4, else v3, else legacy; zero counts as missing."""
    return B.nested_advisories(spark, sf).select(F.col("ghsa_id").alias("id"), r6(ADV.cvss_pick()).alias("cvss"))


@register("src_sibling_patched", with_views(["nested_flat"], "SELECT DISTINCT id, doc_has_fix AS any_patched FROM nested_flat"))
def src_sibling_patched(spark, sf):
    """Per advisory document: does any package already have a patched version."""
    return B.nested_advisories(spark, sf).select(F.col("ghsa_id").alias("id"), ADV.sibling_patched().alias("any_patched"))


@register(
    "flt_sibling_patched",
    with_views(["nested_flat"], f"SELECT {_FLAT_COLS} FROM ({_flat_rows_sql(False)}) x WHERE NOT has_patched_sibling", [_FLAT_DOCS]),
)
def flt_sibling_patched(spark, sf):
    return _flat_out(ADV.flt_sibling_patched(ADV.flatten(B.nested_advisories(spark, sf), only_unpatched=True)))


_LIM_SQL = f"""
SELECT {_FLAT_COLS} FROM (
  SELECT x.* FROM ({_flat_rows_sql(False)}) x
  JOIN (SELECT id AS did FROM (
          SELECT id, row_number() OVER (PARTITION BY sev_rank ORDER BY page_pos, id) AS prn
          FROM (SELECT DISTINCT id, page_pos, CASE lower(severity) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS sev_rank
                FROM nested_flat WHERE lower(severity) IN ('critical', 'high', 'medium'))) WHERE prn <= 100) d ON d.did = x.id
  ORDER BY sev_rank, page_pos, id, vuln_pos LIMIT 400
)"""


@register("lim_emission", with_views(["nested_flat"], _LIM_SQL, [_FLAT_DOCS]))
def lim_emission(spark, sf):
    """First 100 documents per severity class, flattened, cut at 400 rows in emission order."""
    return _flat_out(ADV.flatten(B.nested_advisories(spark, sf), only_unpatched=True, per_page=100, limit=400))


@register("fn_parse_ts", with_views(["nested_flat"], "SELECT DISTINCT id, CAST(regexp_replace(published_at, 'Z$', '') AS TIMESTAMP) AS published_at FROM nested_flat"))
def fn_parse_ts(spark, sf):
    d = B.nested_advisories(spark, sf)
    return d.select(F.col("ghsa_id").alias("id"), STR.parse_ts("published_at").alias("published_at"))


@register(
    "fn_purl_build",
    with_views(["nested_flat"], "SELECT id, vuln_pos, 'pkg:' || lower(eco) || '/' || pkg_name AS purl FROM nested_flat"),
)
def fn_purl_build(spark, sf):
    d = B.nested_advisories(spark, sf).select("ghsa_id", F.posexplode("vulnerabilities").alias("pos", "v"))
    return d.select(
        F.col("ghsa_id").alias("id"), F.col("pos").cast("bigint").alias("vuln_pos"),
        STR.purl_build(F.col("v.package.ecosystem"), F.col("v.package.name"), lower_eco=True).alias("purl"),
    )


@register(
    "fn_purl_name",
    with_views(["sbom_edges", "projects"], """
SELECT purl, CASE WHEN starts_with(purl, 'pkg:npm/') THEN substr(purl, 9)
                  WHEN starts_with(purl, 'pkg:github/') THEN substr(purl, 12) ELSE purl END AS name
FROM (SELECT DISTINCT purl FROM projects
      UNION ALL SELECT DISTINCT 'pkg:github/' || dependent_artifact_namespace || '/' || dependent_artifact_name FROM sbom_edges)"""),
)
def fn_purl_name(spark, sf):
    p = B.projects(spark, sf).select("purl").distinct()
    g = B.sbom_edges(spark, sf).select(
        F.concat(F.lit("pkg:github/"), "dependent_artifact_namespace", F.lit("/"), "dependent_artifact_name").alias("purl")
    ).distinct()
    u = p.unionAll(g)
    return u.select("purl", STR.purl_name("purl").alias("name"))


@register(
    "fn_slug",
    with_views(["sbom_edges"], """
SELECT DISTINCT n AS name, replace(replace(n, '/', '__'), '@', '') AS slug
FROM (SELECT '@' || dependent_artifact_namespace || '/' || dependent_artifact_name AS n FROM sbom_edges)"""),
)
def fn_slug(spark, sf):
    e = B.sbom_edges(spark, sf)
    n = F.concat(F.lit("@"), "dependent_artifact_namespace", F.lit("/"), "dependent_artifact_name")
    return e.select(n.alias("name")).distinct().select("name", STR.slug("name").alias("slug"))


# ---- versions --------------------------------------------------------------------------------

_LATEST_SQL = """
latest AS (
  SELECT name, nullif(json_extract_string(doc, '$."dist-tags".latest'), '') AS latest FROM registry_docs
)"""


@register("src_latest_version", with_views(["registry_docs"], "SELECT * FROM latest", [_LATEST_SQL]))
def src_latest_version(spark, sf):
    """Registry document -> ``dist-tags.latest`` (empty -> NULL)."""
    return L.src_latest_version(B.registry_docs(spark, sf))


@register(
    "fn_parse_version",
    with_views(["registry_docs"], f"SELECT name, latest, {Q.render_version(Q.parse_version('latest'))} AS parsed FROM latest", [_LATEST_SQL]),
)
def fn_parse_version(spark, sf):
    l = L.src_latest_version(B.registry_docs(spark, sf))
    return l.select("name", "latest", V.render_version(V.parse_version("latest")).alias("parsed"))


_VR_SQL = """
vr AS (
  SELECT a.id, a.ingest_date, a.affected_versions, l.latest
  FROM advisories a LEFT JOIN latest l ON l.name = substr(a.project_purl, 9)
)"""


@register(
    "fn_version_compare",
    with_views(["registry_docs"], f"""
SELECT a.name AS a_name, a.latest AS a_latest, b.name AS b_name,
       {Q.version_cmp(Q.parse_version('a.latest'), Q.parse_version('b.latest'))} AS cmp
FROM latest a JOIN latest b ON b.name = 'part-' || (CAST(substr(a.name, 6) AS BIGINT) + 1)""", [_LATEST_SQL]),
)
def fn_version_compare(spark, sf):
    """Compare each package's latest version with the next package's (zero-padded, lexicographic)."""
    l = L.src_latest_version(B.registry_docs(spark, sf))
    a = l.select(F.col("name").alias("a_name"), F.col("latest").alias("a_latest"))
    b = l.select(F.col("name").alias("b_name"), F.col("latest").alias("b_latest"))
    nxt = F.concat(F.lit("part-"), (F.substring("a_name", 6, 64).cast("bigint") + 1).cast("string"))
    j = a.join(b, b.b_name == nxt)
    return j.select("a_name", "a_latest", "b_name", V.version_cmp(V.parse_version("a_latest"), V.parse_version("b_latest")).alias("cmp"))


def _vr(spark, sf):
    a = B.advisories(spark, sf).select("id", "ingest_date", "project_purl", "affected_versions")
    return FL.with_outdated_verdict(a, L.src_latest_version(B.registry_docs(spark, sf)))


@register(
    "fn_version_in_range",
    with_views(["advisories", "registry_docs"], f"SELECT id, ingest_date, affected_versions, latest, {Q.version_in_range('latest', 'affected_versions')} AS in_range FROM vr", [_LATEST_SQL, _VR_SQL]),
)
def fn_version_in_range(spark, sf):
    return _vr(spark, sf).select("id", "ingest_date", "affected_versions", "latest", "in_range")


_RANGE_SQL = with_views(
    ["advisories", "registry_docs"],
    f"SELECT id, ingest_date, latest, {Q.version_in_range('latest', 'affected_versions')} AS in_range FROM vr", [_LATEST_SQL, _VR_SQL],
)


@register("join_version_range_all", _RANGE_SQL)  # an earlier name of the same query
@register("join_version_range", _RANGE_SQL)
def join_version_range(spark, sf):
    """Equi-join on package name, then the range predicate; packages without a known latest version keep a null one."""
    return _vr(spark, sf).select("id", "ingest_date", "latest", "in_range")


@register(
    "flt_outdated",
    with_views(["advisories", "registry_docs"], f"""
SELECT id, ingest_date FROM vr
WHERE coalesce(affected_versions, '') = '' OR latest IS NULL
   OR coalesce({Q.version_in_range('latest', 'affected_versions')}, TRUE)""", [_LATEST_SQL, _VR_SQL]),
)
def flt_outdated(spark, sf):
    a = B.advisories(spark, sf).select("id", "ingest_date", "project_purl", "affected_versions")
    return FL.flt_outdated(a, L.src_latest_version(B.registry_docs(spark, sf))).select("id", "ingest_date")


# ---- eligibility, names, downloads, repo metadata ----------------------------------------------

@register(
    "flt_eligible",
    with_views(["projects"], """
SELECT purl, ingest_date FROM projects
WHERE NOT coalesce(archived, FALSE) AND coalesce(downloads_weekly >= 50000, TRUE)"""),
)
def flt_eligible(spark, sf):
    """Drop archived and below-floor projects; unknown downloads pass."""
    return FL.flt_eligible(B.projects(spark, sf)).select("purl", "ingest_date")


@register(
    "flt_valid_package_name",
    with_views(["registry_dependents"], """
SELECT name, coalesce(regexp_matches(name, '^(@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*$'), FALSE) AS valid
FROM (SELECT DISTINCT CASE WHEN downloads % 3 = 0 THEN upper(name) WHEN downloads % 3 = 1 THEN '@scope/' || name ELSE name END AS name
      FROM registry_dependents WHERE name IS NOT NULL)"""),
)
def flt_valid_package_name(spark, sf):
    """Registry name grammar check; rejects are quarantined (valid = false), not dropped silently."""
    d = B.registry_dependents(spark, sf).where(F.col("name").isNotNull())
    n = (
        F.when(F.col("downloads") % 3 == 0, F.upper("name"))
        .when(F.col("downloads") % 3 == 1, F.concat(F.lit("@scope/"), F.col("name")))
        .otherwise(F.col("name"))
    )
    names = d.select(n.alias("name")).distinct()
    ok, bad = FL.flt_valid_package_name(names)
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


_DL_SQL = """
downloads AS (
  SELECT substr(purl, 9) AS name, downloads_weekly FROM (
    SELECT purl, downloads_weekly, row_number() OVER (PARTITION BY purl ORDER BY ingest_date DESC) AS rn FROM projects)
  WHERE rn = 1
)"""


@register("src_weekly_downloads", with_views(["projects"], "SELECT * FROM downloads", [_DL_SQL]))
def src_weekly_downloads(spark, sf):
    return L.src_weekly_downloads(W.win_latest_project(B.projects(spark, sf)))


@register(
    "join_downloads",
    with_views(["replacements", "projects"], "SELECT r.id, d.downloads_weekly FROM replacements r LEFT JOIN downloads d ON d.name = substr(r.from_purl, 9)", [_DL_SQL]),
)
def join_downloads(spark, sf):
    """Replacement from-packages looked up by short name; a miss is NULL."""
    dl = L.src_weekly_downloads(W.win_latest_project(B.projects(spark, sf)))
    r = B.replacements(spark, sf).select("id", "from_purl")
    return L.join_downloads(r, dl, "from_purl").select("id", "downloads_weekly")


_META_SQL = r"""
meta AS (
  SELECT repo_url,
         nullif(regexp_extract(trim(repo_url), '^https?://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 1), '') AS owner,
         nullif(regexp_extract(trim(repo_url), '^https?://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 2), '') AS repo,
         CASE WHEN ok THEN coalesce(CAST(json_extract(doc, '$.data.repository.isArchived') AS BOOLEAN), FALSE) END AS is_archived,
         CASE WHEN ok THEN CAST(regexp_replace(json_extract_string(doc, '$.data.repository.pullRequests.nodes[0].mergedAt'), 'Z$', '') AS TIMESTAMP) END AS last_merged_pr_at,
         CASE WHEN ok THEN json_extract_string(doc, '$.data.repository.defaultBranchRef.target.oid') END AS head_sha,
         ok AS known
  FROM (SELECT *, (coalesce(json_array_length(json_extract(doc, '$.errors')), 0) <= 0
                   AND json_extract(doc, '$.data.repository') IS NOT NULL) AS ok FROM repo_meta_docs)
)"""


@register("src_repo_meta", with_views(["repo_meta_docs"], "SELECT * FROM meta", [_META_SQL]))
def src_repo_meta(spark, sf):
    """Archived flag, newest merge time and head SHA out of repository responses; errors -> unknown."""
    return L.src_repo_meta(B.repo_meta_docs(spark, sf))


@register(
    "join_repo_meta",
    with_views(["projects", "repo_meta_docs"], """
SELECT p.purl, p.ingest_date, coalesce(m.is_archived, FALSE) AS meta_archived, m.last_merged_pr_at AS meta_last_merged_pr_at,
       m.head_sha AS meta_head_sha
FROM projects p LEFT JOIN (SELECT * FROM meta WHERE known) m
  ON m.owner = nullif(regexp_extract(trim(p.repo_url), '^https?://github\\.com/([^/]+)/([^/?#]+?)(?:\\.git)?/?$', 1), '')
 AND m.repo = nullif(regexp_extract(trim(p.repo_url), '^https?://github\\.com/([^/]+)/([^/?#]+?)(?:\\.git)?/?$', 2), '')""", [_META_SQL]),
)
def join_repo_meta(spark, sf):
    """Project snapshots joined to repository metadata by parsed (owner, repo)."""
    p = B.projects(spark, sf).select("purl", "ingest_date", "repo_url")
    j = L.join_repo_meta(p, L.src_repo_meta(B.repo_meta_docs(spark, sf)))
    return j.select("purl", "ingest_date", "meta_archived", "meta_last_merged_pr_at", "meta_head_sha")


@register(
    "fn_repo_parse",
    r"""
SELECT page_id, u AS url,
       nullif(regexp_extract(trim(u), '^https?://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 1), '') AS owner,
       nullif(regexp_extract(trim(u), '^https?://github\.com/([^/]+)/([^/?#]+?)(?:\.git)?/?$', 2), '') AS repo
FROM (SELECT page_id, regexp_replace(url, '^(https?://)[^/]+', '\1github.com') AS u FROM pages)""",
)
def fn_repo_parse(spark, sf):
    """GitHub URL -> (owner, repo) on page URLs with the host rewritten to github.com."""
    p = B.read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^(https?://)[^/]+", "$1github.com").alias("url"))
    return p.select("page_id", "url", STR.repo_owner("url").alias("owner"), STR.repo_name("url").alias("repo"))


@register(
    "fn_iso_week",
    "SELECT event_id, CAST(yearweek_y AS VARCHAR) || '-W' || lpad(CAST(yearweek_w AS VARCHAR), 2, '0') AS iso_week FROM (SELECT event_id, isoyear(ts) AS yearweek_y, week(ts) AS yearweek_w FROM events)",
)
def fn_iso_week(spark, sf):
    """ISO year and week of each event, as ``YYYY-Www``."""
    e = B.read(spark, sf, "events")
    return e.select("event_id", iso_week("ts").alias("iso_week"))
