"""Phase 5 brief rendering and triage listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.catalog import sqlfn as Q
from ranktide.catalog.q_pipeline import _CTES, _TITLE_SQL, _VIEWS, ranked
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.registry import register
from ranktide.functions.dates import activity_label
from ranktide.functions.rounding import round_one_place
from ranktide.functions.util import ts_ntz
from ranktide.plans import briefs as BR
from ranktide.plans import publish as PB
from ranktide.plans import triage as TR
from ranktide.session import DEFAULT_AS_OF
from ranktide.sources import bridge as B
from ranktide.sources import landing as LD

_BRIEFX = f"""
briefx AS (
  SELECT b.project_purl, b.name, b.slug, b.score, b.impact, b.effort, b.top_kind, b.opp_count, b.kinds,
         'npm' AS ecosystem, e.repo_url, e.archived, e.has_benchmarks, e.last_pr_merged_at,
         {Q.confidence('e.last_pr_merged_at')} AS conf,
         list_sort(list_distinct(list_filter([
            'npm',
            CASE WHEN contains(b.kinds, 'vulnerability-fix') THEN 'vuln' END,
            CASE WHEN contains(b.kinds, 'perf-replacement') THEN 'perf' END,
            CASE WHEN contains(b.kinds, 'dep-replacement') THEN 'bloat' END,
            CASE WHEN coalesce(e.has_benchmarks, FALSE) THEN 'bench' END,
            CASE WHEN u.unpatched THEN 'unpatched' END,
            CASE WHEN coalesce(e.archived, FALSE) THEN 'archived' END], lambda x: x IS NOT NULL))) AS tags
  FROM briefs b JOIN elig e ON e.purl = b.project_purl
  LEFT JOIN (SELECT project_purl, bool_or(kind = 'vulnerability-fix' AND len(fixed_versions) = 0) AS unpatched
             FROM topo GROUP BY project_purl) u ON u.project_purl = b.project_purl
)"""


def _sql(body: str) -> str:
    return with_views(_VIEWS, body, _CTES + [_BRIEFX])


def _briefs(spark, sf):
    return ranked(spark, sf)["briefs"]


@register("agg_tags", _sql("SELECT project_purl, array_to_string(tags, ',') AS tags FROM briefx"))
def agg_tags(spark, sf):
    """Sorted tag set per brief: ecosystem, vuln/perf/bloat by kind, bench, unpatched, archived."""
    b = _briefs(spark, sf)
    return b.select("project_purl", F.array_join(BR.agg_tags(b), ",").alias("tags"))


_CIT_SQL = """
SELECT project_purl, string_agg(ctype || '|' || cid, ';' ORDER BY pos) AS citations FROM (
  SELECT project_purl, ctype, cid, min(pos) AS pos FROM (
    SELECT project_purl, opp_rank * 100 + 0 AS pos,
           CASE WHEN kind = 'vulnerability-fix' THEN 'advisory' ELSE 'e18e-replacement' END AS ctype,
           CASE WHEN kind = 'vulnerability-fix' THEN adv_id
                ELSE m.manifest || '#' || CASE WHEN starts_with(from_purl, 'pkg:npm/') THEN substr(from_purl, 9) ELSE from_purl END END AS cid
    FROM topo LEFT JOIN (SELECT DISTINCT id AS rid, manifest FROM replacements) m ON m.rid = topo.finding_id
    UNION ALL
    SELECT t.project_purl, t.opp_rank * 100 + l.ord AS pos, 'dependency-location' AS ctype, l.loc AS cid
    FROM topo t
    JOIN (SELECT dep_purl, from_purl, unnest(string_split(locations, ';')) AS loc,
                 generate_subscripts(string_split(locations, ';'), 1) AS ord FROM floc) l
      ON l.dep_purl = t.project_purl AND l.from_purl = t.from_purl
    WHERE t.kind <> 'vulnerability-fix')
  GROUP BY project_purl, ctype, cid)
GROUP BY project_purl"""


@register("agg_citations", _sql(_CIT_SQL))
def agg_citations(spark, sf):
    """Ordered first-wins citation list per brief, rendered as ``type|id`` joined by ``;``."""
    b = _briefs(spark, sf)
    c = BR.agg_citations()
    return b.select("project_purl", F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("|"), x["id"])), ";").alias("citations"))


@register(
    "fn_activity_label",
    with_views(["projects"], f"""
SELECT purl, ingest_date, CASE WHEN last_pr_merged_at IS NULL THEN 'unknown'
       ELSE 'last PR merged ' || CAST(trunc({Q.age_days('last_pr_merged_at')}) AS BIGINT) || 'd ago' END AS label
FROM projects"""),
)
def fn_activity_label(spark, sf):
    p = B.projects(spark, sf)
    return p.select("purl", "ingest_date", activity_label("last_pr_merged_at", ts_ntz(DEFAULT_AS_OF)).alias("label"))


@register(
    "fn_round_frontmatter",
    _sql(f"SELECT project_purl, {Q.round_one_place('score')} AS total, {Q.round_one_place('impact')} AS impact, {Q.round_one_place('effort')} AS effort, "
         "CAST(round_even(conf, 0) AS INTEGER) AS confidence FROM briefx"),
)
def fn_round_frontmatter(spark, sf):
    """Frontmatter numbers: totals to one place, confidence to an integer, half-to-even."""
    b = _briefs(spark, sf)
    from ranktide.functions import scoring as S

    conf = S.confidence("last_pr_merged_at", ts_ntz(DEFAULT_AS_OF))
    return b.select(
        "project_purl", round_one_place("score").alias("total"), round_one_place("impact").alias("impact"),
        round_one_place("effort").alias("effort"), F.bround(conf, 0).cast("int").alias("confidence"),
    )


_OPPX = f"""
fan_best AS (
  SELECT * FROM fanx QUALIFY row_number() OVER (
    PARTITION BY dep_purl, from_purl ORDER BY effort_score DESC, -coalesce(downloads_weekly, 0), first_seq, dep_rank) = 1
),
adv_best AS (
  SELECT * FROM adv_ok QUALIFY row_number() OVER (PARTITION BY project_purl, id ORDER BY sev_rank, page_pos, id, vuln_pos) = 1
),
oppx AS (
  SELECT t.project_purl, t.opp_rank, t.kind, t.impact, t.effort, a.id AS adv_id, a.severity, a.cvss, a.summary,
         a.affected_versions, a.fixed_versions, a.repo_url AS adv_repo, r.from_purl, r.to_purls, r.axis, r.effort AS band,
         r.manifest, r.manifest_line, ti.pr_title,
         CASE WHEN coalesce(e.repo_url, '') <> '' THEN string_split(l.locations, ';') END AS places,
         rtrim(e.repo_url, '/') || '/blob/' || coalesce(nullif(e.head_sha, ''), 'HEAD') || '/' AS blob
  FROM topo t JOIN elig e ON e.purl = t.project_purl
  LEFT JOIN adv_best a ON t.kind = 'vulnerability-fix' AND a.project_purl = t.project_purl AND a.id = t.finding_id
  LEFT JOIN fan_best r ON t.kind <> 'vulnerability-fix' AND r.dep_purl = t.project_purl AND r.from_purl = t.from_purl
  LEFT JOIN (SELECT DISTINCT * FROM floc) l ON l.dep_purl = r.dep_purl AND l.from_purl = r.from_purl
  LEFT JOIN (SELECT DISTINCT * FROM ({_TITLE_SQL})) ti ON ti.dedupe_key = t.dedupe_key
),
cited AS (
  SELECT project_purl, ctype, cid, min(pos) AS pos, arg_min(url, pos) AS url FROM (
    SELECT project_purl, opp_rank * 1000 AS pos, 'advisory' AS ctype, adv_id AS cid, 'https://github.com/advisories/' || adv_id AS url
    FROM oppx WHERE adv_id IS NOT NULL
    UNION ALL
    SELECT project_purl, opp_rank * 1000, 'e18e-replacement', manifest || '#' || regexp_replace(from_purl, '^pkg:npm/', ''),
           'https://github.com/e18e/module-replacements/blob/main/manifests/' || manifest || coalesce('#L' || manifest_line, '')
    FROM oppx WHERE manifest IS NOT NULL
    UNION ALL
    SELECT project_purl, opp_rank * 1000 + ord, 'dependency-location', place, blob || place
    FROM (SELECT project_purl, opp_rank, blob, unnest(places) AS place, generate_subscripts(places, 1) AS ord
          FROM oppx WHERE manifest IS NOT NULL))
  GROUP BY ALL
),
cites AS (SELECT project_purl, list({{'type': ctype, 'id': cid, 'url': url}} ORDER BY pos) AS citations FROM cited GROUP BY 1)"""

_FRONT_HEAD = """'schema': 'ranktide-brief/1', 'title': b.name, 'slug': b.slug, 'date': '2001-11-10', 'run_at': '2001-11-10T00:00:00+00:00',
  'project': {'purl': b.project_purl, 'name': b.name, 'ecosystem': 'npm', 'repo_url': e.repo_url,
              'downloads_weekly': e.downloads_weekly, 'archived': coalesce(e.archived, FALSE)},
  'score': {'total': TOTAL, 'impact': IMPACT, 'effort': EFFORT,
            'confidence': round_even(b.conf, 0)::INTEGER},
  'maintainer_activity': {'label': CASE WHEN e.last_pr_merged_at IS NULL THEN 'unknown'
      ELSE 'last PR merged ' || trunc(AGE)::BIGINT || 'd ago' END,
    'last_pr_merged_at': strftime(e.last_pr_merged_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'}"""
_FRONT_TAIL = """'opportunities': {'count': b.opp_count, 'kinds': string_split(b.kinds, ','), 'top_kind': b.top_kind},
  'tags': b.tags, 'citations': coalesce(c.citations, [])"""
_FRONT_SQL = f"""
SELECT b.slug, CASE WHEN e.has_benchmarks IS NULL THEN to_json({{{_FRONT_HEAD}, {_FRONT_TAIL}}})
  ELSE to_json({{{_FRONT_HEAD}, 'benchmarks': {{'has': e.has_benchmarks, 'signal': e.bench_signal}}, {_FRONT_TAIL}}}) END::VARCHAR AS frontmatter
FROM briefx b JOIN elig e ON e.purl = b.project_purl LEFT JOIN cites c ON c.project_purl = b.project_purl
""".replace("AGE", Q.age_days("e.last_pr_merged_at")).replace("TOTAL", Q.round_one_place("b.score")).replace(
    "IMPACT", Q.round_one_place("b.impact")).replace("EFFORT", Q.round_one_place("b.effort"))

_BODY_SQL = r"""
SELECT b.slug, '# ' || b.name || E' — 2001-11-10 Improvement Brief\n\n'
  || CASE WHEN coalesce(b.repo_url, '') <> '' THEN '**Repo**: [' || regexp_replace(b.repo_url, '^https?://', '') || '](' || b.repo_url || E')\n\n' ELSE '' END
  || E'## Top opportunities\n\n' || o.body AS body
FROM briefx b JOIN (
  SELECT project_purl, string_agg(
    '### ' || opp_rank || '. [' || kind || '] '
    || CASE WHEN adv_id IS NOT NULL THEN adv_id
       ELSE split_part(from_purl, '/', -1) || ' → ' || replace(array_to_string(to_purls, ', '), 'pkg:npm/', '') END || E'\n\n'
    || CASE WHEN adv_id IS NOT NULL THEN
         '- **Severity**: ' || coalesce(nullif(severity, ''), 'unknown') || CASE WHEN coalesce(cvss, 0) <> 0 THEN ' · CVSS ' || cvss ELSE '' END
         || E'\n- **Summary**: ' || coalesce(summary, '') || E'\n- **Affected**: `' || coalesce(nullif(affected_versions, ''), 'see advisory')
         || E'`\n- **Fix**: ' || CASE WHEN len(fixed_versions) > 0 THEN 'bump to `' || fixed_versions[1] || '`'
              ELSE '_no upstream patch — contribute one_' || CASE WHEN coalesce(adv_repo, '') <> '' THEN ' at [' || adv_repo || '](' || adv_repo || ')' ELSE '' END END
         || E'\n- **Evidence**: [' || adv_id || '](https://github.com/advisories/' || adv_id || E')\n' ELSE '' END
    || CASE WHEN from_purl IS NOT NULL THEN
         '- **Axis**: ' || axis || E'\n- **Replace**: `' || replace(from_purl, 'pkg:npm/', '') || '` → '
         || array_to_string(list_transform(to_purls, lambda x: '`' || replace(x, 'pkg:npm/', '') || '`'), ', ')
         || E'\n- **Effort band**: ' || band
         || E'\n- **Evidence**: e18e [module-replacements](https://github.com/e18e/module-replacements) · manifest ['
         || coalesce(manifest, '') || coalesce('#L' || manifest_line, '') || '](https://github.com/e18e/module-replacements/blob/main/manifests/'
         || coalesce(manifest || coalesce('#L' || manifest_line, ''), '') || E')\n'
         || CASE WHEN len(places) > 0 THEN '- **Found in**: '
              || array_to_string(list_transform(places, lambda x: '[' || x || '](' || blob || x || ')'), ', ') || E'\n' ELSE '' END ELSE '' END
    || '- **Effort score**: ' || printf('%.0f', effort) || E' / 100 (high = easy)\n- **Impact score**: ' || printf('%.0f', impact)
    || E' / 100\n- **Suggested PR**: `' || pr_title || E'`\n\n', '' ORDER BY opp_rank) AS body
  FROM oppx GROUP BY project_purl) o ON o.project_purl = b.project_purl"""


@register("brief_frontmatter", with_views(_VIEWS, _FRONT_SQL, _CTES + [_BRIEFX, _OPPX]))
def brief_frontmatter(spark, sf):
    """Frontmatter JSON document per brief (benchmarks block only when known)."""
    b = _briefs(spark, sf)
    return b.select("slug", BR.brief_frontmatter(b).alias("frontmatter"))


@register("brief_body", with_views(_VIEWS, _BODY_SQL, _CTES + [_BRIEFX, _OPPX]))
def brief_body(spark, sf):
    """Markdown body per brief, assembled from its ordered opportunities."""
    b = _briefs(spark, sf)
    return b.select("slug", BR.brief_body().alias("body"))


# ---- triage -------------------------------------------------------------------------------------

_ROW_SQL = """
trows AS (
  SELECT slug, ecosystem, floor(TOTAL * 10.0 + 0.5) / 10.0 AS score, floor(IMPACT * 10.0 + 0.5) / 10.0 AS impact,
         floor(EFFORT * 10.0 + 0.5) / 10.0 AS effort, CAST(floor(round_even(conf, 0) + 0.5) AS BIGINT) AS confidence,
         CAST(opp_count AS BIGINT) AS opps, coalesce(top_kind, '') AS top_kind,
         coalesce(strftime(last_pr_merged_at, '%Y-%m-%d'), '') AS last_pr_merged,
         CASE WHEN has_benchmarks = TRUE THEN 'yes' WHEN has_benchmarks = FALSE THEN 'no' ELSE '?' END AS bench,
         CASE WHEN coalesce(archived, FALSE) THEN 'yes' ELSE 'no' END AS archived,
         tags, '2001-11-10' AS date, coalesce(repo_url, '') AS repo_url
  FROM briefx
)""".replace("TOTAL", Q.round_one_place("score")).replace("IMPACT", Q.round_one_place("impact")).replace("EFFORT", Q.round_one_place("effort"))

_ROW_OUT = "slug, ecosystem, score, impact, effort, confidence, opps, top_kind, last_pr_merged, bench, archived, array_to_string(tags, ',') AS tags, date, repo_url"


def _rows(spark, sf):
    """All ranked briefs, published and read back: the listing knows nothing else of them."""
    path = f"{LD.scratch_root(spark, 'listing')}/briefs"
    PB.snk_briefs(BR.render(_briefs(spark, sf)), path)
    return TR.published_rows(PB.src_briefs_read(spark, path))


def _row_out(df):
    return df.select(*[c if c != "tags" else F.array_join("tags", ",").alias("tags") for c in df.columns])


def _tsql(body: str) -> str:
    return with_views(_VIEWS, body, _CTES + [_BRIEFX, _ROW_SQL])


@register("prj_triage_row", _tsql(f"SELECT {_ROW_OUT} FROM trows"))
def prj_triage_row(spark, sf):
    """Slim listing row per brief (display rounding, date part, bench yes/no/?, archived yes/no)."""
    return _row_out(_rows(spark, sf))


@register("prj_score_band", _tsql("SELECT slug, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'mid' ELSE 'low' END AS band FROM trows"))
def prj_score_band(spark, sf):
    return _rows(spark, sf).select("slug", "score", TR.prj_score_band("score").alias("band"))


TRIAGE_FILTER = TR.TriageFilter(ecosystem="npm", kind="vulnerability-fix", tag="unpatched", hide_archived=True, min_score=20.0, search="part-1")


@register(
    "flt_triage",
    _tsql(f"""SELECT {_ROW_OUT} FROM trows
WHERE ecosystem = 'npm' AND top_kind = 'vulnerability-fix' AND list_contains(tags, 'unpatched') AND archived <> 'yes'
  AND score >= 20.0 AND contains(lower(slug), 'part-1')"""),
)
def flt_triage(spark, sf):
    """Conjunctive listing filters: ecosystem, top kind, tag, archived hidden, min score, slug search."""
    return _row_out(TR.flt_triage(_rows(spark, sf), TRIAGE_FILTER))


@register("sort_multi_key", _tsql(f"SELECT {_ROW_OUT} FROM trows ORDER BY top_kind ASC, effort DESC, score DESC, slug ASC"))
def sort_multi_key(spark, sf):
    """Multi-key sort (top kind asc, effort desc), then score and slug for a unique order."""
    return _row_out(TR.sort_multi_key(_rows(spark, sf), [("top_kind", False), ("effort", True)]))


@register(
    "agg_triage_facets",
    _tsql("""
SELECT array_to_string(list_sort(list_distinct(list(ecosystem) FILTER (WHERE ecosystem <> ''))), ',') AS ecosystems,
       array_to_string(list_sort(list_distinct(list(top_kind) FILTER (WHERE top_kind <> ''))), ',') AS kinds,
       array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags
FROM trows"""),
)
def agg_triage_facets(spark, sf):
    f = TR.agg_triage_facets(_rows(spark, sf))
    return f.select(*[F.array_join(c, ",").alias(c) for c in ("ecosystems", "kinds", "tags")])


@register(
    "triage_listing",
    _tsql(f"""SELECT {_ROW_OUT}, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'mid' ELSE 'low' END AS band
FROM trows WHERE archived <> 'yes' AND score >= 0.0 ORDER BY score DESC, slug"""),
)
def triage_listing(spark, sf):
    """Default listing: archived hidden, sorted by score, with the score band."""
    return _row_out(TR.triage_listing(_rows(spark, sf)))
