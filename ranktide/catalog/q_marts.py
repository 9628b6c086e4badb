"""Phase 0/1 queries: scoring functions, latest-row windows, the two marts, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ranktide.catalog import sqlfn as Q
from ranktide.catalog.bridge_sql import AS_OF_SQL, with_views
from ranktide.catalog.registry import register
from ranktide.functions import scoring as S
from ranktide.functions.util import r6, ts_ntz
from ranktide.operators import windows as W
from ranktide.plans import marts as M
from ranktide.session import DEFAULT_AS_OF, checkpoint_dir, cut_lineage
from ranktide.sources import bridge as B

NOW = AS_OF_SQL


def _opps(spark, sf):
    return M.mart_opportunities(B.advisories(spark, sf), B.projects(spark, sf), DEFAULT_AS_OF)


def _flat_mart(df):
    return df.select(
        "id", "kind", "dedupe_key", "project_purl", "ecosystem", "project_name", "advisory_severity",
        r6("advisory_cvss").alias("advisory_cvss"), "advisory_summary",
        F.array_join("advisory_fixed_versions", ",").alias("advisory_fixed_versions"),
        "project_stars", "project_downloads_weekly", "project_dependents",
        r6("score").alias("score"), "computed_at",
    )


MART_SQL_CORE = f"""
newest_advisory AS (
  SELECT DISTINCT ON (id) * FROM advisories ORDER BY id, ingest_date DESC, project_purl
),
newest_project AS (
  SELECT DISTINCT ON (purl) * FROM projects ORDER BY purl, ingest_date DESC
),
live AS (
  SELECT a.*, p.ecosystem, p.name, p.stars, p.downloads_weekly, p.dependents, p.last_pr_merged_at
  FROM newest_advisory a LEFT JOIN newest_project p ON a.project_purl = p.purl
  WHERE NOT EXISTS (SELECT 1 FROM newest_project x WHERE x.purl = a.project_purl AND x.archived)
),
mart AS (
  SELECT id, 'vulnerability-fix' AS kind, concat_ws('|', project_purl, id) AS dedupe_key, project_purl, ecosystem,
         name AS project_name, severity AS advisory_severity, cvss AS advisory_cvss, summary AS advisory_summary,
         fixed_versions AS advisory_fixed_versions, stars AS project_stars,
         downloads_weekly AS project_downloads_weekly, dependents AS project_dependents,
         {Q.score_macro('cvss', 'downloads_weekly', 'stars', 'fixed_versions', 'summary', 'last_pr_merged_at')} AS score,
         {NOW} AS computed_at
  FROM live
)"""

MART_FLAT_SELECT = """
SELECT id, kind, dedupe_key, project_purl, ecosystem, project_name, advisory_severity,
       round(advisory_cvss, 6) AS advisory_cvss, advisory_summary,
       array_to_string(advisory_fixed_versions, ',') AS advisory_fixed_versions,
       project_stars, project_downloads_weekly, project_dependents, round(score, 6) AS score, computed_at
FROM mart"""


@register("mart_opportunities", with_views(["advisories", "projects"], MART_FLAT_SELECT, [MART_SQL_CORE]))
def mart_opportunities(spark, sf):
    """Flagship mart: latest advisories LEFT JOIN latest projects, archived dropped, scored."""
    return _flat_mart(_opps(spark, sf))


SEEN_CTE = """
seen AS (
  SELECT project_purl, id, dates[1] AS first_seen, dates[-1] AS last_seen, len(dates) AS partition_count
  FROM (SELECT project_purl, id, list_sort(list(DISTINCT ingest_date)) AS dates FROM advisories GROUP BY ALL)
)"""

NEWEST_MOVE_CTE = """
newest_move AS (
  SELECT DISTINCT ON (dedupe_key) dedupe_key, to_state, transitioned_at, actor, reason
  FROM transitions ORDER BY dedupe_key, transitioned_at DESC, ingest_date DESC, reason DESC
)"""

CURRENT_CTE = """
current AS (
  SELECT dedupe_key, kind, project_purl,
         first_seen::TIMESTAMP AS first_seen_at, last_seen::TIMESTAMP AS last_seen_at, partition_count::BIGINT AS partition_count,
         CASE WHEN to_state IS NULL THEN 'new' ELSE to_state END AS state, transitioned_at AS state_transitioned_at,
         actor AS state_actor, reason AS state_reason, TIMESTAMP '2001-11-10 00:00:00' AS computed_at
  FROM mart LEFT JOIN seen USING (project_purl, id) LEFT JOIN newest_move USING (dedupe_key)
)"""

STATE_SQL_CORE = ",\n".join([SEEN_CTE.strip(), NEWEST_MOVE_CTE.strip(), CURRENT_CTE.strip()])


def _state(spark, sf):
    return M.mart_opportunity_state(_opps(spark, sf), B.advisories(spark, sf), B.transitions(spark, sf), DEFAULT_AS_OF)


@register(
    "mart_opportunity_state",
    with_views(["advisories", "projects", "transitions"], "SELECT * FROM current", [MART_SQL_CORE, STATE_SQL_CORE]),
)
def mart_opportunity_state(spark, sf):
    """Lifecycle + newest transition state per dedupe key."""
    return _state(spark, sf)


@register(
    "mart_state_incremental",
    with_views(["advisories", "projects", "transitions"], "SELECT * FROM current", [MART_SQL_CORE, STATE_SQL_CORE]),
)
def mart_state_incremental(spark, sf):
    """The lifecycle mart over a kept state: built year by year, one year landed short at first and then again in whole."""
    adv = cut_lineage(B.advisories(spark, sf))
    table = M.lifecycle_table(spark, f"{checkpoint_dir(spark).rstrip('/')}/lifecycle-{uuid.uuid4().hex}")
    dates = sorted(r["ingest_date"] for r in adv.select("ingest_date").distinct().collect())  # one row a calendar day
    years = sorted({d.year for d in dates})
    short = adv.where((F.year("ingest_date") != years[0]) | (F.crc32(F.col("id").cast("binary")) % 2 == 0)) if years else adv
    for y in years:
        M.update_lifecycle(table, short, [d for d in dates if d.year == y])
    M.update_lifecycle(table, adv, [d for d in dates if d.year == years[0]] if years else [])
    opps = M.mart_opportunities(adv, B.projects(spark, sf), DEFAULT_AS_OF)
    return M.mart_opportunity_state(opps, None, B.transitions(spark, sf), DEFAULT_AS_OF, M.read_lifecycle(table))


# ---- scalar scoring functions over the whole projects / advisories views -----------------

@register(
    "fn_popularity",
    with_views(["projects"], f"SELECT purl, ingest_date, round({Q.popularity('downloads_weekly', 'stars')}, 6) AS popularity FROM projects"),
)
def fn_popularity(spark, sf):
    p = B.projects(spark, sf)
    return p.select("purl", "ingest_date", r6(S.popularity("downloads_weekly", "stars")).alias("popularity"))


@register(
    "fn_severity",
    with_views(["advisories"], f"SELECT id, ingest_date, round({Q.severity('cvss')}, 6) AS severity_score FROM advisories"),
)
def fn_severity(spark, sf):
    a = B.advisories(spark, sf)
    return a.select("id", "ingest_date", r6(S.severity("cvss")).alias("severity_score"))


@register(
    "fn_effort",
    with_views(["advisories"], f"SELECT id, ingest_date, {Q.effort('fixed_versions', 'summary')} AS effort_score FROM advisories"),
)
def fn_effort(spark, sf):
    a = B.advisories(spark, sf)
    return a.select("id", "ingest_date", S.effort("fixed_versions", "summary").alias("effort_score"))


@register(
    "fn_confidence",
    with_views(["projects"], f"SELECT purl, ingest_date, round({Q.confidence('last_pr_merged_at')}, 6) AS confidence FROM projects"),
)
def fn_confidence(spark, sf):
    p = B.projects(spark, sf)
    return p.select("purl", "ingest_date", r6(S.confidence("last_pr_merged_at", ts_ntz(DEFAULT_AS_OF))).alias("confidence"))


_JOINED_SQL = """
SELECT a.id, a.ingest_date AS a_date, p.ingest_date AS p_date, a.cvss, a.fixed_versions, a.summary,
       p.downloads_weekly, p.stars, p.last_pr_merged_at
FROM advisories a JOIN projects p ON p.purl = a.project_purl AND year(p.ingest_date) = year(a.ingest_date)"""


def _joined(spark, sf):
    a = B.advisories(spark, sf)
    p = B.projects(spark, sf)
    j = a.join(p, (p.purl == a.project_purl) & (F.year(p.ingest_date) == F.year(a.ingest_date)))
    return j.select(
        a["id"], a["ingest_date"].alias("a_date"), p["ingest_date"].alias("p_date"), a["cvss"], a["fixed_versions"],
        a["summary"], p["downloads_weekly"], p["stars"], p["last_pr_merged_at"],
    )


@register(
    "fn_impact",
    with_views(["advisories", "projects"], f"""
SELECT id, a_date, round({Q.impact(Q.popularity('downloads_weekly', 'stars'), Q.severity('cvss'))}, 6) AS impact
FROM ({_JOINED_SQL}) j"""),
)
def fn_impact(spark, sf):
    """Impact = popularity/100 * severity for each advisory against its same-year project snapshot."""
    j = _joined(spark, sf)
    return j.select("id", "a_date", r6(S.impact(S.popularity("downloads_weekly", "stars"), S.severity("cvss"))).alias("impact"))


@register(
    "fn_final_score",
    with_views(["advisories", "projects"], f"""
SELECT id, a_date,
       round({Q.final(Q.impact(Q.popularity('downloads_weekly', 'stars'), Q.severity('cvss')), Q.effort('fixed_versions', 'summary'), Q.confidence('last_pr_merged_at'))}, 6) AS final_score
FROM ({_JOINED_SQL}) j"""),
)
def fn_final_score(spark, sf):
    j = _joined(spark, sf)
    imp = S.impact(S.popularity("downloads_weekly", "stars"), S.severity("cvss"))
    conf = S.confidence("last_pr_merged_at", ts_ntz(DEFAULT_AS_OF))
    return j.select("id", "a_date", r6(S.final_score(imp, S.effort("fixed_versions", "summary"), conf)).alias("final_score"))


@register(
    "fn_score_macro",
    with_views(["advisories", "projects"], f"""
SELECT id, a_date,
       round({Q.score_macro('cvss', 'downloads_weekly', 'stars', 'fixed_versions', 'summary', 'last_pr_merged_at')}, 6) AS score
FROM ({_JOINED_SQL}) j"""),
)
def fn_score_macro(spark, sf):
    j = _joined(spark, sf)
    return j.select(
        "id", "a_date",
        r6(S.score_macro("cvss", "downloads_weekly", "stars", "fixed_versions", "summary", "last_pr_merged_at", ts_ntz(DEFAULT_AS_OF))).alias("score"),
    )


@register("fn_dedupe_key", with_views(["advisories"], "SELECT DISTINCT project_purl || '|' || id AS dedupe_key FROM advisories"))
def fn_dedupe_key(spark, sf):
    return B.advisories(spark, sf).select(M.dedupe_key("project_purl", "id").alias("dedupe_key")).distinct()


# ---- windows / joins / filters that make up the marts ----------------------------------------

@register(
    "win_latest_advisory",
    with_views(["advisories"], """
SELECT id, min(project_purl) AS project_purl, ingest_date FROM advisories
WHERE (id, ingest_date) IN (SELECT id, max(ingest_date) FROM advisories GROUP BY id) GROUP BY id, ingest_date"""),
)
def win_latest_advisory(spark, sf):
    return W.win_latest_advisory(B.advisories(spark, sf)).select("id", "project_purl", "ingest_date")


@register(
    "win_latest_project",
    with_views(["projects"], """
SELECT p.purl, p.ingest_date, p.archived, p.downloads_weekly FROM projects p
WHERE NOT EXISTS (SELECT 1 FROM projects x WHERE x.purl = p.purl AND x.ingest_date > p.ingest_date)"""),
)
def win_latest_project(spark, sf):
    return W.win_latest_project(B.projects(spark, sf)).select("purl", "ingest_date", "archived", "downloads_weekly")


@register(
    "win_latest_transition",
    with_views(["transitions"], """
SELECT DISTINCT ON (dedupe_key) dedupe_key, to_state, transitioned_at, actor, reason
FROM transitions ORDER BY dedupe_key, transitioned_at DESC, ingest_date DESC, reason DESC"""),
)
def win_latest_transition(spark, sf):
    return W.win_latest_transition(B.transitions(spark, sf)).select("dedupe_key", "to_state", "transitioned_at", "actor", "reason")


@register(
    "join_left_latest_project",
    with_views(["advisories", "projects"], "SELECT a.id, a.project_purl, p.ecosystem, p.archived FROM newest_advisory a LEFT JOIN newest_project p ON p.purl = a.project_purl", [MART_SQL_CORE]),
)
def join_left_latest_project(spark, sf):
    a = W.win_latest_advisory(B.advisories(spark, sf))
    p = W.win_latest_project(B.projects(spark, sf))
    return M.join_left_latest_project(a, p).select("id", "project_purl", "ecosystem", "archived")


@register(
    "flt_archived_mart",
    with_views(["projects"], """
SELECT purl, max(ingest_date) AS ingest_date FROM projects GROUP BY purl
HAVING arg_max(coalesce(archived, FALSE), ingest_date) = FALSE"""),
)
def flt_archived_mart(spark, sf):
    return M.flt_archived_mart(W.win_latest_project(B.projects(spark, sf))).select("purl", "ingest_date")


@register(
    "agg_lifecycle",
    with_views(["advisories"], """
SELECT project_purl, id, first_seen, last_seen, partition_count::BIGINT AS partition_count FROM seen""", [SEEN_CTE]),
)
def agg_lifecycle(spark, sf):
    return M.agg_lifecycle(B.advisories(spark, sf)).withColumn("partition_count", F.col("partition_count").cast("bigint"))


@register(
    "join_lifecycle",
    with_views(["advisories", "projects"], """
SELECT dedupe_key, first_seen, last_seen, partition_count::BIGINT AS partition_count
FROM mart LEFT JOIN seen USING (project_purl, id)""", [MART_SQL_CORE, SEEN_CTE]),
)
def join_lifecycle(spark, sf):
    o = _opps(spark, sf).select("id", "dedupe_key", "project_purl")
    lc = M.agg_lifecycle(B.advisories(spark, sf))
    return M.join_lifecycle(o, lc).select("dedupe_key", "first_seen", "last_seen", F.col("partition_count").cast("bigint").alias("partition_count"))


@register(
    "join_latest_transition",
    with_views(["advisories", "projects", "transitions"], "SELECT dedupe_key, state, state_transitioned_at, state_actor FROM current", [MART_SQL_CORE, STATE_SQL_CORE]),
)
def join_latest_transition(spark, sf):
    return _state(spark, sf).select("dedupe_key", "state", "state_transitioned_at", "state_actor")


@register(
    "flt_date_range",
    with_views(["advisories"], "SELECT id, ingest_date FROM advisories WHERE ingest_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'"),
)
def flt_date_range(spark, sf):
    """Inclusive BETWEEN on ingest date."""
    a = B.advisories(spark, sf)
    return a.where(F.col("ingest_date").between(F.lit("1998-01-01").cast("date"), F.lit("1999-06-30").cast("date"))).select("id", "ingest_date")
