"""Phase 1 audits: violation rows on real and deliberately corrupted views, plus the runner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.catalog import q_fanout as QF
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.q_marts import MART_SQL_CORE, STATE_SQL_CORE, _opps, _state
from ranktide.catalog.registry import register
from ranktide.functions.util import r6
from ranktide.operators import audits as A
from ranktide.operators import windows as W
from ranktide.plans import marts as M
from ranktide.session import DEFAULT_AS_OF, cut_lineage
from ranktide.sources import bridge as B


@register(
    "aud_not_null",
    with_views(["projects"], "SELECT purl, ingest_date FROM projects WHERE downloads_weekly IS NULL OR last_pr_merged_at IS NULL"),
)
def aud_not_null(spark, sf):
    """Projects violating not-null on (downloads_weekly, last_pr_merged_at): the unknown-value rows."""
    return A.aud_not_null(B.projects(spark, sf), ["downloads_weekly", "last_pr_merged_at"]).select("purl", "ingest_date")


@register(
    "aud_unique_values",
    with_views(["advisories"], """
SELECT 'id' AS "column", CAST(id AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM advisories GROUP BY id HAVING count(*) > 1
UNION ALL
SELECT 'project_purl', project_purl, CAST(count(*) AS BIGINT) FROM advisories GROUP BY project_purl HAVING count(*) > 1"""),
)
def aud_unique_values(spark, sf):
    """Staged advisories: id and project_purl are each repeated across snapshots (violations listed)."""
    return A.aud_unique_values(B.advisories(spark, sf), ["id", "project_purl"])


@register(
    "aud_unique_combo",
    with_views(["advisories"], "SELECT project_purl, ingest_date, CAST(count(*) AS BIGINT) AS n FROM advisories GROUP BY project_purl, ingest_date HAVING count(*) > 1"),
)
def aud_unique_combo(spark, sf):
    """(project_purl, ingest_date) is not a key of the staged advisories: duplicated combinations."""
    return A.aud_unique_combo(B.advisories(spark, sf), ["project_purl", "ingest_date"]).withColumn("n", F.col("n").cast("bigint"))


@register(
    "aud_score_range",
    with_views(["advisories", "projects"], "SELECT id, round(score * 100.0, 6) AS score FROM mart WHERE score * 100.0 > 1 OR score IS NULL OR score < 0", [MART_SQL_CORE]),
)
def aud_score_range(spark, sf):
    """Score audit on a corrupted mart whose scores were left on the 0..100 scale."""
    m = _opps(spark, sf).select("id", (F.col("score") * 100.0).alias("score"))
    return A.aud_score_range(m).select("id", r6("score").alias("score"))


_UNFILTERED = """
unfiltered AS (SELECT a.id, a.project_purl FROM newest_advisory a LEFT JOIN newest_project p ON p.purl = a.project_purl)"""


def _unfiltered(spark, sf):
    a = W.win_latest_advisory(B.advisories(spark, sf))
    p = W.win_latest_project(B.projects(spark, sf))
    return M.join_left_latest_project(a, p).select("id", "project_purl")


@register(
    "join_audit_archived",
    with_views(["advisories", "projects"], """
SELECT o.id, o.project_purl FROM unfiltered o JOIN newest_project p ON p.purl = o.project_purl WHERE p.archived = TRUE""", [MART_SQL_CORE, _UNFILTERED]),
)
def join_audit_archived(spark, sf):
    """Inner join of a mart built without the archived filter to the newest archived project rows."""
    return A.join_audit_archived(_unfiltered(spark, sf), B.projects(spark, sf))


@register(
    "aud_no_archived",
    with_views(["advisories", "projects"], """
SELECT id FROM unfiltered WHERE project_purl IN (SELECT purl FROM newest_project WHERE archived)""", [MART_SQL_CORE, _UNFILTERED]),
)
def aud_no_archived(spark, sf):
    return A.aud_no_archived(_unfiltered(spark, sf), B.projects(spark, sf))


@register(
    "aud_to_state",
    """SELECT to_state FROM (SELECT CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'new' END AS to_state FROM events)
       WHERE to_state IS NULL OR to_state NOT IN ('new', 'acknowledged', 'resolved', 'rejected', 'duplicate')""",
)
def aud_to_state(spark, sf):
    """Transition audit on a log where every tenth event carries its raw event type as the state."""
    e = B.read(spark, sf, "events")
    t = e.select(F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise(F.lit("new")).alias("to_state"))
    return A.aud_to_state(t)


@register("aud_state", with_views(["advisories", "projects", "transitions"], """
SELECT state FROM (SELECT CASE WHEN partition_count % 3 = 0 THEN upper(state) WHEN partition_count % 5 <> 0 THEN state END AS state FROM current)
WHERE state IS NULL OR state NOT IN ('new', 'acknowledged', 'resolved', 'rejected', 'duplicate')""",
                                  [MART_SQL_CORE, STATE_SQL_CORE]))
def aud_state(spark, sf):
    """State vocabulary audit on a lifecycle mart some of whose states are upper-cased or missing."""
    seen = F.col("partition_count")
    wrong = F.when(seen % 3 == 0, F.upper("state")).when(seen % 5 != 0, F.col("state"))
    return A.aud_state(_state(spark, sf).select(wrong.alias("state")))


_RUNNER_SQL = """
SELECT * FROM (VALUES ('x', 'x', 0)) t(audit, model, violations) WHERE FALSE
UNION ALL SELECT 'not_null', 'staging.advisories', CAST(count(*) AS BIGINT) FROM advisories WHERE id IS NULL OR project_purl IS NULL OR ingest_date IS NULL
UNION ALL SELECT 'unique_combination_of_columns', 'staging.advisories', CAST(count(*) AS BIGINT) FROM (SELECT id, ingest_date FROM advisories GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'not_null', 'staging.projects', CAST(count(*) AS BIGINT) FROM projects WHERE purl IS NULL OR ecosystem IS NULL OR name IS NULL OR ingest_date IS NULL
UNION ALL SELECT 'valid_to_state', 'staging.opportunity_transitions', CAST(count(*) AS BIGINT) FROM transitions WHERE to_state IS NULL OR to_state NOT IN ('new', 'acknowledged', 'resolved', 'rejected', 'duplicate')
UNION ALL SELECT 'not_null', 'staging.opportunity_transitions', CAST(count(*) AS BIGINT) FROM transitions WHERE dedupe_key IS NULL OR to_state IS NULL OR transitioned_at IS NULL OR ingest_date IS NULL
UNION ALL SELECT 'not_null', 'staging.dependents', CAST(count(*) AS BIGINT) FROM tiered WHERE parent IS NULL OR purl IS NULL
UNION ALL SELECT 'unique_combination_of_columns', 'staging.dependents', CAST(count(*) AS BIGINT) FROM (SELECT parent, purl FROM tiered GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'not_null', 'staging.replacements', CAST(count(*) AS BIGINT) FROM replacements WHERE id IS NULL OR from_purl IS NULL OR axis IS NULL OR effort IS NULL
UNION ALL SELECT 'unique_combination_of_columns', 'staging.replacements', CAST(count(*) AS BIGINT) FROM (SELECT id, from_purl FROM replacements GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'not_null', 'marts.opportunities', CAST(count(*) AS BIGINT) FROM mart WHERE id IS NULL OR kind IS NULL OR project_purl IS NULL OR dedupe_key IS NULL OR score IS NULL
UNION ALL SELECT 'unique_values', 'marts.opportunities', CAST((SELECT count(*) FROM (SELECT id FROM mart GROUP BY id HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT dedupe_key FROM mart GROUP BY dedupe_key HAVING count(*) > 1)) AS BIGINT)
UNION ALL SELECT 'score_in_range', 'marts.opportunities', CAST(count(*) AS BIGINT) FROM mart WHERE score IS NULL OR score < 0 OR score > 1
UNION ALL SELECT 'no_archived_active_opps', 'marts.opportunities', CAST(count(*) AS BIGINT) FROM mart o JOIN newest_project p ON p.purl = o.project_purl WHERE p.archived = TRUE
UNION ALL SELECT 'not_null', 'marts.opportunity_state', CAST(count(*) AS BIGINT) FROM current WHERE dedupe_key IS NULL OR kind IS NULL OR project_purl IS NULL OR first_seen_at IS NULL OR last_seen_at IS NULL OR state IS NULL
UNION ALL SELECT 'unique_values', 'marts.opportunity_state', CAST(count(*) AS BIGINT) FROM (SELECT dedupe_key FROM current GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'valid_opportunity_state', 'marts.opportunity_state', CAST(count(*) AS BIGINT) FROM current WHERE state IS NULL OR state NOT IN ('new', 'acknowledged', 'resolved', 'rejected', 'duplicate')"""


_LANDED = "2026-01-01"


@register("aud_runner", with_views(["advisories", "projects", "transitions", "replacements", *QF._TIER_VIEWS[1:]], _RUNNER_SQL,
                                   [MART_SQL_CORE, STATE_SQL_CORE, QF._REG_SQL, QF._PRIM_SQL, QF._TIER_SQL]))
def aud_runner(spark, sf):
    """Every audit attached to the staging models and marts: (audit, model, violations)."""
    # Every model is written once and read once by its audits.
    adv, proj, tr = (cut_lineage(f(spark, sf)) for f in (B.advisories, B.projects, B.transitions))
    mart = cut_lineage(M.mart_opportunities(adv, proj, DEFAULT_AS_OF))
    state = cut_lineage(M.mart_opportunity_state(mart, adv, tr, DEFAULT_AS_OF))
    landed = F.lit(_LANDED).cast("date")
    tiered = QF._tiered(spark, sf).select(
        F.concat(F.lit("pkg:npm/"), F.col("parent")).alias("parent_purl"), F.col("purl").alias("dependent_purl"), landed.alias("ingest_date")
    )
    repl = B.replacements(spark, sf).select("id", "from_purl", "axis", "effort", landed.alias("ingest_date"))
    models = {
        "staging.advisories": adv, "staging.projects": proj, "staging.opportunity_transitions": tr, "staging.dependents": cut_lineage(tiered),
        "staging.replacements": cut_lineage(repl), "marts.opportunities": mart, "marts.opportunity_state": state,
    }
    return A.run_audits(A.model_audits(models), models)
