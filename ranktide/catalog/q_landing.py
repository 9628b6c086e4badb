"""Phase 6 queries: landing sinks, staging reads, interval-incremental staging, full refresh, publishing.

Each builder writes under a fresh folder below the session's checkpoint
folder (the cluster's shared ``spark.checkpoint.dir``), then returns the read
of what was written, so the check sees the stored result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.catalog import q_advisories as QA
from ranktide.catalog import q_fanout as QF
from ranktide.catalog import q_manifests as QM
from ranktide.catalog import q_pipeline as QP
from ranktide.catalog import sqlfn as Q
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.q_briefs import _BRIEFX
from ranktide.catalog.q_marts import MART_FLAT_SELECT, MART_SQL_CORE, _flat_mart
from ranktide.catalog.registry import register
from ranktide.functions.strings import json_evidence
from ranktide.functions.util import r6
from ranktide.operators import audits as A
from ranktide.operators import lines as LN
from ranktide.operators import windows as W
from ranktide.plans import briefs as BR
from ranktide.plans import marts as M
from ranktide.plans import pipeline as P
from ranktide.plans import publish as PB
from ranktide.session import DEFAULT_AS_OF, cut_lineage
from ranktide.sources import advisories as ADV
from ranktide.sources import bridge as B
from ranktide.sources import landing as LD
from ranktide.sources import versions as V
from ranktide.sources import replacements as RP
from ranktide.streaming.incremental import run_incremental

SNAPSHOT_DATE = "2026-01-01"

_ADV_FLAT_SQL = """
SELECT id, project_purl, severity, round(cvss, 6) AS cvss, summary, affected_versions,
       array_to_string(fixed_versions, ',') AS fixed_versions, array_to_string(refs, ',') AS refs,
       published_at, repo_url, ingest_date FROM advisories"""


def _adv_flat(df):
    return df.select(
        "id", "project_purl", "severity", r6("cvss").alias("cvss"), "summary", "affected_versions",
        F.array_join("fixed_versions", ",").alias("fixed_versions"), F.array_join("refs", ",").alias("refs"),
        "published_at", "repo_url", "ingest_date",
    )


def _landed(spark, sf, source, frame):
    root = LD.scratch_root(spark)
    LD.land_partitioned(frame, root, source)
    return root


@register("snk_land_advisories", with_views(["advisories"], _ADV_FLAT_SQL))
def snk_land_advisories(spark, sf):
    """Advisories landed by ingest date (one job, dynamic partition overwrite), read back."""
    root = _landed(spark, sf, "advisories", B.advisories(spark, sf))
    return _adv_flat(LD.read_landed(spark, root, "advisories").drop("dt"))


_PROJ_COLS = [c for c, _ in LD.SCHEMAS["projects"]]


@register("snk_land_projects", with_views(["projects"], f"SELECT {', '.join(_PROJ_COLS)} FROM projects"))
def snk_land_projects(spark, sf):
    """Project snapshots landed with all 15 columns (incl. bench_signal), read back."""
    root = _landed(spark, sf, "projects", B.projects(spark, sf))
    return LD.read_landed(spark, root, "projects").select(*_PROJ_COLS)


_TR_COLS = [c for c, _ in LD.SCHEMAS["opportunity_transitions"]]


@register("snk_land_transitions", with_views(["transitions"], f"SELECT {', '.join(_TR_COLS)} FROM transitions"))
def snk_land_transitions(spark, sf):
    """Append-only transition log landed by date, read back."""
    root = _landed(spark, sf, "opportunity_transitions", B.transitions(spark, sf))
    return LD.read_landed(spark, root, "opportunity_transitions").select(*_TR_COLS)


def _repl_rows(spark, sf):
    idx = LN.src_manifest_line_index(B.e18e_manifest_lines(spark, sf), ["manifest"])
    r = RP.src_replacement_manifests(B.e18e_mappings(spark, sf), B.e18e_replacements(spark, sf), idx)
    return r.withColumn("evidence_json", json_evidence("evidence"))


_EVIDENCE_SQL = """
SELECT 'e18e:' || manifest || ':' || from_name AS id, 'pkg:npm/' || from_name AS from_purl,
       CASE WHEN len(coalesce(targets, [])) > 0 THEN array_to_string(list_transform(targets, lambda t: 'pkg:npm/' || t), ',')
            ELSE 'pkg:npm/<native>' END AS to_purls,
       axis, CASE greatest(r, 2) WHEN 4 THEN 'drop-in' WHEN 3 THEN 'codemod-available' ELSE 'minor-migration' END AS effort,
       to_json(struct_pack(
         citation_url := 'https://github.com/e18e/module-replacements/blob/main/manifests/' || manifest || '#L' || (3 + 4 * (k // 3)),
         ids := ids, manifest := manifest, manifest_line := CAST(3 + 4 * (k // 3) AS BIGINT), source := 'e18e')) AS evidence_json
FROM mrows WHERE len(coalesce(targets, [])) > 0 OR has_native"""


@register("fn_json_evidence", with_views([], f"SELECT id, evidence_json FROM ({_EVIDENCE_SQL})", [QM._MAN_CTES]))
def fn_json_evidence(spark, sf):
    """Replacement evidence as JSON text with alphabetically ordered keys (NULL when empty)."""
    return _repl_rows(spark, sf).select("id", "evidence_json")


@register(
    "snk_land_replacements",
    with_views([], f"SELECT id, from_purl, to_purls, axis, effort, evidence_json, DATE '{SNAPSHOT_DATE}' AS ingest_date FROM ({_EVIDENCE_SQL})", [QM._MAN_CTES]),
)
def snk_land_replacements(spark, sf):
    """Manifest replacements landed as one snapshot date (evidence as JSON text), read back."""
    root = LD.scratch_root(spark)
    LD.land_snapshot(_repl_rows(spark, sf), root, "replacements", SNAPSHOT_DATE)
    d = LD.read_landed(spark, root, "replacements")
    return d.select("id", "from_purl", F.array_join("to_purls", ",").alias("to_purls"), "axis", "effort", "evidence_json", "ingest_date")


_DEP_COLS = [c for c, _ in LD.SCHEMAS["dependents"]]
_DEP_SQL = f"""
SELECT 'pkg:npm/' || parent AS parent_purl, purl AS dependent_purl, name AS dependent_name, repo_url AS dependent_repo_url,
       lifetime_downloads AS dependent_lifetime_downloads, DATE '{SNAPSHOT_DATE}' AS ingest_date FROM tiered"""


def _dep_rows(spark, sf):
    t = QF._tiered(spark, sf)
    return t.select(
        F.concat(F.lit("pkg:npm/"), F.col("parent")).alias("parent_purl"), F.col("purl").alias("dependent_purl"),
        F.col("name").alias("dependent_name"), F.col("repo_url").alias("dependent_repo_url"),
        F.col("lifetime_downloads").alias("dependent_lifetime_downloads"),
    )


_TIER_VIEWS = ["dependents_cache", "sbom_edges", "repositories", "registry_dependents"]


@register("snk_land_dependents", with_views(_TIER_VIEWS, _DEP_SQL, [QF._REG_SQL, QF._PRIM_SQL, QF._TIER_SQL]))
def snk_land_dependents(spark, sf):
    """Dependents per parent package flattened to one edge per row, landed as a snapshot."""
    root = LD.scratch_root(spark)
    LD.land_snapshot(_dep_rows(spark, sf), root, "dependents", SNAPSHOT_DATE)
    return LD.read_landed(spark, root, "dependents").select(*_DEP_COLS)


# ---- staging --------------------------------------------------------------------------------

@register(
    "stg_advisories",
    with_views(["advisories"], _ADV_FLAT_SQL + " WHERE ingest_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"),
)
def stg_advisories(spark, sf):
    """Staged advisories for 1996-01-01..1998-12-31 (partition-pruned on dt, filtered on ingest_date)."""
    root = _landed(spark, sf, "advisories", B.advisories(spark, sf))
    return _adv_flat(LD.stage(spark, root, "advisories", "1996-01-01", "1998-12-31"))


_STG_PROJ = [c for c in LD.STAGED["projects"]]


@register(
    "stg_projects",
    with_views(["projects"], f"SELECT {', '.join(_STG_PROJ)} FROM projects WHERE ingest_date BETWEEN DATE '1996-12-31' AND DATE '1999-12-31'"),
)
def stg_projects(spark, sf):
    """Staged projects (14 columns: bench_signal is not staged)."""
    root = _landed(spark, sf, "projects", B.projects(spark, sf))
    return LD.stage(spark, root, "projects", "1996-12-31", "1999-12-31")


@register(
    "stg_transitions",
    with_views(["transitions"], f"SELECT {', '.join(_TR_COLS)} FROM transitions WHERE ingest_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
)
def stg_transitions(spark, sf):
    root = _landed(spark, sf, "opportunity_transitions", B.transitions(spark, sf))
    return LD.stage(spark, root, "opportunity_transitions", "2024-01-05", "2024-01-20")


@register(
    "stg_replacements",
    with_views([], f"SELECT id, from_purl, to_purls, axis, effort, evidence_json, DATE '{SNAPSHOT_DATE}' AS ingest_date FROM ({_EVIDENCE_SQL})", [QM._MAN_CTES]),
)
def stg_replacements(spark, sf):
    root = LD.scratch_root(spark)
    LD.land_snapshot(_repl_rows(spark, sf), root, "replacements", SNAPSHOT_DATE)
    d = LD.stage(spark, root, "replacements", SNAPSHOT_DATE, SNAPSHOT_DATE)
    return d.select("id", "from_purl", F.array_join("to_purls", ",").alias("to_purls"), "axis", "effort", "evidence_json", "ingest_date")


@register("stg_dependents", with_views(_TIER_VIEWS, _DEP_SQL, [QF._REG_SQL, QF._PRIM_SQL, QF._TIER_SQL]))
def stg_dependents(spark, sf):
    root = LD.scratch_root(spark)
    LD.land_snapshot(_dep_rows(spark, sf), root, "dependents", SNAPSHOT_DATE)
    return LD.stage(spark, root, "dependents", SNAPSHOT_DATE, SNAPSHOT_DATE)


@register(
    "inc_time_range",
    with_views(["advisories"], """
SELECT id, project_purl, severity, round(cvss, 6) AS cvss,
       CASE WHEN ingest_date = (SELECT max(ingest_date) FROM advisories) THEN summary || ' (revised)' ELSE summary END AS summary,
       affected_versions, array_to_string(fixed_versions, ',') AS fixed_versions, array_to_string(refs, ',') AS refs,
       published_at, repo_url, ingest_date FROM advisories"""),
)
def inc_time_range(spark, sf):
    """Incremental staging: land all dates, stage them, re-land the newest date late, stage again.

    Each staging run is an ``availableNow`` stream that only picks up new
    files and rewrites the dates they touch.
    """
    root = LD.scratch_root(spark, "inc")
    adv = B.advisories(spark, sf)
    LD.land_partitioned(adv, root, "advisories")
    staging = f"{root}/staging/advisories"
    ckpt = f"{root}/_stream_checkpoint"
    run_incremental(spark, root, "advisories", staging, ckpt, "1900-01-01", "2100-12-31")
    newest = adv.agg(F.max("ingest_date").alias("d")).first()["d"].isoformat()  # one scalar
    late = adv.where(F.col("ingest_date") == F.lit(newest).cast("date")).withColumn("summary", F.concat("summary", F.lit(" (revised)")))
    LD.land_snapshot(late, root, "advisories", newest)
    run_incremental(spark, root, "advisories", staging, ckpt, "1900-01-01", "2100-12-31")
    staged = spark.read.schema(LD.struct_type("advisories", with_dt=True)).parquet(staging).drop("dt")
    return _adv_flat(staged)


@register("mart_full_refresh", with_views(["advisories", "projects"], MART_FLAT_SELECT, [MART_SQL_CORE]))
def mart_full_refresh(spark, sf):
    """All models rebuilt in full, audited and published together: a first build on a partial range, then one over all dates.

    A build that violates any audit never becomes visible.
    """
    root = LD.scratch_root(spark, "mart")
    sources = {"advisories": B.advisory_keys, "projects": B.projects, "opportunity_transitions": B.transitions}
    spell = {"advisories": B.advisory_columns()}
    for name, source in sources.items():
        LD.land_partitioned(source(spark, sf), root, name, spell=spell.get(name))
    versions = V.Versions(spark, f"{root}/models")
    for end in ("1997-12-31", "2100-12-31"):
        staged = {n: LD.stage(spark, root, n, "1900-01-01", end) for n in sources}
        V.write_audit_publish(versions, M.models(staged, DEFAULT_AS_OF), A.block)
    return _flat_mart(V.read_model(versions, "marts.opportunities"))


# ---- publishing -----------------------------------------------------------------------------

_PUB_VIEWS = QP._VIEWS
_PUB_CTES = QP._CTES + [QP.quota_ctes(10, "_10"), _BRIEFX]


def _pub_sql(body: str) -> str:
    return with_views(_PUB_VIEWS, body, _PUB_CTES)


def _publish_two_runs(spark, sf):
    """Run 1 publishes the top 20, run 2 the top 10; returns (path, published after run 1, selection of run 2)."""
    briefs = QP.ranked(spark, sf)["briefs"]
    path = f"{LD.scratch_root(spark, 'briefs')}/briefs"
    sel20 = P.top_axis_quota(briefs, 20)
    PB.snk_briefs(BR.render(sel20), path)
    before = cut_lineage(PB.src_briefs_read(spark, path).select("ecosystem", "slug"))
    sel10 = P.top_axis_quota(briefs, 10)
    PB.snk_briefs(BR.render(sel10), path)
    return path, before, sel10


@register("snk_briefs", _pub_sql("SELECT 'npm' AS ecosystem, slug, round(score, 6) AS score FROM selected_10"))
def snk_briefs(spark, sf):
    """Two publishing runs (top 20, then top 10): the table holds exactly the second selection."""
    path, _before, _sel = _publish_two_runs(spark, sf)
    return spark.read.schema(PB.BRIEFS_SCHEMA).parquet(path).select("ecosystem", "slug", r6("score").alias("score"))


@register(
    "src_briefs_read",
    _pub_sql(f"""
SELECT s.slug, s.name AS title, {Q.round_one_place('s.score')} AS score_total, s.top_kind, array_to_string(x.tags, ',') AS tags
FROM selected_10 s JOIN briefx x ON x.project_purl = s.project_purl"""),
)
def src_briefs_read(spark, sf):
    """Published briefs read back with the frontmatter schema (title, rounded total, top kind, tags)."""
    path, _before, _sel = _publish_two_runs(spark, sf)
    b = PB.src_briefs_read(spark, path)
    return b.select("slug", "title", "score_total", "top_kind", F.array_join("tags", ",").alias("tags"))


_STALE_SQL = "SELECT 'npm' AS ecosystem, slug FROM selected EXCEPT SELECT 'npm', slug FROM selected_10"


@register("join_anti_sweep", _pub_sql(_STALE_SQL))
def join_anti_sweep(spark, sf):
    """Briefs published by run 1 but not selected by run 2 (what the second write swept)."""
    _path, before, sel10 = _publish_two_runs(spark, sf)
    return PB.join_anti_sweep(before, sel10.withColumn("ecosystem", F.lit("npm")))


@register("set_difference_stale", _pub_sql(_STALE_SQL))
def set_difference_stale(spark, sf):
    """Stale documents as a set difference of the table before and after the second run."""
    path, before, _sel = _publish_two_runs(spark, sf)
    after = spark.read.schema(PB.BRIEFS_SCHEMA).parquet(path).select("ecosystem", "slug")
    return before.join(after, ["ecosystem", "slug"], "left_anti")


# ---- first-seen dedupe ------------------------------------------------------------------------

@register(
    "win_dedupe_first",
    with_views(["nested_flat"], """
SELECT project_purl, id, min(vuln_pos) AS vuln_pos FROM (
  SELECT id, 'pkg:' || lower(eco) || '/' || pkg_name AS project_purl, vuln_pos FROM flat_docs
  WHERE pkg_name IS NOT NULL AND pkg_name <> '' AND lower(coalesce(eco, '')) = 'npm' AND NOT has_fix)
GROUP BY project_purl, id""", [QA._FLAT_DOCS]),
)
def win_dedupe_first(spark, sf):
    """Same advisory id inside one project (a package listed twice): keep the first seen."""
    adv = ADV.flatten(B.nested_advisories(spark, sf), only_unpatched=True)
    d = W.win_dedupe_first(adv, ["project_purl", "id"], "vuln_pos")
    return d.select("project_purl", "id", F.col("vuln_pos").cast("bigint").alias("vuln_pos"))
