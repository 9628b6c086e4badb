"""Phase 2/3 queries: replacement dedupe and bands, dependents sources, tiers, cache, fan-out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ranktide.catalog import sqlfn as Q
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.registry import register
from ranktide.functions import scoring as S
from ranktide.functions.strings import purl_name
from ranktide.functions.util import ts_ntz
from ranktide.operators import aggregates as AG
from ranktide.operators import windows as W
from ranktide.plans import fanout as FO
from ranktide.session import checkpoint_dir
from ranktide.sources import bridge as B
from ranktide.sources import dependents as D
from ranktide.sources import lookups as L

CACHE_WEEK = "2024-W03"
NPM_RE = "^(@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*$"


@register("fn_effort_band", with_views(["replacements"], f"SELECT id, effort, {Q.band_score('effort')} AS effort_score FROM replacements"))
def fn_effort_band(spark, sf):
    r = B.replacements(spark, sf)
    return r.select("id", "effort", S.effort_band_score("effort").alias("effort_score"))


@register(
    "fn_replacement_severity",
    with_views(["replacements"], f"SELECT id, {Q.repl_severity('axis', Q.is_native('to_purls'))} AS severity FROM replacements"),
)
def fn_replacement_severity(spark, sf):
    r = B.replacements(spark, sf)
    return r.select("id", S.replacement_severity("axis", S.is_native("to_purls")).alias("severity"))


_DEDUPE_SQL = f"""
dedup AS (
  SELECT * FROM (
    SELECT *, {Q.band_score('effort')} AS effort_score,
           row_number() OVER (PARTITION BY from_purl ORDER BY {Q.band_score('effort')} DESC, seq ASC) AS rn,
           min(seq) OVER (PARTITION BY from_purl) AS first_seq
    FROM replacements) WHERE rn = 1
)"""


@register("win_dedupe_easiest", with_views(["replacements"], "SELECT from_purl, id, effort, effort_score, CAST(first_seq AS BIGINT) AS first_seq FROM dedup", [_DEDUPE_SQL]))
def win_dedupe_easiest(spark, sf):
    """Per from-package the easiest replacement (ties: earlier); plus where it first appeared."""
    return AG.dedupe_easiest(B.replacements(spark, sf)).select("from_purl", "id", "effort", "effort_score", "first_seq")


@register(
    "agg_easiest_band",
    with_views(["replacements"], """
SELECT from_purl, CASE greatest(max(CASE effort WHEN 'drop-in' THEN 4 WHEN 'codemod-available' THEN 3
                                     WHEN 'minor-migration' THEN 2 WHEN 'rewrite' THEN 1 ELSE 0 END), 2)
                  WHEN 4 THEN 'drop-in' WHEN 3 THEN 'codemod-available' WHEN 2 THEN 'minor-migration' END AS effort
FROM replacements GROUP BY from_purl"""),
)
def agg_easiest_band(spark, sf):
    """Easiest band over all replacement ids of a from-package, floor minor-migration."""
    return AG.agg_easiest_band(B.replacements(spark, sf), ["from_purl"], band="effort")


_DL_SQL = """
downloads AS (
  SELECT substr(purl, 9) AS name, downloads_weekly FROM (
    SELECT purl, downloads_weekly, row_number() OVER (PARTITION BY purl ORDER BY ingest_date DESC) AS rn FROM projects)
  WHERE rn = 1
)"""

_TOP_FANOUT_SQL = """
top_fanout AS (
  SELECT d.from_purl, d.id, d.axis, d.effort, d.to_purls, d.manifest, d.manifest_line, d.seq, d.first_seq,
         dl.downloads_weekly
  FROM dedup d LEFT JOIN downloads dl ON dl.name = substr(d.from_purl, 9)
  ORDER BY coalesce(dl.downloads_weekly, 0) DESC, d.first_seq ASC
  LIMIT 40
)"""


# The same without the cut, for the operators that aren't a top-n.
ALL_FANOUT_SQL = _TOP_FANOUT_SQL.replace("LIMIT 40", "")


def _top_fanout(spark, sf, n=40):
    dl = L.src_weekly_downloads(W.win_latest_project(B.projects(spark, sf)))
    return FO.top_fanout(B.replacements(spark, sf), dl, n)


@register(
    "top_fanout",
    with_views(["replacements", "projects"], "SELECT from_purl, id, downloads_weekly, CAST(first_seq AS BIGINT) AS first_seq FROM top_fanout", [_DEDUPE_SQL, _DL_SQL, _TOP_FANOUT_SQL]),
)
def top_fanout(spark, sf):
    """Deduped from-packages ranked by weekly downloads (unknown = 0), stable, first 40."""
    return _top_fanout(spark, sf).select("from_purl", "id", "downloads_weekly", "first_seq")


_REG_SQL = """
reg AS (
  SELECT package AS parent, name, 'pkg:npm/' || name AS purl, repository_url AS repo_url,
         CAST(downloads AS BIGINT) AS lifetime_downloads, rank
  FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY downloads DESC NULLS LAST, name ASC NULLS FIRST) AS rank
        FROM registry_dependents)
  WHERE rank <= 5 AND name IS NOT NULL AND name <> ''
)"""

_PRIM_SQL = f"""
prim AS (
  SELECT parent, ns || '/' || nm AS name, 'pkg:github/' || ns || '/' || nm AS purl,
         coalesce(artifact_url, 'https://github.com/' || ns || '/' || nm) AS repo_url,
         CAST(NULL AS BIGINT) AS lifetime_downloads, rank
  FROM (
    SELECT s.package_artifact_name AS parent, s.dependent_artifact_namespace AS ns, s.dependent_artifact_name AS nm,
           r.artifact_url,
           row_number() OVER (PARTITION BY s.package_artifact_name
                              ORDER BY r.star_count DESC NULLS LAST, s.dependent_artifact_namespace NULLS FIRST,
                                       s.dependent_artifact_name NULLS FIRST) AS rank
    FROM sbom_edges s LEFT JOIN repositories r ON s.dependent_artifact_id = r.artifact_id
    WHERE s.package_artifact_source = 'NPM' AND s.dependent_artifact_source = 'GITHUB'
      AND regexp_matches(s.package_artifact_name, '{NPM_RE}') AND r.star_count >= 10)
  WHERE rank <= 5 AND coalesce(ns, '') <> '' AND coalesce(nm, '') <> ''
)"""

_EDGE_OUT = "parent, name, purl, repo_url, lifetime_downloads, CAST(rank AS BIGINT) AS rank"


def _edge_out(df):
    return df.select("parent", "name", "purl", "repo_url", "lifetime_downloads", F.col("rank").cast("bigint").alias("rank"))


@register("src_dependents_registry", with_views(["registry_dependents"], f"SELECT {_EDGE_OUT} FROM reg", [_REG_SQL]))
def src_dependents_registry(spark, sf):
    """Registry dependents: top 5 per package by lifetime downloads; nameless rows dropped."""
    return _edge_out(D.src_dependents_registry(B.registry_dependents(spark, sf), 5))


@register("src_dependents_sbom_join", with_views(["sbom_edges", "repositories"], f"SELECT {_EDGE_OUT} FROM prim", [_PRIM_SQL]))
def src_dependents_sbom_join(spark, sf):
    """SBOM edges joined to repositories with at least 10 stars; top 5 per package by stars."""
    return _edge_out(D.src_dependents_sbom_join(B.sbom_edges(spark, sf), B.repositories(spark, sf), 10, 5))


_TIER_SQL = f"""
req AS (SELECT DISTINCT 'part-' || p_partkey AS name FROM part),
hits AS (
  SELECT r.name, c.payload FROM req r
  JOIN dependents_cache c ON c.name = r.name AND c.system = 'npm' AND c.iso_week = '{CACHE_WEEK}'
),
c_edges AS (
  SELECT parent, d.name AS name, d.purl AS purl, d.repo_url AS repo_url, d.lifetime_downloads AS lifetime_downloads,
         pos AS rank, 0 AS tier
  FROM (SELECT name AS parent, unnest(payload) AS d, generate_subscripts(payload, 1) AS pos FROM hits)
  WHERE pos <= 5
),
p_edges AS (SELECT *, 1 AS tier FROM prim WHERE parent IN (SELECT name FROM req)),
f_edges AS (SELECT *, 2 AS tier FROM reg WHERE parent IN (SELECT name FROM req)),
chosen AS (
  SELECT parent, min(tier) AS tier FROM (
    SELECT name AS parent, 0 AS tier FROM hits
    UNION ALL SELECT parent, tier FROM p_edges UNION ALL SELECT parent, tier FROM f_edges)
  GROUP BY parent
),
tiered AS (
  SELECT e.* FROM (SELECT * FROM c_edges UNION ALL SELECT * FROM p_edges UNION ALL SELECT * FROM f_edges) e
  JOIN chosen c ON c.parent = e.parent AND c.tier = e.tier
)"""

_TIER_VIEWS = ["part", "dependents_cache", "sbom_edges", "repositories", "registry_dependents"]


def _tiered(spark, sf, requests=None):
    req = requests if requests is not None else B.read(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"))
    cache = B.dependents_cache(spark, sf)
    missed = D.cache_misses(cache, req, CACHE_WEEK)
    prim = D.src_dependents_sbom_join(B.sbom_edges(spark, sf), B.repositories(spark, sf), 10, 5, parents=missed)
    fb = D.src_dependents_registry(B.registry_dependents(spark, sf), 5, parents=missed)
    return D.join_tiered_source(req, cache, prim, fb, CACHE_WEEK, 5)


@register(
    "join_tiered_source",
    with_views([v for v in _TIER_VIEWS if v != "part"], f"SELECT {_EDGE_OUT}, CAST(tier AS BIGINT) AS tier FROM tiered", [_REG_SQL, _PRIM_SQL, _TIER_SQL]),
)
def join_tiered_source(spark, sf):
    """Per package: this week's cache hit, else the SBOM source if non-empty, else the registry."""
    t = _tiered(spark, sf)
    return t.select(
        "parent", "name", "purl", "repo_url", "lifetime_downloads", F.col("rank").cast("bigint").alias("rank"), F.col("tier").cast("bigint").alias("tier")
    )


@register(
    "top_dependents",
    with_views([v for v in _TIER_VIEWS if v != "part"], "SELECT parent, CAST(count(*) AS BIGINT) AS n, max(rank) AS max_rank FROM tiered GROUP BY parent", [_REG_SQL, _PRIM_SQL, _TIER_SQL]),
)
def top_dependents(spark, sf):
    """At most K=5 dependents per parent after the tier choice (count and highest rank per parent)."""
    t = _tiered(spark, sf)
    return t.groupBy("parent").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.max("rank").alias("max_rank"))


@register(
    "cache_lookup",
    with_views(["dependents_cache"], f"""
SELECT r.name, c.name IS NOT NULL AS hit, CAST(len(c.payload) AS BIGINT) AS payload_size, c.written_at
FROM (SELECT DISTINCT 'part-' || p_partkey AS name FROM part) r
LEFT JOIN (SELECT * FROM dependents_cache WHERE system = 'npm' AND iso_week = '{CACHE_WEEK}') c ON c.name = r.name"""),
)
def cache_lookup(spark, sf):
    """Hit iff a row exists for (system, name, this week); an empty list is a hit."""
    req = B.read(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"))
    h = D.cache_lookup(B.dependents_cache(spark, sf), req, CACHE_WEEK)
    return h.select("name", "hit", F.size("payload").cast("bigint").alias("payload_size"), "written_at").withColumn(
        "payload_size", F.when(F.col("hit"), F.col("payload_size"))
    )


@register(
    "cache_upsert",
    with_views([v for v in _TIER_VIEWS if v != "part"], f"""
SELECT system, name, iso_week, CAST(len(payload) AS BIGINT) AS payload_size, written_at FROM (
  SELECT *, row_number() OVER (PARTITION BY system, name, iso_week ORDER BY written_at DESC) AS rn FROM (
    SELECT system, name, iso_week, payload, written_at FROM dependents_cache
    UNION ALL
    SELECT 'npm', parent, '{CACHE_WEEK}',
           list(struct_pack(name := name, purl := purl, repo_url := repo_url, lifetime_downloads := lifetime_downloads) ORDER BY rank),
           TIMESTAMP '2024-02-01 00:00:00'
    FROM tiered WHERE tier <> 0 GROUP BY parent))
WHERE rn = 1""", [_REG_SQL, _PRIM_SQL, _TIER_SQL]),
)
def cache_upsert(spark, sf):
    """Live tier results written back for this week: insert-or-replace, newest written_at wins.

    The cache is a bucketed table: its rows so far are one write, this week's the next; the result is read back.
    """
    table = D.cache_table(spark, f"{checkpoint_dir(spark).rstrip('/')}/dependents-cache-{uuid.uuid4().hex}")
    D.cache_upsert(table, B.dependents_cache(spark, sf))
    D.cache_upsert(table, D.new_cache_rows(_tiered(spark, sf), CACHE_WEEK, ts_ntz("2024-02-01 00:00:00")))
    u = table.read()
    return u.select("system", "name", "iso_week", F.size("payload").cast("bigint").alias("payload_size"), "written_at")


_FANOUT_SQL = """
fan AS (
  SELECT f.from_purl, f.id AS rep_id, f.first_seq, t.purl AS dep_purl, t.name AS dep_name, t.repo_url AS dep_repo_url,
         t.rank AS dep_rank, t.tier
  FROM top_fanout f JOIN tiered t ON t.parent = substr(f.from_purl, 9)
)"""


def _fan(spark, sf):
    tf = _top_fanout(spark, sf, None)
    req = tf.select(purl_name("from_purl").alias("name"))
    return FO.join_fanout_dependents(tf, _tiered(spark, sf, req))


@register(
    "join_fanout_dependents",
    with_views(["replacements", "projects"] + [v for v in _TIER_VIEWS if v != "part"],
               "SELECT from_purl, rep_id, dep_purl, dep_repo_url, CAST(dep_rank AS BIGINT) AS dep_rank, CAST(tier AS BIGINT) AS tier FROM fan",
               [_DEDUPE_SQL, _DL_SQL, ALL_FANOUT_SQL, _REG_SQL, _PRIM_SQL, _TIER_SQL, _FANOUT_SQL]),
)
def join_fanout_dependents(spark, sf):
    """Every replacement candidate x its tiered dependents (one-to-many)."""
    f = _fan(spark, sf)
    return f.select("from_purl", "rep_id", "dep_purl", "dep_repo_url", F.col("dep_rank").cast("bigint").alias("dep_rank"), F.col("tier").cast("bigint").alias("tier"))


@register(
    "win_dedupe_edges",
    with_views(["replacements"] + [v for v in _TIER_VIEWS if v != "part"], f"""
SELECT parent_purl, dependent_purl, CAST(first_seq AS BIGINT) AS first_seq FROM (
  SELECT r.from_purl AS parent_purl, t.purl AS dependent_purl, r.seq AS first_seq,
         row_number() OVER (PARTITION BY r.from_purl, t.purl ORDER BY r.seq) AS rn
  FROM replacements r JOIN tiered t ON t.parent = substr(r.from_purl, 9)) WHERE rn = 1""",
               [_REG_SQL, _PRIM_SQL, _TIER_SQL.replace("SELECT DISTINCT 'part-' || p_partkey AS name FROM part", "SELECT DISTINCT substr(from_purl, 9) AS name FROM replacements")]),
)
def win_dedupe_edges(spark, sf):
    """(replacement, dependent) pairs deduped per (parent, dependent), first by arrival order."""
    r = B.replacements(spark, sf).select("from_purl", "seq")
    req = r.select(purl_name("from_purl").alias("name"))
    t = _tiered(spark, sf, req)
    pairs = r.join(t, t.parent == purl_name(r.from_purl)).select(
        F.col("from_purl").alias("parent_purl"), F.col("purl").alias("dependent_purl"), "seq"
    )
    d = W.win_dedupe_first(pairs, ["parent_purl", "dependent_purl"], "seq")
    return d.select("parent_purl", "dependent_purl", F.col("seq").cast("bigint").alias("first_seq"))
