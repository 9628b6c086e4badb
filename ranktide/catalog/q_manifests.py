"""Phase 3/4 queries: manifest line jobs, direct-dependency verdicts, replacement manifests, fan-out checks.

The oracle never parses text: the repository files and manifests are laid out
by rule from the line items, so every expected line number, verdict and
signal follows arithmetically from the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ranktide.catalog import q_fanout as QF
from ranktide.catalog import q_pipeline as QP
from ranktide.catalog import repo_sql as RS
from ranktide.catalog.bridge_sql import with_views
from ranktide.catalog.registry import register
from ranktide.catalog.repo_sql import _LOC_SQL, REPO_CTES
from ranktide.functions.strings import permalink_locations
from ranktide.operators import lines as LN
from ranktide.plans import fanout as FO
from ranktide.session import cut_lineage
from ranktide.sources import bridge as B
from ranktide.sources import manifests as MF
from ranktide.sources import replacements as RP

# ---------------------------------------------------------------------------------------------
# Oracle CTEs: expected repository facts per order

def _rsql(body: str, extra: list[str] | None = None) -> str:
    return with_views([], body, [REPO_CTES] + (extra or []))


def _files(spark, sf):
    return B.repo_files(spark, sf)


@register("man_dep_lines", _rsql("SELECT repo_url, name, line FROM deplines"))
def man_dep_lines(spark, sf):
    """1-based line of every dependency declared in a root package.json (four sections, section depth)."""
    return MF.man_dep_lines(_files(spark, sf))


_CARRY_SQL = """
SELECT repo_url, CAST(line_no AS BIGINT) AS line_no, section FROM (
  SELECT repo_url, unnest(range(l0 + 2, l0 + 1 + greatest(n_r, 1) + 2)) AS line_no, 'dependencies' AS section FROM rexp WHERE ok
  UNION ALL
  SELECT repo_url, unnest(range(l0 + greatest(n_r, 1) + 4,
                                l0 + greatest(n_r, 1) + 3 + greatest(n_d + CASE WHEN o % 11 = 0 THEN 1 ELSE 0 END, 1) + 2)),
         'devDependencies' FROM rexp WHERE ok)"""


@register("win_line_carry", _rsql(_CARRY_SQL))
def win_line_carry(spark, sf):
    """Section carried forward over package.json lines: every line inside an open dependency section."""
    p = _files(spark, sf).where((F.col("path") == "package.json") & (F.col("status") == 200))
    x = p.select("repo_url", F.inline(LN.dep_section_lines(F.col("text"))))
    return x.select("repo_url", F.col("line_no").cast("bigint").alias("line_no"), "section")


@register("man_lockfile_importers", _rsql("SELECT repo_url, workspace, section, dep, CAST(line_no AS INTEGER) AS line_no FROM lockrows"))
def man_lockfile_importers(spark, sf):
    """(workspace, section, dependency) rows of the importers block of each pnpm lockfile."""
    x = MF.lockfile_importers(_files(spark, sf))
    return x.select("repo_url", "workspace", "section", "dep", F.col("line_no").cast("int").alias("line_no"))


@register("man_root_lockfile", _rsql("SELECT repo_url, has_root_lockfile FROM rexp"))
def man_root_lockfile(spark, sf):
    """Any of the three root lockfiles present: true / false / unknown."""
    return MF.man_root_lockfile(_files(spark, sf))


@register("man_is_monorepo", _rsql("SELECT repo_url, mono AS is_monorepo FROM rexp WHERE ok"))
def man_is_monorepo(spark, sf):
    """Non-empty ``workspaces`` (array, or object with a non-empty ``packages`` array)."""
    return MF.man_is_monorepo(_files(spark, sf))


@register(
    "man_direct_deps",
    _rsql("""
SELECT r.repo_url, r.verdict, CAST(count(d.name) AS BIGINT) AS n_names
FROM rverd r LEFT JOIN dnames d ON d.repo_url = r.repo_url GROUP BY r.repo_url, r.verdict"""),
)
def man_direct_deps(spark, sf):
    """Per repo: verdict (unknown / not_js / monorepo / set) and number of direct dependency names."""
    deps = MF.direct_deps(_files(spark, sf))
    n = F.when(F.col("repo_url").isNotNull(), F.size("names"))
    return deps.select("repo_url", "verdict", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint").alias("n_names"))


@register(
    "set_union_dep_names",
    _rsql("""
SELECT DISTINCT r.repo_url, 'part-' || i.pk AS name FROM rexp r JOIN oi i ON i.o = r.o WHERE r.ok AND NOT r.mono AND i.listed
UNION SELECT repo_url, 'tinybench' FROM rexp WHERE ok AND NOT mono AND o % 11 = 0"""),
)
def set_union_dep_names(spark, sf):
    """Distinct union of the runtime and dev dependency names of single-package repos."""
    repos = MF.repositories(_files(spark, sf))
    return MF.set_union_dep_names(repos.where(~F.col("is_monorepo"))).distinct()


_BENCH_SQL = _rsql("""
SELECT repo_url, sig IS NOT NULL AS has_benchmarks, sig AS bench_signal FROM (
  SELECT repo_url, CASE WHEN NOT ok THEN NULL WHEN o % 5 = 0 THEN 'script:bench:run'
                        WHEN o % 7 = 1 THEN 'script-cmd:test:perf' WHEN o % 11 = 0 THEN 'devDep:tinybench' END AS sig
  FROM rexp)""")


@register("man_bench_signal_all", _BENCH_SQL)  # an earlier name of the same query
@register("man_bench_signal", _BENCH_SQL)
def man_bench_signal(spark, sf):
    """Bench signal of every repository (script name, then vitest/jest bench command, then a known bench library);
    ``(false, NULL)`` where ``package.json`` isn't served."""
    return MF.man_bench_signal(_files(spark, sf))


def _loc_str(col):
    return F.array_join(F.transform(col, lambda l: F.concat(l["file"], F.when(l["line"].isNotNull(), F.concat(F.lit("#L"), l["line"].cast("string"))).otherwise(F.lit("")))), ";")


@register("man_dep_locations", _rsql(_LOC_SQL))
def man_dep_locations(spark, sf):
    """Where each direct dependency is declared: workspace files (monorepo) or the root file line."""
    locs = MF.man_dep_locations(None, _files(spark, sf))
    return locs.select("repo_url", "name", _loc_str(F.col("locations")).alias("locations"))


# ---- replacement manifests -------------------------------------------------------------------

_MAN_CTES = """
mapx AS (
  SELECT CASE l_partkey % 3 WHEN 0 THEN 'preferred.json' WHEN 1 THEN 'native.json' ELSE 'micro-utilities.json' END AS manifest,
         CASE l_partkey % 3 WHEN 0 THEN 'perf' ELSE 'bloat' END AS axis,
         'part-' || l_partkey AS from_name, l_partkey AS k,
         CASE WHEN l_partkey % 11 = 0 THEN ['r' || min(l_suppkey), 'r' || max(l_suppkey), 'unknown-' || l_partkey]
              ELSE ['r' || min(l_suppkey), 'r' || max(l_suppkey)] END AS ids
  FROM lineitem GROUP BY l_partkey
),
repx AS (
  SELECT m.manifest, 'r' || s_suppkey AS id,
         (['documented', 'native', 'simple', 'removal'])[((s_nationkey + m.idx) % 4) + 1] AS type, s_suppkey
  FROM supplier, (VALUES ('preferred.json', 0), ('native.json', 1), ('micro-utilities.json', 2)) m(manifest, idx)
),
repx2 AS (SELECT *, CASE WHEN type = 'documented' AND s_suppkey % 5 <> 0 THEN 'mod-' || s_suppkey END AS module FROM repx),
resolved AS (
  SELECT x.manifest, x.axis, x.from_name, x.k, x.pos - 1 AS pos, x.rid,
         CASE WHEN r.id IS NULL THEN x.rid WHEN r.type = 'documented' THEN coalesce(nullif(r.module, ''), x.rid) END AS target,
         CASE WHEN r.id IS NULL THEN 'documented' ELSE r.type END AS type
  FROM (SELECT manifest, axis, from_name, k, unnest(ids) AS rid, generate_subscripts(ids, 1) AS pos FROM mapx) x
  LEFT JOIN repx2 r ON r.manifest = x.manifest AND r.id = x.rid
),
mrows AS (
  SELECT manifest, axis, from_name, k,
         list(target ORDER BY pos) FILTER (WHERE target IS NOT NULL) AS targets,
         max(CASE CASE type WHEN 'native' THEN 'drop-in' WHEN 'documented' THEN 'minor-migration'
                            WHEN 'simple' THEN 'codemod-available' WHEN 'removal' THEN 'drop-in' ELSE 'minor-migration' END
               WHEN 'drop-in' THEN 4 WHEN 'codemod-available' THEN 3 WHEN 'minor-migration' THEN 2 WHEN 'rewrite' THEN 1 ELSE 0 END) AS r,
         bool_or(type = 'native') AS has_native,
         string_agg(rid, ',' ORDER BY pos) AS ids
  FROM resolved GROUP BY manifest, axis, from_name, k
)"""


def _man_sql(body: str) -> str:
    return with_views([], body, [_MAN_CTES])


@register(
    "src_resolve_target",
    _man_sql("SELECT manifest, from_name, CAST(pos AS BIGINT) AS pos, rid, target, type FROM resolved"),
)
def src_resolve_target(spark, sf):
    """Replacement id -> (target, type): unknown ids are their own documented target."""
    r = RP.src_resolve_target(B.e18e_mappings(spark, sf), B.e18e_replacements(spark, sf))
    return r.select("manifest", "from_name", F.col("pos").cast("bigint").alias("pos"), "rid", "target", "type")


@register(
    "src_manifest_line_index",
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'preferred.json' WHEN 1 THEN 'native.json' ELSE 'micro-utilities.json' END AS manifest, "
    "'part-' || p_partkey AS key, CAST(3 + 4 * (p_partkey // 3) AS INTEGER) AS line FROM part",
)
def src_manifest_line_index(spark, sf):
    """Line of each mapping key inside the manifests' ``mappings`` block (replacement keys excluded)."""
    return LN.src_manifest_line_index(B.e18e_manifest_lines(spark, sf), ["manifest"])


@register(
    "src_replacement_manifests",
    _man_sql("""
SELECT 'e18e:' || manifest || ':' || from_name AS id, 'pkg:npm/' || from_name AS from_purl,
       CASE WHEN len(coalesce(targets, [])) > 0 THEN array_to_string(list_transform(targets, lambda t: 'pkg:npm/' || t), ',')
            ELSE 'pkg:npm/<native>' END AS to_purls,
       axis, CASE greatest(r, 2) WHEN 4 THEN 'drop-in' WHEN 3 THEN 'codemod-available' ELSE 'minor-migration' END AS effort,
       ids, CAST(3 + 4 * (k // 3) AS BIGINT) AS manifest_line
FROM mrows WHERE len(coalesce(targets, [])) > 0 OR has_native"""),
)
def src_replacement_manifests(spark, sf):
    """Per manifest entry: resolved targets (or native), easiest band, ids and the entry's manifest line."""
    idx = LN.src_manifest_line_index(B.e18e_manifest_lines(spark, sf), ["manifest"])
    r = RP.src_replacement_manifests(B.e18e_mappings(spark, sf), B.e18e_replacements(spark, sf), idx)
    return r.select("id", "from_purl", F.array_join("to_purls", ",").alias("to_purls"), "axis", "effort",
                    F.col("evidence.ids").alias("ids"), "manifest_line")


# ---- fan-out verification ---------------------------------------------------------------------

_CASE_SQL = f"""
cases AS (
  SELECT f.from_purl, f.dep_purl, f.dep_repo_url,
         CASE WHEN coalesce(f.dep_repo_url, '') = '' THEN 'no_repo'
              WHEN v.verdict IS NULL OR v.verdict = 'unknown' THEN 'unknown'
              WHEN v.verdict = 'not_js' THEN 'not_js'
              WHEN v.verdict = 'monorepo' THEN 'monorepo'
              WHEN d.name IS NOT NULL THEN 'direct' ELSE 'transitive' END AS dep_case
  FROM fanx_all f
  LEFT JOIN rverd v ON v.repo_url = {RS.same_repo('f.dep_repo_url')}
  LEFT JOIN dnames d ON d.repo_url = {RS.same_repo('f.dep_repo_url')} AND d.name = substr(f.from_purl, 9)
)"""


def _fsql(body: str, extra: list[str] | None = None, top: bool = False) -> str:
    """Over all candidates; ``top``: over the ranked cut."""
    ctes = [QF.ALL_FANOUT_SQL if c == QF._TOP_FANOUT_SQL and not top else c for c in QP._CTES]
    return with_views(QP._VIEWS, body, ctes + [_CASE_SQL] + (extra or []))


def _verified(spark, sf):
    """(cases of all candidates, locations of the direct ones); the candidates and their repositories' files are written once."""
    fan = QP.fanout_candidates(spark, sf, None)
    _kept, locs, cases, _f = FO.pipe_fanout(fan, _files(spark, sf), stage=cut_lineage)
    return cases, locs


@register("flt_direct_dep", _fsql("SELECT from_purl, dep_purl, dep_case, dep_case IN ('no_repo', 'unknown', 'monorepo', 'direct') AS keep FROM cases"))
def flt_direct_dep(spark, sf):
    """Five-way verdict per (replacement, dependent) candidate and whether it is kept."""
    return _verified(spark, sf)[0].select("from_purl", "dep_purl", "dep_case", "keep")


@register(
    "agg_filter_counters",
    _fsql("""
SELECT CAST(count(*) FILTER (WHERE dep_case IN ('no_repo', 'unknown', 'monorepo', 'direct')) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE dep_case NOT IN ('no_repo', 'unknown', 'monorepo', 'direct')) AS BIGINT) AS dropped,
       CAST(count(*) FILTER (WHERE dep_case IN ('no_repo', 'unknown')) AS BIGINT) AS unknown,
       CAST(count(*) FILTER (WHERE dep_case = 'monorepo') AS BIGINT) AS monorepo,
       CAST(count(*) FILTER (WHERE dep_case = 'not_js') AS BIGINT) AS not_js
FROM cases"""),
)
def agg_filter_counters(spark, sf):
    return FO.agg_filter_counters(_verified(spark, sf)[0])


_JLOC_SQL = f"""
jloc AS (
  SELECT c.dep_purl, c.from_purl, c.dep_repo_url, l.locations FROM cases c
  JOIN ({_LOC_SQL}) l ON l.repo_url = {RS.same_repo('c.dep_repo_url')} AND l.name = substr(c.from_purl, 9)
  WHERE c.dep_case = 'direct'
)"""


@register("join_locations", _fsql("SELECT dep_purl, from_purl, locations FROM jloc", [_JLOC_SQL]))
def join_locations(spark, sf):
    """(dependent, from-package) -> declared locations, for direct-dependency candidates."""
    _cases, l = _verified(spark, sf)
    return l.select("dep_purl", "from_purl", _loc_str(F.col("locations")).alias("locations"))


@register(
    "fn_permalink",
    _fsql("""
SELECT dep_purl, from_purl, string_agg(rtrim(dep_repo_url, '/') || '/blob/' || CASE WHEN length(dep_purl) % 2 = 0 THEN md5(dep_purl) ELSE 'HEAD' END || '/' || loc, ';' ORDER BY ord) AS urls
FROM (SELECT dep_purl, from_purl, dep_repo_url, unnest(string_split(locations, ';')) AS loc,
             generate_subscripts(string_split(locations, ';'), 1) AS ord FROM jloc)
GROUP BY dep_purl, from_purl""", [_JLOC_SQL]),
)
def fn_permalink(spark, sf):
    """Pinned permalinks ``<repo>/blob/<sha or HEAD>/<file>[#L<line>]`` for each location."""
    cases, l = _verified(spark, sf)
    repo = cases.select("dep_purl", "from_purl", "dep_repo_url").distinct()
    j = l.join(repo, ["dep_purl", "from_purl"])
    # Some repositories' head commit is known: those links are pinned to it.
    sha = F.when(F.length("dep_purl") % 2 == 0, F.md5("dep_purl"))
    links = permalink_locations(F.col("dep_repo_url"), sha, F.col("locations"))
    return j.select("dep_purl", "from_purl", F.array_join(F.transform(links, lambda x: x["url"]), ";").alias("urls"))


@register(
    "pipe_fanout",
    _fsql("""
SELECT c.from_purl, c.dep_purl, c.dep_case, l.locations FROM cases c
LEFT JOIN jloc l ON l.dep_purl = c.dep_purl AND l.from_purl = c.from_purl
WHERE c.dep_case IN ('no_repo', 'unknown', 'monorepo', 'direct')""", [_JLOC_SQL], top=True),
)
def pipe_fanout(spark, sf):
    """Dedupe -> top 40 by downloads -> tiered dependents -> direct-dependency filter -> locations."""
    fan = QP.fanout_candidates(spark, sf)
    kept, locs, _cases_df, _f = FO.pipe_fanout(fan, _files(spark, sf), stage=cut_lineage)
    j = kept.join(locs, ["dep_purl", "from_purl"], "left")
    return j.select("from_purl", "dep_purl", "dep_case", _loc_str(F.col("locations")).alias("locations"))


_ = QF  # tiers and cache come in through the pipeline CTEs
