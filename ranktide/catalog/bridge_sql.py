"""DuckDB SQL of the domain-table bridge (mirror of ``ranktide.sources.bridge``).

Used only by the oracle queries: each oracle statement is ``WITH <views> <body>``
over the pre-registered test tables.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-11-10 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["projects"] = """
projects AS (
  SELECT
    'pkg:npm/part-' || p_partkey AS purl,
    'npm' AS ecosystem,
    'part-' || p_partkey AS name,
    'https://github.com/org' || (p_partkey % 97) || '/part-' || p_partkey AS repo_url,
    CAST(NULL AS VARCHAR) AS homepage,
    CAST(floor(p_retailprice) AS BIGINT) AS stars,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(qty * 1000 AS BIGINT) END AS downloads_weekly,
    CAST(nsupp AS BIGINT) AS dependents,
    first_ship AS last_release_at,
    last_ship AS last_commit_at,
    CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE last_ship END AS last_pr_merged_at,
    ((p_partkey + y) % 10 = 0) AS archived,
    CASE WHEN p_partkey % 3 = 0 THEN TRUE WHEN p_partkey % 3 = 1 THEN FALSE ELSE NULL END AS has_benchmarks,
    CASE WHEN p_partkey % 3 = 0 THEN 'devDep:tinybench' END AS bench_signal,
    make_date(CAST(y AS BIGINT), 12, 31) AS ingest_date
  FROM (
    SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity) AS qty,
           count(DISTINCT l_suppkey) AS nsupp, min(l_shipdate) AS first_ship,
           max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_partkey, year(l_shipdate)
  ) g JOIN part ON g.l_partkey = part.p_partkey
)"""

VIEWS["advisories"] = """
advisories AS (
  SELECT
    'ADV-' || l_partkey || '-' || l_linenumber AS id,
    'pkg:npm/part-' || l_partkey AS project_purl,
    CASE WHEN disc >= 0.08::DOUBLE THEN 'critical' WHEN disc >= 0.04::DOUBLE THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN maxflag = 'R' THEN NULL ELSE disc * 100.0::DOUBLE END AS cvss,
    CASE WHEN minstatus = 'F' THEN 'Breaking change required in part-' || l_partkey
         ELSE 'Prototype pollution in part-' || l_partkey END AS summary,
    CASE WHEN l_partkey % 6 = 0 THEN '< ' || (p_size + l_linenumber - 3) || '.0.0'
         WHEN l_partkey % 6 = 1 THEN '>= 1.0.0, < ' || p_size || '.' || l_linenumber || '.0'
         WHEN l_partkey % 6 = 2 THEN '<= ' || (p_size - 4) || '.' || l_linenumber
         WHEN l_partkey % 6 = 3 THEN '>= ' || p_size || '.0.0, <= ' || (p_size + 1) || '.0.0,'
         WHEN l_partkey % 6 = 4 THEN '~> 1.' || l_linenumber
         ELSE NULL END AS affected_versions,
    CASE WHEN minflag = 'A' THEN [CASE WHEN l_linenumber % 3 = 0 THEN 'v' || l_linenumber || '.1.0'
                                       WHEN l_linenumber % 3 = 1 THEN l_linenumber || '.2.3'
                                       ELSE 'next-' || l_linenumber END]
         ELSE CAST([] AS VARCHAR[]) END AS fixed_versions,
    ['https://example.org/advisories/ADV-' || l_partkey || '-' || l_linenumber] AS refs,
    l_shipdate AS published_at,
    'https://github.com/org' || (l_partkey % 97) || '/part-' || l_partkey AS repo_url,
    CAST(l_shipdate AS DATE) AS ingest_date
  FROM (
    SELECT l_partkey, l_linenumber, l_shipdate, max(l_discount) AS disc,
           max(l_returnflag) AS maxflag, min(l_returnflag) AS minflag, min(l_linestatus) AS minstatus
    FROM lineitem GROUP BY l_partkey, l_linenumber, l_shipdate
  ) g JOIN part ON g.l_partkey = part.p_partkey
)"""

VIEWS["transitions"] = """
transitions AS (
  SELECT
    'pkg:npm/part-' || user_id || '|ADV-' || user_id || '-' || (1 + event_id % 7) AS dedupe_key,
    CASE event_type WHEN 'view' THEN 'new' WHEN 'signup' THEN 'acknowledged'
         WHEN 'click' THEN 'resolved' WHEN 'error' THEN 'rejected' ELSE 'duplicate' END AS to_state,
    ts AS transitioned_at,
    'user-' || user_id AS actor,
    event_type || ':' || event_id AS reason,
    CAST(ts AS DATE) AS ingest_date
  FROM events
)"""

VIEWS["sbom_edges"] = """
sbom_edges AS (
  SELECT DISTINCT
    CASE WHEN p_type = 'SMALL' THEN 'PYPI' ELSE 'NPM' END AS package_artifact_source,
    'part-' || l_partkey AS package_artifact_name,
    'GITHUB' AS dependent_artifact_source,
    'repo-' || s_suppkey AS dependent_artifact_id,
    'nation' || s_nationkey AS dependent_artifact_namespace,
    'supp-' || s_suppkey AS dependent_artifact_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

VIEWS["repositories"] = """
repositories AS (
  SELECT
    'repo-' || s_suppkey AS artifact_id,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL
         ELSE 'https://github.com/nation' || s_nationkey || '/supp-' || s_suppkey END AS artifact_url,
    CAST(floor(s_acctbal / 10) AS BIGINT) AS star_count
  FROM supplier
)"""

VIEWS["registry_dependents"] = """
registry_dependents AS (
  SELECT
    'part-' || l_partkey AS package,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'order-' || l_orderkey END AS name,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'https://github.com/cust/order-' || l_orderkey
         || CASE l_orderkey % 4 WHEN 1 THEN '.git' WHEN 2 THEN '/' ELSE '' END END AS repository_url,
    CAST(sum(l_quantity) AS BIGINT) AS downloads
  FROM lineitem GROUP BY l_partkey, l_orderkey
)"""

VIEWS["replacements"] = """
replacements AS (
  SELECT
    'e18e:' || manifest || ':part-' || (p_partkey % 500) || '#' || p_partkey AS id,
    'pkg:npm/part-' || (p_partkey % 500) AS from_purl,
    CASE WHEN p_size % 4 = 0 THEN ['pkg:npm/<native>'] ELSE ['pkg:npm/alt-' || p_partkey] END AS to_purls,
    CASE WHEN p_partkey % 3 = 0 THEN 'perf' ELSE 'bloat' END AS axis,
    CASE WHEN p_size % 4 = 0 THEN 'drop-in' WHEN p_size % 4 = 1 THEN 'minor-migration'
         WHEN p_size % 4 = 2 THEN 'codemod-available' ELSE 'rewrite' END AS effort,
    manifest,
    CAST(p_size * 3 + 2 AS BIGINT) AS manifest_line,
    CAST(p_partkey AS BIGINT) AS seq
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'preferred.json' WHEN p_partkey % 3 = 1 THEN 'native.json'
                       ELSE 'micro-utilities.json' END AS manifest FROM part) x
)"""

VIEWS["registry_docs"] = """
registry_docs AS (
  SELECT
    'part-' || p_partkey AS name,
    '{"name": "part-' || p_partkey || '", "dist-tags": {"latest": "' ||
      CASE WHEN p_partkey % 7 = 0 THEN 'v' || base
           WHEN p_partkey % 7 = 1 THEN base || '-beta.1'
           WHEN p_partkey % 7 = 2 THEN 'latest-build'
           WHEN p_partkey % 7 = 3 THEN ''
           ELSE base END || '", "next": "99.0.0"}}' AS doc
  FROM (SELECT *, p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 3) AS base FROM part) x
)"""

# Flat form of the nested advisory documents: one row per (order, line item).
VIEWS["nested_flat"] = """
nested_flat AS (
  SELECT
    'GHSA-' || o_orderkey AS id,
    o_orderkey AS page_pos,
    CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS vuln_pos,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Issue in order ' || o_orderkey END AS summary,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
         WHEN '4-NOT SPECIFIED' THEN 'MEDIUM' ELSE 'low' END AS severity,
    CASE WHEN o_orderkey % 11 = 0 THEN '2001-01-01T00:00:00Z' END AS withdrawn_at,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_at,
    CASE WHEN o_orderkey % 4 = 0 THEN ''
         ELSE 'https://github.com/org' || (min(l_partkey) OVER (PARTITION BY o_orderkey) % 97) || '/part-'
              || min(l_partkey) OVER (PARTITION BY o_orderkey) END AS source_code_location,
    'https://example.org/GHSA-' || o_orderkey AS ref,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 10.0::DOUBLE END AS legacy_score,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 90 AS DOUBLE) / 10.0::DOUBLE END AS v3_score,
    CASE WHEN o_orderkey % 2 = 0 THEN 0.0::DOUBLE ELSE CAST(o_orderkey % 70 AS DOUBLE) / 10.0::DOUBLE END AS v4_score,
    CASE WHEN l_linestatus = 'F' THEN 'NPM' WHEN l_returnflag = 'N' THEN 'pip' ELSE 'npm' END AS eco,
    CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'part-' || l_partkey END AS pkg_name,
    '< ' || l_linenumber || '.0.0' AS vrange,
    CASE WHEN l_returnflag = 'A' THEN l_linenumber || '.0.1' END AS fixed,
    bool_or(l_returnflag = 'A') OVER (PARTITION BY o_orderkey) AS doc_has_fix
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

VIEWS["repo_meta_docs"] = """
repo_meta_docs AS (
  SELECT
    'https://github.com/org' || (p_partkey % 97) || '/part-' || p_partkey AS repo_url,
    CASE WHEN p_partkey % 23 = 0 THEN '{"errors": [{"message": "rate limited"}]}'
         ELSE '{"data": {"repository": {"isArchived": ' || CASE WHEN p_size % 10 = 0 THEN 'true' ELSE 'false' END
              || ', "defaultBranchRef": {"target": {"oid": "sha' || p_partkey || '"}}, "pullRequests": {"nodes": ['
              || CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '{"mergedAt": "' || strftime(last_ship, '%Y-%m-%dT%H:%M:%S') || 'Z"}' END
              || ']}}}}' END AS doc
  FROM (SELECT l_partkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_partkey) g
  JOIN part ON g.l_partkey = part.p_partkey
)"""

VIEWS["dependents_cache"] = """
dependents_cache AS (
  SELECT 'npm' AS system, 'part-' || user_id AS name, wk AS iso_week,
         coalesce(list(struct_pack(name := 'evt-' || event_id, purl := 'pkg:npm/evt-' || event_id,
                                   repo_url := CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://github.com/evt/evt-' || event_id END,
                                   lifetime_downloads := CAST(floor(value) AS BIGINT)) ORDER BY rn)
                  FILTER (WHERE event_type = 'purchase'), []) AS payload,
         max(ts) AS written_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, wk ORDER BY (event_type = 'purchase') DESC, value DESC, event_id) AS rn
        FROM (SELECT *, strftime(ts, '%G-W%V') AS wk FROM events))
  WHERE rn <= 5
  GROUP BY user_id, wk
)"""

# Dependencies between views (a view may read earlier ones).
DEPENDS: dict[str, list[str]] = {}


def with_views(names: list[str], body: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named bridge views (in dependency order), then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [VIEWS[n].strip() for n in order] + [e.strip() for e in (extra or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
