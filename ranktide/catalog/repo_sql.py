"""Oracle CTEs for the repository files bridge: expected facts per order repo, by rule.

Used by the manifest, fan-out and pipeline oracles. Nothing here parses text:
the repository files are laid out by rule from the line items, so every
expected line number, verdict and signal follows from the same columns.
"""

from __future__ import annotations

def same_repo(url: str) -> str:
    """A repository URL without ``.git`` and slash at its end."""
    return f"regexp_replace({url}, '(\\.git)?/?$', '')"


REPO_CTES = """
oi AS (
  SELECT l_orderkey AS o, l_partkey AS pk, l_linenumber AS ln, l_suppkey AS sk, l_returnflag AS fl,
         l_returnflag <> 'R' AS listed, l_linenumber % 2 = 1 AS rt
  FROM lineitem
),
oik AS (SELECT *, row_number() OVER (PARTITION BY o, rt ORDER BY ln, pk, sk, fl) AS k FROM oi WHERE listed),
ord AS (
  SELECT o, count(*) FILTER (WHERE listed AND rt) AS n_r, count(*) FILTER (WHERE listed AND NOT rt) AS n_d,
         count(*) FILTER (WHERE listed) AS n_listed
  FROM oi GROUP BY o
),
rexp AS (
  SELECT o, 'https://github.com/cust/order-' || o AS repo_url, n_r, n_d, n_listed,
         (o % 17 <> 0 AND o % 19 <> 0 AND o % 23 <> 0 AND o % 29 <> 0) AS ok,
         (o % 13 = 0) AS mono, (o % 13 = 0 AND o % 26 <> 0) AS has_lock, o % 5 <> 0 AS lock_ok, (o // 26) % 4 AS style,
         3 + CASE WHEN o % 2 = 0 THEN 3 ELSE 0 END + (o % 3) + 4 + CASE WHEN o % 13 = 0 THEN 1 ELSE 0 END
           + CASE WHEN o % 31 = 0 THEN 1 ELSE 0 END AS l0,
         CASE WHEN (o % 13 = 0 AND o % 26 <> 0) OR (o % 17 = 0 AND o % 2 = 0) THEN TRUE
              WHEN o % 17 = 0 AND o % 3 = 0 THEN NULL ELSE FALSE END AS has_root_lockfile
  FROM ord
),
rverd AS (
  SELECT *, CASE WHEN o % 17 = 0 THEN CASE WHEN has_root_lockfile = FALSE THEN 'not_js' ELSE 'unknown' END
                 WHEN NOT ok THEN 'unknown'
                 WHEN mono THEN CASE WHEN has_lock AND lock_ok AND n_listed > 0 THEN 'set' ELSE 'monorepo' END
                 ELSE 'set' END AS verdict
  FROM rexp
),
dnames AS (
  SELECT DISTINCT r.repo_url, 'part-' || i.pk AS name FROM rverd r JOIN oi i ON i.o = r.o WHERE r.verdict = 'set' AND i.listed
  UNION
  SELECT repo_url, 'tinybench' FROM rverd WHERE verdict = 'set' AND NOT mono AND o % 11 = 0
),
deplines AS (
  SELECT repo_url, name, CAST(min(line) AS INTEGER) AS line FROM (
    SELECT r.repo_url, 'part-' || k.pk AS name,
           CASE WHEN k.rt THEN r.l0 + 1 + k.k ELSE r.l0 + greatest(r.n_r, 1) + 3 + k.k END AS line
    FROM rexp r JOIN oik k ON k.o = r.o WHERE r.ok
    UNION ALL
    SELECT repo_url, 'tinybench', l0 + greatest(n_r, 1) + 3 + n_d + 1 FROM rexp WHERE ok AND o % 11 = 0)
  GROUP BY repo_url, name
),
lockrows AS (
  SELECT r.repo_url, CASE WHEN k.rt THEN '.' ELSE 'packages/app' END AS workspace,
         CASE WHEN k.rt THEN 'dependencies' ELSE 'devDependencies' END AS section, 'part-' || k.pk AS dep,
         CASE WHEN r.style = 3 THEN CASE WHEN k.rt THEN 5 ELSE 6 END
              WHEN k.rt THEN 7 + r.per * (k.k - 1) ELSE 9 + greatest(r.per * r.n_r, 1) + r.per * (k.k - 1) END AS line_no
  FROM (SELECT *, CASE WHEN style = 2 THEN 1 ELSE 3 END AS per FROM rexp) r JOIN oik k ON k.o = r.o WHERE r.has_lock AND r.lock_ok
)"""

REPO_BENCH_CTE = """
rbench AS (
  SELECT repo_url, sig IS NOT NULL AS has, sig FROM (
    SELECT repo_url, CASE WHEN NOT ok THEN NULL WHEN o % 5 = 0 THEN 'script:bench:run'
                          WHEN o % 7 = 1 THEN 'script-cmd:test:perf' WHEN o % 11 = 0 THEN 'devDep:tinybench' END AS sig
    FROM rexp)
)"""

_LOC_SQL = """
SELECT repo_url, name, string_agg(loc, ';' ORDER BY pos) AS locations FROM (
  SELECT d.repo_url, d.name, 'package.json#L' || l.line AS loc, l.line AS pos
  FROM dnames d JOIN rverd r ON r.repo_url = d.repo_url AND NOT r.mono JOIN deplines l ON l.repo_url = d.repo_url AND l.name = d.name
  UNION ALL
  SELECT d.repo_url, d.name, f AS loc, pos FROM (
    SELECT repo_url, dep AS name, CASE WHEN workspace IN ('', '.') THEN 'package.json' ELSE workspace || '/package.json' END AS f,
           min(line_no) AS pos
    FROM lockrows GROUP BY 1, 2, 3) x
  JOIN dnames d ON d.repo_url = x.repo_url AND d.name = x.name
  JOIN rverd r ON r.repo_url = d.repo_url AND r.mono)
GROUP BY repo_url, name"""

LOC_CTE = f"""
rlocs AS ({_LOC_SQL})"""
