"""Dependents sources (registry, SBOM join), tiered source choice and the weekly cache.

All sources return the same edge shape::

    parent STRING, name STRING, purl STRING, repo_url STRING, lifetime_downloads BIGINT, rank INT

Per-parent top-k uses ``row_number() <= k`` (partial ``WindowGroupLimit``
before the shuffle), so a hot parent never ships all of its edges to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranktide.operators.filters import NPM_NAME_PATTERN
from ranktide.operators.windows import top_k_per_group
from ranktide.session import cut_lineage
from ranktide.sources.versions import BucketedTable

EDGE_COLS = ["parent", "name", "purl", "repo_url", "lifetime_downloads", "rank"]

# Fixed values.
MIN_STARS = 10
DEFAULT_TOP_K = 5
TIER_CACHE, TIER_PRIMARY, TIER_FALLBACK = 0, 1, 2
# End of fixed values.

CACHE_COLUMNS = ["system", "name", "iso_week", "payload", "written_at"]
CACHE_DDL = (
    "system string, name string, iso_week string, "
    "payload array<struct<name:string,purl:string,repo_url:string,lifetime_downloads:bigint>>, written_at timestamp_ntz"
)


def _only(df: DataFrame, col: str, parents: DataFrame | None) -> DataFrame:
    """Restrict edges to the requested parents before any ranking.

    A plain semi-join: AQE broadcasts the request list from its runtime size
    (a few dozen names in the pipeline) and falls back to a shuffle join if a
    caller passes a large one.
    """
    if parents is None:
        return df
    p = parents.select(F.col("name").alias("__req")).distinct()
    return df.join(p, df[col] == p["__req"], "left_semi")


def src_dependents_registry(reg: DataFrame, k: int = DEFAULT_TOP_K, parents: DataFrame | None = None) -> DataFrame:
    """Registry dependents: top-k per package by lifetime downloads, of which nameless rows are dropped."""
    r = _only(reg, "package", parents)
    top = top_k_per_group(
        r, ["package"], [F.col("downloads").desc_nulls_last(), F.col("name").asc_nulls_first()], k, rank_col="rank"
    ).where(F.col("name").isNotNull() & (F.col("name") != ""))
    return top.select(
        F.col("package").alias("parent"),
        F.col("name"),
        F.concat(F.lit("pkg:npm/"), F.col("name")).alias("purl"),
        F.col("repository_url").alias("repo_url"),
        F.col("downloads").cast("bigint").alias("lifetime_downloads"),
        F.col("rank"),
    )


def src_dependents_sbom_join(sboms: DataFrame, repos: DataFrame, min_stars: int = MIN_STARS, k: int = DEFAULT_TOP_K,
                             parents: DataFrame | None = None) -> DataFrame:
    """SBOM edges joined to repository stars: npm packages used by GitHub repos.

    Written by the source as a LEFT JOIN, but the star filter makes it an inner
    join (Catalyst rewrites it). Invalid package names are never queried.
    Per package: stars desc, then owner/repo for a stable order, first k; of
    these, rows without an owner or a repo are dropped.
    """
    s = _only(sboms, "package_artifact_name", parents).where(
        (F.col("package_artifact_source") == "NPM")
        & (F.col("dependent_artifact_source") == "GITHUB")
        & F.col("package_artifact_name").rlike(NPM_NAME_PATTERN)
    )
    j = s.join(repos, s.dependent_artifact_id == repos.artifact_id, "left").where(F.col("star_count") >= min_stars)
    named = (F.coalesce(F.col("dependent_artifact_namespace"), F.lit("")) != "") & (
        F.coalesce(F.col("dependent_artifact_name"), F.lit("")) != ""
    )
    top = top_k_per_group(
        j,
        ["package_artifact_name"],
        [F.col("star_count").desc_nulls_last(), F.col("dependent_artifact_namespace").asc_nulls_first(),
         F.col("dependent_artifact_name").asc_nulls_first()],
        k,
        rank_col="rank",
    ).where(named)
    full = F.concat(F.col("dependent_artifact_namespace"), F.lit("/"), F.col("dependent_artifact_name"))
    return top.select(
        F.col("package_artifact_name").alias("parent"),
        full.alias("name"),
        F.concat(F.lit("pkg:github/"), full).alias("purl"),
        F.coalesce(F.col("artifact_url"), F.concat(F.lit("https://github.com/"), full)).alias("repo_url"),
        F.lit(None).cast("bigint").alias("lifetime_downloads"),
        F.col("rank"),
    )


def cache_lookup(cache: DataFrame, requests: DataFrame, week: str, system: str = "npm") -> DataFrame:
    """Requests (name) LEFT JOIN the cache on (system, name, week): hit iff a row exists.

    An empty cached list is a hit; only absence is a miss.
    """
    c = cache.where((F.col("system") == system) & (F.col("iso_week") == week)).select(
        F.col("name").alias("__cname"), F.col("payload"), F.col("written_at")
    )
    j = requests.join(c, requests["name"] == c["__cname"], "left")
    return j.withColumn("hit", F.col("__cname").isNotNull()).drop("__cname")


def cache_misses(cache: DataFrame, requests: DataFrame, week: str, system: str = "npm") -> DataFrame:
    """The requested names without a row of this week: all that the other tiers are asked for.

    Given to these as ``parents``, it keeps cached packages out of the SBOM join and of both rankings.
    """
    c = cache.where((F.col("system") == system) & (F.col("iso_week") == week)).select("name")
    return requests.select("name").distinct().join(c, "name", "left_anti")


def cache_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    """The cache as a table that persists, in buckets by (system, name)."""
    return BucketedTable(spark, path, CACHE_DDL, ["system", "name"], buckets)


def newest(rows: DataFrame) -> DataFrame:
    """One row a (system, name, iso_week): the newest ``written_at`` wins."""
    return top_k_per_group(rows, ["system", "name", "iso_week"], [F.col("written_at").desc()], 1)


def cache_upsert(table: BucketedTable, new_rows: DataFrame) -> int:
    """Insert-or-replace on (system, name, iso_week): newest ``written_at`` wins. The version that has them.

    Only buckets with a new row are read and written. Two writers may run at once;
    what one of them has published is merged into the other's.
    """
    new = cut_lineage(new_rows.select(*CACHE_COLUMNS))  # a writer that has to begin again doesn't fetch again
    return table.update(lambda rows: new.select("system", "name"), lambda rows: newest(rows.unionByName(new)))


def cached_edges(cache_hits: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Explode hit payloads into edges, cut to k (the cache may hold longer lists)."""
    x = cache_hits.where(F.col("hit")).select("name", F.posexplode("payload").alias("pos", "d")).where(F.col("pos") < k)
    return x.select(
        F.col("name").alias("parent"), F.col("d.name").alias("name"), F.col("d.purl").alias("purl"),
        F.col("d.repo_url").alias("repo_url"), F.col("d.lifetime_downloads").cast("bigint").alias("lifetime_downloads"),
        (F.col("pos") + 1).cast("int").alias("rank"),
    )


def join_tiered_source(requests: DataFrame, cache: DataFrame, primary: DataFrame, fallback: DataFrame, week: str, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Per requested package: cache hit, else primary if non-empty, else fallback.

    A tier is all-or-nothing. The other tiers need only hold the cache's misses
    (``cache_misses``). The tiers are read once and united; the best tier of a package is a minimum over its rows, at most k of each tier, to
    which a cache hit adds one that stands for an empty list.
    """
    req = requests.select("name").distinct()
    hits = cache_lookup(cache, req, week)
    c_edges = cached_edges(hits, k).withColumn("tier", F.lit(TIER_CACHE))
    p_edges = primary.join(req, primary.parent == req.name, "left_semi").withColumn("tier", F.lit(TIER_PRIMARY))
    f_edges = fallback.join(req, fallback.parent == req.name, "left_semi").withColumn("tier", F.lit(TIER_FALLBACK))
    hit = hits.where(F.col("hit")).select(F.col("name").alias("parent"), F.lit(TIER_CACHE).alias("tier"))
    rows = (
        c_edges.select(*EDGE_COLS, "tier").unionByName(p_edges.select(*EDGE_COLS, "tier"))
        .unionByName(f_edges.select(*EDGE_COLS, "tier")).unionByName(hit, allowMissingColumns=True)
    )
    best = F.min("tier").over(Window.partitionBy("parent"))
    return rows.withColumn("__best", best).where((F.col("tier") == F.col("__best")) & F.col("rank").isNotNull()).drop("__best")


def new_cache_rows(tiered: DataFrame, week: str, written_at, system: str = "npm") -> DataFrame:
    """Edges fetched live (primary / fallback) become cache rows; empty results never do.

    ``collect_list`` runs over at most k edges per parent (the tiers are already cut).
    """
    live = tiered.where(F.col("tier") != TIER_CACHE)
    g = live.groupBy("parent").agg(
        F.sort_array(F.collect_list(F.struct("rank", "name", "purl", "repo_url", "lifetime_downloads"))).alias("p")
    )
    return g.select(
        F.lit(system).alias("system"), F.col("parent").alias("name"), F.lit(week).alias("iso_week"),
        F.transform("p", lambda x: x.dropFields("rank")).alias("payload"),
        written_at.alias("written_at"),
    )
