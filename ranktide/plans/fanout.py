"""Replacement fan-out: dedupe -> top-N by downloads -> dependents -> verification -> locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.strings import canonical_repo, purl_name
from ranktide.operators.aggregates import dedupe_easiest
from ranktide.sources.lookups import join_downloads

# Fixed values (run defaults).
FANOUT_TOP_N = 40
DEPENDENTS_PER_REPLACEMENT = 5
FILTER_BUCKETS = 4096
# End of fixed values.


def top_fanout(replacements: DataFrame, downloads: DataFrame, n: int | None = FANOUT_TOP_N) -> DataFrame:
    """Deduped from-packages ranked by weekly downloads (unknown = 0), stable on first appearance.

    ``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task
    keeps its own top n and only those reach the final merge. ``None``: all, in no order.
    """
    d = dedupe_easiest(replacements)
    j = join_downloads(d, downloads, "from_purl")
    if n is None:
        return j
    return j.orderBy(F.coalesce(F.col("downloads_weekly"), F.lit(0)).desc(), F.col("first_seq").asc()).limit(n)


def join_fanout_dependents(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked replacement x its dependents (inner join on the short from-package name).

    AQE sees the sizes at run time and broadcasts a short ranking.
    """
    r = ranked.withColumn("__parent", purl_name("from_purl"))
    j = edges.join(r, edges.parent == r["__parent"])
    return j.select(
        F.col("from_purl"), F.col("id").alias("rep_id"), F.col("first_seq"), F.col("seq"),
        F.col("purl").alias("dep_purl"), F.col("name").alias("dep_name"), F.col("repo_url").alias("dep_repo_url"),
        F.col("lifetime_downloads").alias("dep_lifetime_downloads"),
        F.col("rank").alias("dep_rank"), F.col("tier"),
        *[F.col(c) for c in ("axis", "effort", "to_purls", "manifest", "manifest_line", "effort_score") if c in ranked.columns],
        *([F.col("downloads_weekly").alias("from_downloads")] if "downloads_weekly" in ranked.columns else []),
    )


# ---- verification of fan-out candidates -----------------------------------------------------

KEEP_CASES = ("no_repo", "unknown", "monorepo", "direct")


def flt_direct_dep_verdicts(fan: DataFrame, verdicts: DataFrame | None, names: DataFrame | None) -> DataFrame:
    """Attach the five-way case to every (replacement, dependent) candidate.

    no repo URL -> keep; unknown manifest -> keep; not a JS project -> drop;
    monorepo without lockfile -> keep; otherwise keep iff the from-package is a
    direct dependency (a join against the exploded direct-dependency table; ``names``
    None: ``verdicts`` has each repository's names as an array, as ``direct_deps`` gives them).
    ``verdicts is None`` means verification is disabled: every candidate is kept.
    """
    from_name = purl_name("from_purl")
    x = fan.withColumn("__from_name", from_name).withColumn("__repo", canonical_repo("dep_repo_url"))
    if verdicts is None:
        return x.withColumn("dep_case", F.lit("unverified")).withColumn("keep", F.lit(True)).drop("__from_name", "__repo")
    # A repository is known by its owner and name, however its URL is written.
    v = verdicts.select(F.col("repo_url").alias("__vu"), F.col("verdict"), *([] if names is not None else [F.col("names").alias("__names")]))
    j = x.join(v, x["__repo"] == v["__vu"], "left")
    if names is None:
        j = j.withColumn("__present", F.array_contains("__names", F.col("__from_name"))).drop("__names")
    else:
        n = names.select(F.col("repo_url").alias("__nu"), F.col("name").alias("__nn"), F.lit(True).alias("__present"))
        j = j.join(n, (j["__repo"] == n["__nu"]) & (j["__from_name"] == n["__nn"]), "left").drop("__nu", "__nn")
    case = (
        F.when(F.coalesce(F.col("dep_repo_url"), F.lit("")) == "", F.lit("no_repo"))
        .when(F.col("verdict").isNull() | (F.col("verdict") == "unknown"), F.lit("unknown"))
        .when(F.col("verdict") == "not_js", F.lit("not_js"))
        .when(F.col("verdict") == "monorepo", F.lit("monorepo"))
        .when(F.coalesce(F.col("__present"), F.lit(False)), F.lit("direct"))
        .otherwise(F.lit("transitive"))
    )
    return (
        j.withColumn("dep_case", case)
        .withColumn("keep", F.col("dep_case").isin(*KEEP_CASES))
        .drop("__vu", "__present", "verdict", "__from_name", "__repo")
    )


def flt_direct_dep(fan: DataFrame, verdicts: DataFrame | None, names: DataFrame | None) -> DataFrame:
    return flt_direct_dep_verdicts(fan, verdicts, names).where("keep")


def agg_filter_counters(cases: DataFrame) -> DataFrame:
    """kept / dropped / unknown / monorepo / not_js counters of the direct-dependency filter."""
    c = F.col("dep_case")
    return cases.agg(
        F.count_if(F.col("keep")).cast("bigint").alias("kept"),
        F.count_if(~F.col("keep")).cast("bigint").alias("dropped"),
        F.count_if(c.isin("no_repo", "unknown")).cast("bigint").alias("unknown"),
        F.count_if(c == "monorepo").cast("bigint").alias("monorepo"),
        F.count_if(c == "not_js").cast("bigint").alias("not_js"),
    )


def join_locations(cases: DataFrame, files: DataFrame) -> DataFrame:
    """(dep_purl, from_purl) -> declared locations, for candidates kept as direct dependencies."""
    from ranktide.sources.manifests import man_dep_locations

    direct = cases.where(F.col("dep_case") == "direct").select(
        "dep_purl", "from_purl", canonical_repo("dep_repo_url").alias("repo_url"), purl_name("from_purl").alias("name")
    )
    locs = man_dep_locations(direct.select("repo_url", "name").distinct(), files)
    return direct.join(locs, ["repo_url", "name"]).select("dep_purl", "from_purl", "locations")


def may_be_of(df: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` may be one of ``wanted``'s: a filter on hash buckets, to be followed by the exact semi-join.

    Unlike a semi-join, a filter goes below explodes and aggregates by that column. It is one
    scalar of at most ``FILTER_BUCKETS`` numbers, however many are wanted.
    """
    bucket = F.pmod(F.xxhash64(col), F.lit(FILTER_BUCKETS))
    found = wanted.agg(F.collect_set(bucket).alias("found")).scalar()
    return df.where(F.array_contains(found, bucket))


def pipe_fanout(fan: DataFrame, files: DataFrame | None, stage=lambda d: d) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame | None]:
    """Verified fan-out pairs, their locations (or None), the filter's cases and the candidates' files.

    ``stage`` materialises the candidate list and the candidates' repository
    files (pass ``session.cut_lineage``); both are small by construction.
    """
    fan = stage(fan)
    from ranktide.sources.manifests import by_repository, direct_deps

    if files is None:
        cases = flt_direct_dep_verdicts(fan, None, None)
        return cases.where("keep"), None, cases, None
    # Only the candidates' repositories are read; the staged candidate list has exact sizes, so AQE
    # broadcasts a short one at run time.
    repos = fan.where(F.col("dep_repo_url").isNotNull()).select(canonical_repo("dep_repo_url").alias("repo_url")).distinct()
    files = stage(may_be_of(by_repository(files), repos, "repo_url").join(repos, "repo_url", "left_semi"))
    cases = flt_direct_dep_verdicts(fan, direct_deps(files), None)
    return cases.where("keep"), join_locations(cases, files), cases, files
