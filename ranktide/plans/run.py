"""The whole ranking run on landed tables: advisories and fan-outs -> ranked, quota-balanced briefs.

``run`` takes the landed frames (however they were read), works through every
stage and returns the intermediates and the selection. With a landing root it
also lands what the run found: hydrated projects, filtered advisories,
replacements and the dependents' edges, one row per (parent, dependent).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.strings import purl_name
from ranktide.operators import filters as FL
from ranktide.operators import windows as W
from ranktide.plans import fanout as FO
from ranktide.plans import pipeline as P
from ranktide.session import DEFAULT_AS_OF, cut_lineage
from ranktide.sources import advisories as ADV
from ranktide.sources import dependents as D
from ranktide.sources import landing as LD
from ranktide.sources import lookups as L
from ranktide.sources import manifests as MF


@dataclass(frozen=True)
class Landed:
    """The landed frames of a run."""

    advisories: DataFrame  # nested documents with page_pos
    registry: DataFrame  # name, doc: package documents with their tags
    replacements: DataFrame  # id, from_purl, to_purls, axis, effort, manifest, manifest_line, seq
    downloads: DataFrame  # name, downloads_weekly
    dependents_cache: DataFrame  # system, name, iso_week, payload, written_at
    sbom_edges: DataFrame
    repositories: DataFrame
    registry_dependents: DataFrame
    repo_files: DataFrame  # owner, repo, path, status, text
    repo_meta: DataFrame  # repo_url, doc


@dataclass(frozen=True)
class Options:
    """Run arguments. ``fanout_top_n`` None: every replacement is fanned out."""

    week: str
    ecosystem: str = "npm"
    include_replacements: bool = True
    top_n: int = 20
    fanout_top_n: int | None = FO.FANOUT_TOP_N
    dependents: int = D.DEFAULT_TOP_K
    min_stars: int = D.MIN_STARS
    min_weekly_downloads: int = P.MIN_WEEKLY_DOWNLOADS
    as_of: str = DEFAULT_AS_OF


def candidates(landed: Landed, options: Options) -> DataFrame:
    """Ranked replacements x their tiered dependents, before verification."""
    ranked = FO.top_fanout(landed.replacements, landed.downloads, options.fanout_top_n)
    names = ranked.select(purl_name("from_purl").alias("name"))
    # What the cache lacks of the requested packages is applied to every other source before its ranking.
    missed = D.cache_misses(landed.dependents_cache, names, options.week)
    primary = D.src_dependents_sbom_join(landed.sbom_edges, landed.repositories, options.min_stars, options.dependents, parents=missed)
    fallback = D.src_dependents_registry(landed.registry_dependents, options.dependents, parents=missed)
    tiered = D.join_tiered_source(names, landed.dependents_cache, primary, fallback, options.week, options.dependents)
    return FO.join_fanout_dependents(ranked, tiered)


def filtered_advisories(landed: Landed, ecosystem: str = "npm") -> DataFrame:
    """Unpatched advisories of one ecosystem without a patched sibling; of npm's those whose range holds the latest
    version (the registry knows no other ecosystem's packages)."""
    flat = ADV.flt_sibling_patched(ADV.flatten(landed.advisories, ecosystem=ecosystem, only_unpatched=True))
    return FL.flt_outdated(flat, L.src_latest_version(landed.registry)) if ecosystem == "npm" else flat


def run(
    landed: Landed, options: Options, land_root: str | None = None, ingest_date: str | None = None,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> dict[str, DataFrame]:
    """Every intermediate by name, and ``selected``: the top ``top_n`` briefs under the axis quota.

    ``stage`` writes a frame below the shared checkpoint folder and reads it
    back; it is applied where a frame feeds several consumers.
    """
    landed = replace(landed, downloads=stage(landed.downloads))  # the fan-out's ranking and the projects read it
    advisories = stage(filtered_advisories(landed, options.ecosystem))
    fan, locations, _, files = FO.pipe_fanout(candidates(landed, options), landed.repo_files, stage)
    if not options.include_replacements:
        fan, locations = fan.where(F.lit(False)), locations.where(F.lit(False))
    fan, locations = stage(fan), stage(locations)
    out = P.rank_briefs(
        advisories, fan, landed.downloads, L.src_repo_meta(landed.repo_meta), options.as_of, options.min_weekly_downloads,
        bench=MF.man_bench_signal(files), locations=locations, stage=stage,
        ecosystem=options.ecosystem,
    )
    out |= {"advisories": advisories, "fan": fan, "locations": locations}
    out["selected"] = P.top_axis_quota(out["briefs"], options.top_n)
    if land_root is not None:
        land(out, landed, land_root, ingest_date or options.as_of[:10])
    return out


def land(found: dict[str, DataFrame], landed: Landed, root: str, ingest_date: str) -> None:
    """Land a run's projects, advisories, replacements and dependents as one snapshot date."""
    edges = W.win_dedupe_first(
        found["fan"].select(
            F.col("from_purl").alias("parent_purl"), F.col("dep_purl").alias("dependent_purl"),
            F.col("dep_name").alias("dependent_name"), F.col("dep_repo_url").alias("dependent_repo_url"),
            F.col("dep_lifetime_downloads").alias("dependent_lifetime_downloads"), "seq",
        ),
        ["parent_purl", "dependent_purl"], "seq",
    )
    frames = {"projects": found["projects"], "advisories": found["advisories"], "replacements": landed.replacements, "dependents": edges}
    for source, df in frames.items():
        missing = {c: F.lit(None).cast(t) for c, t in LD.SCHEMAS[source] if c not in df.columns}
        LD.land_snapshot(df.withColumns(missing) if missing else df, root, source, ingest_date)
