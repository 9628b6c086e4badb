"""Brief documents: tags, citations, frontmatter (JSON, a YAML subset) and Markdown body.

Everything is a per-row expression over the brief's bounded ``opportunities``
array (at most ``MAX_OPPS_PER_PROJECT`` entries), so rendering needs no
shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.functions import scoring as S
from ranktide.functions.dates import activity_label
from ranktide.functions.rounding import round_one_place
from ranktide.functions.strings import ADVISORY_URL_BASE, MANIFEST_BLOB_BASE, NPM_PREFIX
from ranktide.functions.util import as_col, ts_ntz
from ranktide.operators.folds import first_of_each
from ranktide.session import DEFAULT_AS_OF

# Fixed values.
FRONTMATTER_SCHEMA = "ranktide-brief/1"
# End of fixed values.

CIT_T = "struct<type:string,id:string,url:string>"


def agg_tags(brief: DataFrame) -> Column:
    """Sorted tag set: ecosystem, vuln / perf / bloat by kind, bench, unpatched, archived."""
    kinds = F.col("opportunities.kind")
    unpatched = F.exists("opportunities", lambda o: o["advisory"].isNotNull() & (F.coalesce(F.size(o["advisory"]["fixed_versions"]), F.lit(0)) <= 0))
    cand = F.array(
        F.col("ecosystem"),
        F.when(F.array_contains(kinds, "vulnerability-fix"), F.lit("vuln")),
        F.when(F.array_contains(kinds, "perf-replacement"), F.lit("perf")),
        F.when(F.array_contains(kinds, "dep-replacement"), F.lit("bloat")),
        F.when(F.coalesce(F.col("has_benchmarks"), F.lit(False)), F.lit("bench")),
        F.when(unpatched, F.lit("unpatched")),
        F.when(F.coalesce(F.col("archived"), F.lit(False)), F.lit("archived")),
    )
    return F.array_sort(F.array_distinct(F.filter(cand, lambda x: x.isNotNull())))


def citation_url(manifest: Column, line: Column) -> Column:
    base = F.concat(F.lit(MANIFEST_BLOB_BASE), manifest)
    return F.when(line.isNotNull(), F.concat(base, F.lit("#L"), line.cast("string"))).otherwise(base)


def _opp_citations(o: Column) -> Column:
    adv = o["advisory"]
    rep = o["replacement"]
    a = F.when(
        adv.isNotNull(),
        F.array(F.struct(F.lit("advisory").alias("type"), adv["id"].alias("id"), F.concat(F.lit(ADVISORY_URL_BASE), adv["id"]).alias("url"))),
    ).otherwise(F.array().cast(f"array<{CIT_T}>"))
    from_name = F.regexp_replace(rep["from_purl"], "^" + NPM_PREFIX, "")
    r = F.when(
        rep.isNotNull() & rep["manifest"].isNotNull(),
        F.array(F.struct(
            F.lit("e18e-replacement").alias("type"),
            F.concat(rep["manifest"], F.lit("#"), from_name).alias("id"),
            citation_url(rep["manifest"], rep["manifest_line"]).alias("url"),
        )),
    ).otherwise(F.array().cast(f"array<{CIT_T}>"))
    locs = F.transform(
        F.coalesce(o["dependency_locations"], F.array().cast("array<struct<file:string,line:int,url:string>>")),
        lambda l: F.struct(
            F.lit("dependency-location").alias("type"),
            F.concat(l["file"], F.when(l["line"].isNotNull(), F.concat(F.lit("#L"), l["line"].cast("string"))).otherwise(F.lit(""))).alias("id"),
            l["url"].alias("url"),
        ),
    )
    # A replacement without a manifest also skips its locations.
    skip_locs = rep.isNotNull() & rep["manifest"].isNull()
    return F.concat(a, r, F.when(skip_locs, F.array().cast(f"array<{CIT_T}>")).otherwise(locs))


def agg_citations(opportunities="opportunities") -> Column:
    """Ordered, first-wins de-duplicated citation list by (type, id).

    Built inside the row: flatten per-opportunity citations, then keep the first
    of each (type, id), in order.
    """
    return first_of_each(F.flatten(F.transform(as_col(opportunities), _opp_citations)), "type", "id")


def _iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def brief_frontmatter(briefs: DataFrame, as_of: str = DEFAULT_AS_OF) -> Column:
    """Nested metadata as JSON text (valid YAML). ``benchmarks`` omitted when unknown."""
    now = ts_ntz(as_of)
    conf = S.confidence("last_pr_merged_at", now)
    head = [
        F.lit(FRONTMATTER_SCHEMA).alias("schema"),
        F.col("name").alias("title"),
        F.col("slug"),
        F.date_format(now, "yyyy-MM-dd").alias("date"),
        _iso_utc(now).alias("run_at"),
        F.struct(
            F.col("project_purl").alias("purl"), "name", "ecosystem", "repo_url", "downloads_weekly",
            F.coalesce(F.col("archived"), F.lit(False)).alias("archived"),
        ).alias("project"),
        F.struct(
            round_one_place("score").alias("total"), round_one_place("impact").alias("impact"), round_one_place("effort").alias("effort"),
            F.bround(conf, 0).cast("int").alias("confidence"),
        ).alias("score"),
        F.struct(
            activity_label("last_pr_merged_at", now).alias("label"),
            F.when(F.col("last_pr_merged_at").isNotNull(), _iso_utc(F.col("last_pr_merged_at"))).alias("last_pr_merged_at"),
        ).alias("maintainer_activity"),
    ]
    tail = [
        F.struct(F.col("opp_count").alias("count"), F.col("kinds"), F.col("top_kind")).alias("opportunities"),
        agg_tags(briefs).alias("tags"),
        agg_citations().alias("citations"),
    ]
    bench = F.struct(F.col("has_benchmarks").alias("has"), F.col("bench_signal").alias("signal")).alias("benchmarks")
    opts = {"ignoreNullFields": "false"}
    return F.when(
        F.col("has_benchmarks").isNull(), F.to_json(F.struct(*head, *tail), opts)
    ).otherwise(F.to_json(F.struct(*head, bench, *tail), opts))


def _fmt0(x: Column) -> Column:
    return F.format_string("%.0f", x)


def _opp_md(o: Column, i: Column) -> Column:
    adv, rep = o["advisory"], o["replacement"]
    rep_title = F.concat(
        F.substring_index(rep["from_purl"], "/", -1), F.lit(" → "),
        F.regexp_replace(F.array_join(rep["to_purls"], ", "), NPM_PREFIX, ""),
    )
    title = F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". ["), o["kind"], F.lit("] "),
                     F.when(adv.isNotNull(), adv["id"]).otherwise(rep_title), F.lit("\n\n"))
    fix = F.when(
        F.size(adv["fixed_versions"]) > 0, F.concat(F.lit("bump to `"), F.get(adv["fixed_versions"], 0), F.lit("`"))
    ).otherwise(F.concat(
        F.lit("_no upstream patch — contribute one_"),
        F.when(F.coalesce(adv["repo_url"], F.lit("")) != "", F.concat(F.lit(" at ["), adv["repo_url"], F.lit("]("), adv["repo_url"], F.lit(")"))).otherwise(F.lit("")),
    ))
    adv_md = F.when(adv.isNotNull(), F.concat(
        F.lit("- **Severity**: "), F.coalesce(F.nullif(adv["severity"], F.lit("")), F.lit("unknown")),
        F.when(F.coalesce(adv["cvss"], F.lit(0.0)) != 0, F.concat(F.lit(" · CVSS "), adv["cvss"].cast("string"))).otherwise(F.lit("")),
        F.lit("\n- **Summary**: "), F.coalesce(adv["summary"], F.lit("")),
        F.lit("\n- **Affected**: `"), F.coalesce(F.nullif(adv["affected_versions"], F.lit("")), F.lit("see advisory")),
        F.lit("`\n- **Fix**: "), fix,
        F.lit("\n- **Evidence**: ["), adv["id"], F.lit("]("), F.lit(ADVISORY_URL_BASE), adv["id"], F.lit(")\n"),
    )).otherwise(F.lit(""))
    targets = F.array_join(F.transform(rep["to_purls"], lambda t: F.concat(F.lit("`"), F.regexp_replace(t, NPM_PREFIX, ""), F.lit("`"))), ", ")
    locs = F.array_join(F.transform(o["dependency_locations"], lambda l: F.concat(
        F.lit("["), l["file"], F.when(l["line"].isNotNull(), F.concat(F.lit("#L"), l["line"].cast("string"))).otherwise(F.lit("")),
        F.lit("]("), l["url"], F.lit(")"))), ", ")
    rep_md = F.when(rep.isNotNull(), F.concat(
        F.lit("- **Axis**: "), rep["axis"],
        F.lit("\n- **Replace**: `"), F.regexp_replace(rep["from_purl"], NPM_PREFIX, ""), F.lit("` → "), targets,
        F.lit("\n- **Effort band**: "), rep["effort"],
        F.lit("\n- **Evidence**: e18e [module-replacements](https://github.com/e18e/module-replacements) · manifest ["),
        F.coalesce(rep["manifest"], F.lit("")),
        F.when(rep["manifest_line"].isNotNull(), F.concat(F.lit("#L"), rep["manifest_line"].cast("string"))).otherwise(F.lit("")),
        F.lit("]("), F.coalesce(citation_url(rep["manifest"], rep["manifest_line"]), F.lit(MANIFEST_BLOB_BASE)), F.lit(")\n"),
        F.when(F.size(o["dependency_locations"]) > 0, F.concat(F.lit("- **Found in**: "), locs, F.lit("\n"))).otherwise(F.lit("")),
    )).otherwise(F.lit(""))
    tail = F.concat(
        F.lit("- **Effort score**: "), _fmt0(o["effort"]), F.lit(" / 100 (high = easy)\n"),
        F.lit("- **Impact score**: "), _fmt0(o["impact"]), F.lit(" / 100\n"),
        F.lit("- **Suggested PR**: `"), o["pr_title"], F.lit("`\n\n"),
    )
    return F.concat(title, adv_md, rep_md, tail)


def brief_body(as_of: str = DEFAULT_AS_OF) -> Column:
    """Markdown body assembled from the ordered opportunities array."""
    now = ts_ntz(as_of)
    repo = F.col("repo_url")
    header = F.concat(
        F.lit("# "), F.col("name"), F.lit(" — "), F.date_format(now, "yyyy-MM-dd"), F.lit(" Improvement Brief\n\n"),
        F.when(F.coalesce(repo, F.lit("")) != "", F.concat(
            F.lit("**Repo**: ["), F.regexp_replace(repo, "^https?://", ""), F.lit("]("), repo, F.lit(")\n\n"),
        )).otherwise(F.lit("")),
        F.lit("## Top opportunities\n\n"),
    )
    return F.concat(header, F.array_join(F.transform("opportunities", _opp_md), ""))


def render(briefs: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """briefs -> (ecosystem, slug, frontmatter, body, document)."""
    fm = brief_frontmatter(briefs, as_of)
    return briefs.select(
        "ecosystem", "slug", "project_purl", "score",
        fm.alias("frontmatter"), brief_body(as_of).alias("body"),
    ).withColumn("document", F.concat(F.lit("---\n"), F.col("frontmatter"), F.lit("\n---\n\n"), F.col("body")))
