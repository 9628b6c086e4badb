"""Brief rendering (F13): frontmatter shape, benchmarks only when known, tags, citations, body."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ranktide.plans import briefs as BR

ADV_T = "struct<id:string,severity:string,cvss:double,summary:string,affected_versions:string,fixed_versions:array<string>,repo_url:string>"
REP_T = "struct<id:string,from_purl:string,to_purls:array<string>,axis:string,effort:string,manifest:string,manifest_line:bigint>"
LOC_T = "array<struct<file:string,line:int,url:string>>"
OPP_T = (f"struct<opp_rank:int,opp_id:string,kind:string,finding_id:string,dedupe_key:string,impact:double,effort:double,score:double,"
         f"advisory:{ADV_T},replacement:{REP_T},dependency_locations:{LOC_T},pr_title:string>")
SCHEMA = (f"project_purl string, name string, slug string, ecosystem string, repo_url string, downloads_weekly bigint, archived boolean, "
          f"has_benchmarks boolean, bench_signal string, last_pr_merged_at timestamp_ntz, score double, impact double, effort double, "
          f"opp_count int, kinds array<string>, top_kind string, opportunities array<{OPP_T}>")


def _brief(spark, has_bench):
    adv = ("GHSA-1", "high", 8.7, "Proto", "< 1.0", [], "https://github.com/o/r")
    rep = ("e18e:native.json:x", "pkg:npm/x", ["pkg:npm/<native>"], "bloat", "drop-in", "native.json", 7)
    locs = [("package.json", 4, "https://github.com/o/r/blob/HEAD/package.json#L4"), ("package.json", 4, "https://other")]
    opps = [
        (1, "u1", "vulnerability-fix", "GHSA-1", "k1", 47.1, 20.0, 48.3, adv, None, [], "fix: address GHSA-1 in r"),
        (2, "u2", "dep-replacement", rep[0], "k2", 10.0, 95.0, 40.0, None, rep, locs, "deps: drop x dep (use native API)"),
        (3, "u3", "vulnerability-fix", "GHSA-1", "k3", 1.0, 20.0, 10.0, adv, None, [], "fix: address GHSA-1 in r"),
    ]
    row = ("pkg:npm/r", "r", "r", "npm", "https://github.com/o/r", 1531453, False, has_bench, "script:bench" if has_bench else None,
           dt.datetime(2001, 11, 4), 48.25, 47.1, 20.0, 3, ["dep-replacement", "vulnerability-fix"], "vulnerability-fix", opps)
    return spark.createDataFrame([row], SCHEMA)


def test_frontmatter_shape_and_benchmarks(spark):
    unknown = json.loads(_brief(spark, None).select(BR.brief_frontmatter(_brief(spark, None)).alias("f")).first().f)
    assert "benchmarks" not in unknown
    assert unknown["schema"] == "ranktide-brief/1" and unknown["slug"] == "r" and unknown["date"] == "2001-11-10"
    assert unknown["score"]["total"] == 48.2 and unknown["score"]["confidence"] == 100
    assert unknown["maintainer_activity"]["label"] == "last PR merged 6d ago"
    assert unknown["opportunities"] == {"count": 3, "kinds": ["dep-replacement", "vulnerability-fix"], "top_kind": "vulnerability-fix"}
    assert unknown["tags"] == ["bloat", "npm", "unpatched", "vuln"]
    known = json.loads(_brief(spark, True).select(BR.brief_frontmatter(_brief(spark, True)).alias("f")).first().f)
    assert known["benchmarks"] == {"has": True, "signal": "script:bench"} and "bench" in known["tags"]


def test_citations_first_wins(spark):
    b = _brief(spark, None)
    cits = b.select(BR.agg_citations().alias("c")).first().c
    assert [(c.type, c.id) for c in cits] == [
        ("advisory", "GHSA-1"), ("e18e-replacement", "native.json#x"), ("dependency-location", "package.json#L4"),
    ]
    assert cits[2].url.endswith("package.json#L4") and cits[1].url.endswith("native.json#L7")


def test_body_mentions_locations_and_titles(spark):
    b = _brief(spark, None)
    body = b.select(BR.brief_body().alias("b")).first().b
    assert body.startswith("# r — 2001-11-10 Improvement Brief\n\n**Repo**: [github.com/o/r](https://github.com/o/r)")
    assert "### 2. [dep-replacement] x → <native>" in body
    assert "- **Found in**: [package.json#L4](https://github.com/o/r/blob/HEAD/package.json#L4)" in body
    assert "_no upstream patch — contribute one_ at [https://github.com/o/r](https://github.com/o/r)" in body
    assert "- **Suggested PR**: `deps: drop x dep (use native API)`" in body


def test_many_citations_in_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from ranktide.operators.folds import first_of_each

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(
        F.lit("dependency-location").alias("type"), F.concat(F.lit("f"), (i % 15_000).cast("string")).alias("id"), i.cast("string").alias("url"))).alias("c"))
    begin = time.monotonic()
    (row,) = df.select(first_of_each(F.col("c"), "type", "id").alias("c")).collect()
    assert [x["id"] for x in row["c"]] == [f"f{i}" for i in range(15_000)] and time.monotonic() - begin < 20
