"""Rules that only show on untidy input: URL spellings, odd manifests, blank rows, emptied dates, bad marts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ranktide.operators import audits as A
from ranktide.operators import lines as LN
from ranktide.plans import fanout as FO
from ranktide.plans import triage as TR
from ranktide.sources import dependents as D
from ranktide.sources import landing as LD
from ranktide.sources import lookups as L
from ranktide.sources import manifests as MF
from ranktide.streaming.incremental import run_incremental

FILES = "owner string, repo string, repo_url string, path string, status int, text string"


def files(spark, text, repo="ok"):
    return spark.createDataFrame([("o", repo, f"https://github.com/o/{repo}", "package.json", 200, text)], FILES)


@pytest.mark.parametrize("url", ["https://github.com/o/ok", "https://github.com/o/ok.git", "https://github.com/o/ok/", "http://github.com/o/ok.git/"])
def test_repository_whatever_its_url(spark, url):
    fan = spark.createDataFrame([("pkg:npm/a", url), ("pkg:npm/b", url)], "from_purl string, dep_repo_url string")
    fan = fan.withColumn("dep_purl", F.lit("pkg:npm/x"))
    kept, locations, cases, _ = FO.pipe_fanout(fan, files(spark, '{\n  "dependencies": {\n    "a": "1"\n  }\n}'))
    assert {(r["from_purl"], r["dep_case"]) for r in cases.collect()} == {("pkg:npm/a", "direct"), ("pkg:npm/b", "transitive")}
    assert [r["from_purl"] for r in kept.collect()] == ["pkg:npm/a"]
    assert [(x["file"], x["line"]) for r in locations.collect() for x in r["locations"]] == [("package.json", 3)]


@pytest.mark.parametrize(
    "text,verdict,names",
    [
        ('\n {"dependencies": {"a": "1"}}', "set", {"a"}),
        ('\t\r\n{"dependencies": [], "devDependencies": {"b": "1"}}', "set", {"b"}),
        ('{"dependencies": "x"}', "set", set()),
        ("[1]", "unknown", set()),
        ("{", "unknown", set()),
        ("", "unknown", set()),
    ],
)
def test_manifest_sections_are_read_one_by_one(spark, text, verdict, names):
    verdicts, found = MF.man_direct_deps(files(spark, text))
    assert [r["verdict"] for r in verdicts.collect()] == [verdict]
    assert {r["name"] for r in found.collect()} == names


def test_header_lines_are_no_dependencies(spark):
    text = '{\n  "dependencies": {},\n  "devDependencies": {\n    "a": "1"\n  }\n}'
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    assert "devDependencies" not in {r["name"] for r in LN.man_dep_lines(docs, ["k"]).collect()}


def test_one_row_a_repository(spark):
    rows = [("https://github.com/o/r", "o", "r", True, None, "s1", True), ("https://github.com/o/r.git", "o", "r", False, None, "s2", True)]
    meta = spark.createDataFrame(rows, "repo_url string, owner string, repo string, is_archived boolean, last_merged_pr_at timestamp_ntz, head_sha string, known boolean")
    df = spark.createDataFrame([("p", "https://github.com/o/r/")], "purl string, repo_url string")
    assert [r["meta_head_sha"] for r in L.join_repo_meta(df, meta).collect()] == ["s1"]


def test_rank_first_then_drop(spark):
    reg = spark.createDataFrame([("p", None, 9, None), ("p", "a", 8, None), ("p", "", 7, None), ("p", "b", 6, None)], "package string, name string, downloads long, repository_url string")
    assert [r["name"] for r in D.src_dependents_registry(reg, 3).collect()] == ["a"]
    sboms = spark.createDataFrame([("NPM", "p", "GITHUB", i, o, f"n{i}") for i, o in enumerate(["", "o", "o"])],
                                  "package_artifact_source string, package_artifact_name string, dependent_artifact_source string, dependent_artifact_id int, dependent_artifact_namespace string, dependent_artifact_name string")
    repos = spark.createDataFrame([(0, 99, None), (1, 50, None), (2, 20, None)], "artifact_id int, star_count long, artifact_url string")
    assert [r["name"] for r in D.src_dependents_sbom_join(sboms, repos, 10, 2).collect()] == ["o/n1"]


def test_shown_scores_are_the_published_ones(spark):
    row = [("s", "npm", 28.25, 28.35, 95.0, 1, "vulnerability-fix", None, None, False, ["npm"], None)]
    df = spark.createDataFrame(row, "slug string, ecosystem string, score double, impact double, effort double, opp_count int, top_kind string, "
                                    "last_pr_merged_at timestamp_ntz, has_benchmarks boolean, archived boolean, tags array<string>, repo_url string")
    r = TR.prj_triage_row(df).first()
    assert (r["score"], r["effort"]) == (28.2, 95.0)


def test_an_emptied_date_leaves_staging(spark, tmp_path):
    root, staging = str(tmp_path / "landed"), str(tmp_path / "staging")
    rows = [("k1", "new", dt.datetime(2024, 1, 1), "a", None, dt.date(2024, 1, 1)), ("k2", "new", dt.datetime(2024, 1, 2), "a", None, dt.date(2024, 1, 2))]
    fields = ", ".join(f"{c} {t}" for c, t in LD.SCHEMAS["opportunity_transitions"])
    df = spark.createDataFrame(rows, fields)
    LD.land_partitioned(df, root, "opportunity_transitions")
    run = lambda: run_incremental(spark, root, "opportunity_transitions", staging, str(tmp_path / "ckpt"), "2000-01-01", "2100-01-01")
    run()
    LD.land_snapshot(df.where("false"), root, "opportunity_transitions", "2024-01-02")
    run()
    got = spark.read.schema(LD.struct_type("opportunity_transitions", with_dt=True)).parquet(staging)
    assert [r["dedupe_key"] for r in got.collect()] == ["k1"]


def test_a_bad_mart_is_blocked(spark):
    projects = spark.createDataFrame([("p", "npm", "n", True, dt.date(2024, 1, 1))], "purl string, ecosystem string, name string, archived boolean, ingest_date date")
    fields = "id string, kind string, project_purl string, dedupe_key string, score double"
    good = spark.createDataFrame([("i", "k", "q", "q|i", 0.5)], fields)
    models = lambda mart: {"marts.opportunities": mart, "staging.projects": projects}
    assert all(n == 0 for *_, n in A.assert_audits(A.model_audits(models(good)), models(good)))
    for bad in [("i", "k", "q", "q|i", 1.5), ("i", None, "q", "q|i", 0.5), ("i", "k", "p", "p|i", 0.5)]:
        with pytest.raises(AssertionError):
            A.block(models(spark.createDataFrame([bad], fields)))
