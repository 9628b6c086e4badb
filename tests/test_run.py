"""The run on landed tables: options, landing, and the registered query's selection."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ranktide.catalog import q_pipeline as QP
from ranktide.plans import run as R
from ranktide.sources import landing as LD
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The bridge's frames, written to files and read back."""
    root = tmp_path_factory.mktemp("landed")
    out = {}
    for name, df in vars(QP.landed(spark, SF_SMALL)).items():
        df.write.parquet(f"{root}/{name}")
        out[name] = spark.read.parquet(f"{root}/{name}")
    return R.Landed(**out)


def test_selection_and_landing(spark, landed, tmp_path):
    out = R.run(landed, QP.OPTIONS, land_root=str(tmp_path), ingest_date="2026-02-03")
    picked = {r["slug"] for r in out["selected"].collect()}
    assert picked == {r["slug"] for r in QP.pipe_briefs(spark, SF_SMALL).collect()} and len(picked) == QP.TOP_N
    edges = LD.read_landed(spark, str(tmp_path), "dependents")
    assert edges.count() == edges.select("parent_purl", "dependent_purl").distinct().count() > 0
    assert LD.read_landed(spark, str(tmp_path), "projects").count() == out["projects"].count()
    assert LD.read_landed(spark, str(tmp_path), "advisories").where("dt = DATE \'2026-02-03\'").count() == out["advisories"].count()
    assert LD.read_landed(spark, str(tmp_path), "replacements").count() == landed.replacements.count()


def test_options(landed):
    some = replace(QP.OPTIONS, include_replacements=False, top_n=7, min_weekly_downloads=0)
    out = R.run(landed, some)
    kinds = {k for r in out["briefs"].select("kinds").collect() for k in r["kinds"]}
    assert kinds == {"vulnerability-fix"} and out["selected"].count() == 7
    none = R.run(landed, replace(QP.OPTIONS, ecosystem="pypi", include_replacements=False))
    assert none["selected"].count() == 0
    more = R.candidates(landed, replace(QP.OPTIONS, fanout_top_n=None))
    assert more.count() > R.candidates(landed, replace(QP.OPTIONS, fanout_top_n=5)).count() > 0
    assert more.select(F.max("dep_rank")).first()[0] <= QP.OPTIONS.dependents


def test_another_ecosystem(spark, landed):
    """Documents of another ecosystem give its briefs, labelled so; npm's registry has no say in them."""
    package = F.transform("vulnerabilities", lambda v: v.withField("package", v["package"].withField("ecosystem", F.lit("PyPI"))))
    other = replace(landed, advisories=landed.advisories.withColumn("vulnerabilities", package))
    options = replace(QP.OPTIONS, ecosystem="pypi", include_replacements=False, min_weekly_downloads=0)
    out = R.run(other, options)
    found = out["advisories"]
    assert found.count() > 0 and found.where(~F.col("project_purl").startswith("pkg:pypi/")).count() == 0
    assert {r["ecosystem"] for r in out["projects"].select("ecosystem").distinct().collect()} == {"pypi"}
    assert out["selected"].count() == options.top_n
    assert R.run(other, replace(options, ecosystem="npm"))["selected"].count() == 0


def test_withdrawn_documents_take_their_place_on_the_page(spark, landed):
    from ranktide.sources import advisories as ADV

    docs = landed.advisories
    page = ADV.flatten(docs, per_page=5).select("id").distinct().count()
    gone = docs.withColumn("withdrawn_at", F.lit("2001-01-01T00:00:00Z"))
    assert ADV.flatten(gone, per_page=5).count() == 0
    assert ADV.flatten(docs.withColumn("withdrawn_at", F.lit(None).cast("string")), per_page=5).select("id").distinct().count() >= page
