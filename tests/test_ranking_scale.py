"""What keeps the ranking's cost in proportion: rows that no one asks for aren't built, a frame read twice is built once."""

import re
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from ranktide.catalog import q_pipeline as QP
from ranktide.plans import fanout as FO
from ranktide.plans import run as R
from ranktide.session import cut_lineage
from ranktide.sources import bridge as B
from tests.conftest import SF_SMALL

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string"


def test_wanted_rows_are_found_below_the_aggregate(spark):
    rows = spark.range(4000).select(F.concat(F.lit("repo-"), F.col("id") % 1000).alias("repo"), "id")
    files = rows.groupBy("repo").agg(F.collect_list("id").alias("ids")).select("repo", F.explode("ids").alias("id"))
    wanted = spark.createDataFrame([("repo-7",), ("repo-900",), ("other",)], "repo string")
    some = FO.may_be_of(files, wanted, "repo")
    assert some.join(wanted, "repo", "left_semi").count() == 8
    assert some.count() < 200
    assert FO.may_be_of(files, wanted.where("repo = 'none'"), "repo").count() == 0
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_contains") > plan.index("Aggregate")


def test_a_run_builds_its_downloads_once_and_few_repositories_files(spark):
    staged = []

    def stage(df):
        staged.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut_lineage(df)

    R.run(QP.landed(spark, SF_SMALL), replace(QP.OPTIONS, top_n=3), stage=stage)
    assert sum(bool(re.search(r"year\([^)]*l_shipdate", plan)) for _, plan in staged) == 1
    (files,) = [plan for columns, plan in staged if "path" in columns]
    assert "array_contains" in files[files.index("collect_list"):]


def test_nested_advisories_repeated_and_null_rows(spark, tmp_path):
    line = lambda o, p, n, flag="N", status="O", s=1: (o, p, s, n, flag, status)
    lines = [line(1, 30, 2), line(1, 20, 1, "A"), line(1, 20, 1), line(1, 10, 1, "R", "F", 17), line(1, None, None, None, None, None),
             line(2, 5, 1), line(None, 6, 1), line(3, 7, 1)]
    day = datetime(2000, 1, 2)
    orders = [(1, day, "1-URGENT")] * 2 + [(1, None, None), (2, day, "5-LOW"), (None, day, "2-HIGH")]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["ghsa_id"], r["severity"]): [(v["package"]["ecosystem"], v["package"]["name"], v["vulnerable_version_range"], v["first_patched_version"])
                                           for v in r["vulnerabilities"]] for r in B.nested_advisories(spark, str(tmp_path)).collect()}
    one = [("npm", None, None, None), ("NPM", "", "< 1.0.0", None), ("npm", "part-20", "< 1.0.0", "1.0.1"), ("pip", "part-20", "< 1.0.0", None),
           ("pip", "part-30", "< 2.0.0", None)]
    assert got == {("GHSA-1", "critical"): [v for v in one for _ in range(2)], ("GHSA-1", "low"): one, ("GHSA-2", "low"): [("pip", "part-5", "< 1.0.0", None)]}
