"""Same rows from fewer or narrower steps."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from ranktide.plans import marts as M
from ranktide.sources import bridge as B
from ranktide.sources import landing as LD
from ranktide.sources import versions as V


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    day = dt.datetime(1997, 5, 1)
    items = [  # part, supplier, number, flag, status
        (1, 7, 1, "A", "F"), (1, 7, 1, "R", "O"), (1, 8, 2, "S", "E"), (1, 8, 2, "R", "F"), (2, 7, 1, None, None), (2, 7, 1, "A", "F"),
        (3, 9, 1, None, None), (None, 9, 1, "A", "F"), (3, None, 2, "N", "O"),
    ]
    spark.createDataFrame(
        [(i, p, s, n, 1.0, 0.05, f, st, day) for i, (p, s, n, f, st) in enumerate(items)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, "SMALL", 5), (1, "LARGE", 5), (1, "ECONOMY", 5), (2, None, 5), (3, "SMALL", 6)], "p_partkey long, p_type string, p_size int"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, 1), (7, 1), (8, None), (9, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_advisories_are_aggregated_by_hash(spark, tables):
    adv = B.advisories(spark, tables)
    li, pa = B.read(spark, tables, "lineitem"), B.read(spark, tables, "part")
    want = li.groupBy("l_partkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("hi"), F.min("l_returnflag").alias("lo"), F.min("l_linestatus").alias("st")
    ).join(pa, F.col("l_partkey") == F.col("p_partkey"))
    want = sorted((f"ADV-{r.l_partkey}-{r.l_linenumber}", r.hi == "R", r.lo == "A", r.st == "F") for r in want.collect())
    got = sorted((r.id, r.cvss is None, len(r.fixed_versions) == 1, r.summary.startswith("Breaking")) for r in adv.collect())
    assert got == want and any(r[1] for r in got) and any(r[2] for r in got)
    assert "SortAggregate" not in _plan(adv)


def test_edges_are_made_distinct_as_keys(spark, tables):
    edges = B.sbom_edges(spark, tables)
    rows = [tuple(r) for r in edges.collect()]
    assert len(rows) == len(set(rows)) == 6
    assert {r[:3] + r[4:] for r in rows if r[1] == "part-1"} == {
        (s, "part-1", "GITHUB", n, u) for s in ("PYPI", "NPM") for n, u in (("nation1", "supp-7"), (None, "supp-8"))
    }
    # No exchange or aggregate has the spelled names.
    assert not [x for x in _plan(edges).splitlines() if ("Exchange" in x or "Aggregate" in x) and "package_artifact" in x]


def test_an_update_of_all_buckets_does_not_look_for_touched_rows(spark, tmp_path, monkeypatch):
    day = lambda d: dt.date(2024, 1, d)
    landed = spark.createDataFrame([(f"p{i}", "i", day(1 + i % 2)) for i in range(60)], "project_purl string, id string, ingest_date date")
    table, read = M.lifecycle_table(spark, str(tmp_path), 2), []
    M.update_lifecycle(table, landed, [day(1)])
    keep = V.BucketedTable._rows
    monkeypatch.setattr(V.BucketedTable, "_rows", lambda self, names, only=None: read.append(only) or keep(self, names, only))
    M.update_lifecycle(table, landed, [day(2)])
    assert len(read) == 1 and sorted(read[0]) == [0, 1]
    assert sorted(map(tuple, M.read_lifecycle(table).collect())) == sorted(map(tuple, M.agg_lifecycle(landed).collect()))


def test_parts_are_not_broadcast(spark, tables):
    """The driver would hold every part's hashed row; line items are brought together by part once, for the groups and the join."""
    for name, keys in (("advisories", 1), ("projects", 1)):
        if name == "projects":
            spark.createDataFrame([(1, 9.5), (1, 9.5), (2, None)], "p_partkey long, p_retailprice double").write.mode("overwrite").parquet(f"{tables}/part.parquet")
        got = getattr(B, name)(spark, tables)
        plan = _plan(got)
        assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(l_partkey") == keys, plan
        li, pa = B.read(spark, tables, "lineitem"), B.read(spark, tables, "part")
        group = [F.col("l_partkey"), F.col("l_linenumber") if name == "advisories" else F.year("l_shipdate")]
        want = li.groupBy(*group).count().join(pa, F.col("l_partkey") == F.col("p_partkey")).count()
        assert got.count() == want > 0


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {x for x in blocks.mkString("\n").split("\n") if x.startswith("shuffle_")}


def test_a_build_leaves_no_shuffle_files(spark, tables, tmp_path):
    before = _shuffle_files(spark)
    adv = B.advisories(spark, tables)
    LD.land_partitioned(adv, str(tmp_path / "land"), "advisories")
    models = {"staging.advisories": LD.read_landed(spark, str(tmp_path / "land"), "advisories"), "n": lambda m: m["staging.advisories"].groupBy("id").count()}
    _, written = V.write_audit_publish(V.Versions(spark, str(tmp_path / "models")), models, lambda m: m["n"].groupBy("count").count().collect())
    until = time.time() + 20  # executors are told, not waited for
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert written["n"].count() == adv.select("id").distinct().count() > 0


def test_advisories_are_spelled_where_they_are_written(spark, tables, tmp_path, monkeypatch):
    plans, keep = [], LD._write_by_date
    monkeypatch.setattr(LD, "_write_by_date", lambda df, *a: plans.append(_plan(df)) or keep(df, *a))
    LD.land_partitioned(B.advisories(spark, tables), str(tmp_path / "whole"), "advisories")
    LD.land_partitioned(B.advisory_keys(spark, tables), str(tmp_path / "keys"), "advisories", spell=B.advisory_columns())
    whole, keys = (LD.read_landed(spark, str(tmp_path / x), "advisories") for x in ("whole", "keys"))
    assert whole.schema == keys.schema and keys.count() > 0
    assert sorted(map(str, whole.collect())) == sorted(map(str, keys.collect()))
    spelled = [p.index("ADV-") < p.index("REBALANCE") for p in plans]
    assert spelled == [False, True] and "ADV-" not in plans[1][plans[1].index("REBALANCE"):]


def test_lifecycles_are_exchanged_once(spark):
    day = lambda d: dt.date(2024, 1, d) if d else None
    rows = [("p", "i", day(1)), ("p", "i", day(1)), ("p", "i", day(3)), ("p", None, day(2)), (None, "i", day(2)), ("q", "i", None), (None, None, day(4)), (None, None, day(5))]
    got = M.agg_lifecycle(spark.createDataFrame(rows, "project_purl string, id string, ingest_date date"))
    assert {tuple(r) for r in got.collect()} == {
        ("p", "i", day(1), day(3), 2), ("p", None, day(2), day(2), 1), (None, "i", day(2), day(2), 1), ("q", "i", None, None, 0), (None, None, day(4), day(5), 2),
    }
    assert _plan(got).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
