"""Physical-plan properties that matter at scale (checked on the smallest tables)."""

import pytest

from ranktide.catalog.registry import load_all
from ranktide.sources import bridge as B
from ranktide.sources import landing as LD

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_row_windows_limit_before_shuffle(spark):
    plan = _plan(load_all()["mart_opportunities"].build(spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_k_dependents_limit_before_shuffle(spark):
    plan = _plan(load_all()["src_dependents_registry"].build(spark, SF))
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_fanout_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(load_all()["top_fanout"].build(spark, SF))


@pytest.mark.parametrize("key", ["mart_opportunities", "flt_outdated", "join_tiered_source", "man_dep_lines", "src_replacement_manifests"])
def test_no_python_workers(spark, key):
    plan = _plan(load_all()[key].build(spark, SF))
    assert "EvalPython" not in plan and "PythonUDF" not in plan and "FlatMapGroupsInPandas" not in plan


def test_staging_prunes_partitions_and_columns(spark):
    root = LD.scratch_root(spark, "plantest")
    LD.land_partitioned(B.transitions(spark, SF), root, "opportunity_transitions")
    df = LD.stage(spark, root, "opportunity_transitions", "2024-01-05", "2024-01-06").select("dedupe_key")
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(dt" in plan and ">= 2024-01-05" in plan
    assert "ReadSchema: struct<dedupe_key:string,ingest_date:date>" in plan
