"""Interval-incremental staging: an availableNow stream re-stages only re-landed (late) dates."""

from pyspark.sql import functions as F

from ranktide.sources import bridge as B
from ranktide.sources import landing as LD
from ranktide.streaming.incremental import run_incremental

SF = "/root/testdata/sf0.001"


def test_late_date_is_restaged(spark):
    root = LD.scratch_root(spark, "inc-test")
    tr = B.transitions(spark, SF)
    LD.land_partitioned(tr, root, "opportunity_transitions")
    staging, ckpt = f"{root}/staging", f"{root}/_ckpt"
    run_incremental(spark, root, "opportunity_transitions", staging, ckpt, "2024-01-01", "2024-01-31")
    read = lambda: spark.read.schema(LD.struct_type("opportunity_transitions", with_dt=True)).parquet(staging)
    n_first = read().count()
    assert n_first == tr.where(F.col("ingest_date").between("2024-01-01", "2024-01-31")).count()
    day = "2024-01-10"
    late = tr.where(F.col("ingest_date") == F.lit(day).cast("date")).withColumn("reason", F.lit("late"))
    LD.land_snapshot(late, root, "opportunity_transitions", day)
    run_incremental(spark, root, "opportunity_transitions", staging, ckpt, "2024-01-01", "2024-01-31")
    after = read()
    assert after.count() == n_first
    assert after.where(F.col("ingest_date") == F.lit(day).cast("date")).select("reason").distinct().collect()[0].reason == "late"
    assert after.where((F.col("ingest_date") != F.lit(day).cast("date")) & (F.col("reason") == "late")).count() == 0
