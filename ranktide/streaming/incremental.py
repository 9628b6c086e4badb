"""Interval-incremental staging as a Structured Streaming job.

The landed folder is a file-stream source. Each run (``availableNow``) picks
up the files landed since the last run, including re-landed (late) dates; for
every date touched in a micro-batch the whole landed date is re-read, staged
and written over that date's staging partition with dynamic partition
overwrite. Progress lives in the stream checkpoint (a shared folder), so a
lost executor or a crashed run resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.sources import landing as LD


def run_incremental(
    spark: SparkSession,
    root: str,
    source: str,
    staging_path: str,
    checkpoint_location: str,
    start: str,
    end: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """One ``availableNow`` run: stage every date landed (or re-landed) since the previous run."""
    landed = f"{root.rstrip('/')}/{source}"
    schema = LD.struct_type(source, with_dt=True)
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")

    def batch(df: DataFrame, _epoch: int) -> None:
        # Dates touched by this batch: one row per calendar day.
        touched = df.select("dt").distinct().where(F.col("dt").between(s, e))
        fresh = spark.read.schema(schema).parquet(landed).join(touched, "dt", "left_semi")
        staged = LD.stage_frame(fresh, source, start, end)
        if transform is not None:
            staged = transform(staged)
        LD.write_staging(staged, staging_path)

    q = (
        spark.readStream.schema(schema).parquet(landed)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    clear_emptied(spark, landed, schema, staging_path, source, s, e)


def clear_emptied(spark, landed: str, schema, staging_path: str, source: str, s, e) -> None:
    """Empty the staged dates of the interval that hold no landed row any more (re-landed with an empty frame).

    Such a date sends no row through the stream; the list of dates does tell:
    one short row per calendar day.
    """
    days = lambda path: spark.read.schema(schema).parquet(path).select("dt").where(F.col("dt").between(s, e)).distinct()
    try:
        staged = days(staging_path)
    except AnalysisException:  # nothing was ever staged
        return
    gone = staged.join(days(landed), "dt", "left_anti").select(F.col("dt").cast("string").alias("dt"))
    LD.clear_dates(spark, staging_path, source, [r["dt"] for r in gone.collect()])
