"""Landing (raw Parquet by ingest date) and staging (typed reads over a date range).

Layout: ``<root>/<source>/dt=YYYY-MM-DD/part-*.parquet`` with ``ingest_date``
repeated inside every row. Two writers:

* ``land_snapshot``: one date, written straight into its ``dt=`` folder with
  ``overwrite``; re-landing a date replaces it, and an empty frame still
  leaves a schema-bearing file.
* ``land_partitioned``: many dates in one job, ``partitionBy('dt')`` with
  *dynamic* partition overwrite, so only the dates present are replaced.

``root`` must be a shared folder; ``scratch_root`` derives one from the
cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.session import checkpoint_dir, shuffles_removed

# Landed column lists (name, Spark type), in landing order.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "advisories": [
        ("id", "string"), ("project_purl", "string"), ("severity", "string"), ("cvss", "double"), ("summary", "string"),
        ("affected_versions", "string"), ("fixed_versions", "array<string>"), ("refs", "array<string>"),
        ("published_at", "timestamp_ntz"), ("repo_url", "string"), ("ingest_date", "date"),
    ],
    "replacements": [
        ("id", "string"), ("from_purl", "string"), ("to_purls", "array<string>"), ("axis", "string"), ("effort", "string"),
        ("evidence_json", "string"), ("ingest_date", "date"),
    ],
    "opportunity_transitions": [
        ("dedupe_key", "string"), ("to_state", "string"), ("transitioned_at", "timestamp_ntz"), ("actor", "string"),
        ("reason", "string"), ("ingest_date", "date"),
    ],
    "dependents": [
        ("parent_purl", "string"), ("dependent_purl", "string"), ("dependent_name", "string"), ("dependent_repo_url", "string"),
        ("dependent_lifetime_downloads", "bigint"), ("ingest_date", "date"),
    ],
    "projects": [
        ("purl", "string"), ("ecosystem", "string"), ("name", "string"), ("repo_url", "string"), ("homepage", "string"),
        ("stars", "bigint"), ("downloads_weekly", "bigint"), ("dependents", "bigint"), ("last_release_at", "timestamp_ntz"),
        ("last_commit_at", "timestamp_ntz"), ("last_pr_merged_at", "timestamp_ntz"), ("archived", "boolean"),
        ("has_benchmarks", "boolean"), ("bench_signal", "string"), ("ingest_date", "date"),
    ],
}

# Staged column lists: projects drop ``bench_signal``.
STAGED: dict[str, list[str]] = {k: [c for c, _ in v] for k, v in SCHEMAS.items()}
STAGED["projects"] = [c for c in STAGED["projects"] if c != "bench_signal"]


def struct_type(source: str, with_dt: bool = False) -> T.StructType:
    fields = [T.StructField(c, T._parse_datatype_string(t)) for c, t in SCHEMAS[source]]
    if with_dt:
        fields.append(T.StructField("dt", T.DateType()))
    return T.StructType(fields)


def scratch_root(spark: SparkSession, name: str = "land") -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ranktide-{name}-{uuid.uuid4().hex[:12]}"


def conform(df: DataFrame, source: str) -> DataFrame:
    """Project and cast to the landed schema (declared, never inferred)."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in SCHEMAS[source]])


def land_snapshot(df: DataFrame, root: str, source: str, ingest_date: str) -> str:
    """Land one date's rows into ``<root>/<source>/dt=<date>`` (overwrite; empty keeps the schema)."""
    path = f"{root.rstrip('/')}/{source}/dt={ingest_date}"
    out = conform(df.withColumn("ingest_date", F.lit(ingest_date).cast("date")), source)
    out.write.mode("overwrite").parquet(path)
    return path


ROWS_PER_FILE = 2_000_000


def _together(df: DataFrame) -> DataFrame:
    """A rebalance on the date ``dt`` brings a date's rows together; AQE splits a date that is too large for one task and merges small ones."""
    return df.hint("rebalance", F.col("dt"))


def _write_by_date(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Write rows that are together by ``dt``, replacing only the dates present.

    Files of a hot date are cut at ``rows_per_file``. What was shuffled goes as soon as the rows are written.
    """
    with shuffles_removed(df.sparkSession):
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", rows_per_file)
            .option("compression", "zstd")
            .partitionBy("dt")
            .parquet(path)
        )


def land_partitioned(
    df: DataFrame, root: str, source: str, rows_per_file: int = ROWS_PER_FILE, spell: Sequence[Column] | None = None
) -> str:
    """Land rows of many dates in one job; only the dates present are replaced (dynamic overwrite).

    ``spell`` are the landed columns of rows that have only their ``ingest_date`` as yet: these are
    brought together and sorted by date and their other columns as they come, and spelled where they are
    written. Rows that are alike then stand side by side, which makes files small.
    """
    path = f"{root.rstrip('/')}/{source}"
    if spell is None:
        rows = _together(conform(df, source).withColumn("dt", F.col("ingest_date")))
    else:
        rows = _together(df.withColumn("dt", F.col("ingest_date"))).sortWithinPartitions("dt", *df.columns)
        rows = rows.select(*spell, "dt").select(*[F.col(c).cast(t).alias(c) for c, t in SCHEMAS[source]], "dt")
    _write_by_date(rows, path, rows_per_file)
    return path


def read_landed(spark: SparkSession, root: str, source: str) -> DataFrame:
    return spark.read.schema(struct_type(source, with_dt=True)).parquet(f"{root.rstrip('/')}/{source}")


def stage(spark: SparkSession, root: str, source: str, start: str, end: str) -> DataFrame:
    """Typed staging read for ``start <= ingest_date <= end``.

    The range is applied to the partition column ``dt`` as well, so the scan
    lists only the matching folders (``PartitionFilters``), and to
    ``ingest_date`` inside the rows.
    """
    return stage_frame(read_landed(spark, root, source), source, start, end)


def stage_frame(landed: DataFrame, source: str, start: str, end: str) -> DataFrame:
    """Casts + the inclusive date range on both ``dt`` and ``ingest_date``."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    df = landed.where(F.col("dt").between(s, e)).where(F.col("ingest_date").between(s, e))
    return df.select(*[F.col(c).cast(dict(SCHEMAS[source])[c]).alias(c) for c in STAGED[source]])


def write_staging(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write staged rows partitioned by date, replacing only the dates present (interval recompute)."""
    _write_by_date(_together(df.withColumn("dt", F.col("ingest_date"))), path, rows_per_file)


def clear_dates(spark: SparkSession, path: str, source: str, dates: list[str]) -> None:
    """Leave an empty, schema-bearing file in each of these dates' staging folders."""
    fields = [f for f in struct_type(source).fields if f.name in STAGED[source]]
    for d in dates:
        spark.createDataFrame([], T.StructType(fields)).coalesce(1).write.mode("overwrite").parquet(f"{path}/dt={d}")
