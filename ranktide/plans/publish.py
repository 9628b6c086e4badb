"""Publishing briefs: a ``briefs`` table partitioned by ecosystem, read back with a fixed schema.

A run's selection replaces its ecosystem's folder in one write: briefs selected
again are overwritten and briefs not selected this run disappear (the sweep). The
write is one code path, also for an empty selection, which leaves an empty file
with the schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRIEFS_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("project_purl", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("frontmatter", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
])

# Frontmatter fields the listing reads, with their types (nullable; defaults applied on read).
FRONTMATTER_SCHEMA = (
    "struct<schema:string,title:string,slug:string,date:string,run_at:string,"
    "project:struct<purl:string,name:string,ecosystem:string,repo_url:string,downloads_weekly:bigint,archived:boolean>,"
    "score:struct<total:double,impact:double,effort:double,confidence:int>,"
    "maintainer_activity:struct<label:string,last_pr_merged_at:string>,"
    "benchmarks:struct<has:boolean,signal:string>,"
    "opportunities:struct<count:int,kinds:array<string>,top_kind:string>,"
    "tags:array<string>,citations:array<struct<type:string,id:string,url:string>>>"
)


def snk_briefs(rendered: DataFrame, path: str, ecosystem: str = "npm") -> None:
    """Write this run's briefs of ``ecosystem``: overwrite + sweep in one write of its folder."""
    out = rendered.where(F.col("ecosystem") == ecosystem).select(*[f.name for f in BRIEFS_SCHEMA.fields if f.name != "ecosystem"])
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path.rstrip('/')}/ecosystem={ecosystem}")


def src_briefs_read(spark: SparkSession, path: str) -> DataFrame:
    """Published briefs with the frontmatter parsed against a fixed schema; tags/citations default to []."""
    b = spark.read.schema(BRIEFS_SCHEMA).parquet(path)
    fm = F.from_json("frontmatter", FRONTMATTER_SCHEMA)
    b = b.withColumn("fm", fm)
    return b.select(
        "ecosystem", "slug", "project_purl", "score", "frontmatter", "body",
        F.col("fm.title").alias("title"),
        F.col("fm.score.total").alias("score_total"),
        F.col("fm.opportunities.top_kind").alias("top_kind"),
        F.coalesce(F.col("fm.tags"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("fm.citations"), F.array().cast("array<struct<type:string,id:string,url:string>>")).alias("citations"),
        F.col("fm.benchmarks.has").alias("bench_has"),
        "fm",
    )


def join_anti_sweep(published_before: DataFrame, selected_now: DataFrame) -> DataFrame:
    """Previously published (ecosystem, slug) not in this run's selection: what the write sweeps."""
    return published_before.select("ecosystem", "slug").join(selected_now.select("ecosystem", "slug"), ["ecosystem", "slug"], "left_anti")
