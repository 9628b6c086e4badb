"""Per-package and per-repository lookups read from landed documents.

The live registry / repository APIs are replaced by landed tables; every
lookup is a key-unique table joined on the short package name or the parsed
(owner, repo) pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.functions.strings import parse_ts, purl_name, repo_name, repo_owner
from ranktide.operators.windows import top_k_per_group

REPO_META_SCHEMA = T.StructType([
    T.StructField("errors", T.ArrayType(T.StructType([T.StructField("message", T.StringType())]))),
    T.StructField("data", T.StructType([
        T.StructField("repository", T.StructType([
            T.StructField("isArchived", T.BooleanType()),
            T.StructField("defaultBranchRef", T.StructType([
                T.StructField("target", T.StructType([T.StructField("oid", T.StringType())])),
            ])),
            T.StructField("pullRequests", T.StructType([
                T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("mergedAt", T.StringType())]))),
            ])),
        ])),
    ])),
])


def src_latest_version(docs: DataFrame) -> DataFrame:
    """(name, doc JSON) -> (name, latest); an empty tag is unknown (NULL)."""
    return docs.select("name", F.nullif(F.get_json_object("doc", "$['dist-tags'].latest"), F.lit("")).alias("latest"))


def src_weekly_downloads(projects_latest: DataFrame) -> DataFrame:
    """Landed download counts: short name -> weekly downloads (NULL = unknown)."""
    return projects_latest.select(purl_name("purl").alias("name"), F.col("downloads_weekly"))


def join_downloads(df: DataFrame, downloads: DataFrame, purl_col: str = "purl") -> DataFrame:
    """Dictionary lookup by short name; a miss leaves ``downloads_weekly`` NULL."""
    d = downloads.select(F.col("name").alias("__dname"), F.col("downloads_weekly"))
    x = df.withColumn("__name", purl_name(purl_col))
    return x.join(d, x["__name"] == d["__dname"], "left").drop("__name", "__dname")


def src_repo_meta(docs: DataFrame) -> DataFrame:
    """(repo_url, response JSON) -> archived flag, newest merge time, head SHA.

    A response with errors, or without a repository, is unknown: all NULL.
    """
    p = docs.select("repo_url", F.from_json("doc", REPO_META_SCHEMA).alias("j"))
    repo = F.col("j.data.repository")
    ok = F.col("j").isNotNull() & (F.coalesce(F.size("j.errors"), F.lit(0)) <= 0) & repo.isNotNull()
    return p.select(
        F.col("repo_url"),
        repo_owner("repo_url").alias("owner"),
        repo_name("repo_url").alias("repo"),
        F.when(ok, F.coalesce(repo["isArchived"], F.lit(False))).alias("is_archived"),
        F.when(ok, parse_ts(F.get(repo["pullRequests"]["nodes"], 0)["mergedAt"])).alias("last_merged_pr_at"),
        F.when(ok, repo["defaultBranchRef"]["target"]["oid"]).alias("head_sha"),
        ok.alias("known"),
    )


def one_per_repository(meta: DataFrame) -> DataFrame:
    """Known metadata, one row for each (owner, repo): the least URL's."""
    return top_k_per_group(meta.where(F.col("known")), ["owner", "repo"], [F.col("repo_url").asc()], 1)


def join_repo_meta(df: DataFrame, meta: DataFrame, url_col: str = "repo_url") -> DataFrame:
    """Lookup by parsed (owner, repo); unknown repo -> archived false, no merge time, no SHA."""
    m = one_per_repository(meta).select(
        F.col("owner").alias("__o"), F.col("repo").alias("__r"),
        F.col("is_archived").alias("meta_archived"), F.col("last_merged_pr_at").alias("meta_last_merged_pr_at"),
        F.col("head_sha").alias("meta_head_sha"),
    )
    x = df.withColumn("__ow", repo_owner(url_col)).withColumn("__rp", repo_name(url_col))
    j = x.join(m, (x["__ow"] == m["__o"]) & (x["__rp"] == m["__r"]), "left")
    return j.withColumn("meta_archived", F.coalesce(F.col("meta_archived"), F.lit(False))).drop("__ow", "__rp", "__o", "__r")
