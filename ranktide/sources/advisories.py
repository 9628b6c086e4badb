"""Security-advisory source: nested advisory documents -> one row per affected package.

Input schema is the advisory REST document (see ``NESTED_SCHEMA``); in
production it is read with ``spark.read.schema(NESTED_SCHEMA).json(path)``.
The flatten is one narrow pass (``posexplode`` of the vulnerabilities array);
the sibling flag is computed with ``exists`` on the array *before* exploding,
so it needs no window or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranktide.functions.strings import parse_ts, purl_build
from ranktide.functions.util import as_col
from ranktide.operators.windows import top_k_per_group

NESTED_SCHEMA = T.StructType([
    T.StructField("ghsa_id", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("withdrawn_at", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("source_code_location", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
    T.StructField("cvss", T.StructType([T.StructField("score", T.DoubleType())])),
    T.StructField("cvss_severities", T.StructType([
        T.StructField("cvss_v3", T.StructType([T.StructField("score", T.DoubleType())])),
        T.StructField("cvss_v4", T.StructType([T.StructField("score", T.DoubleType())])),
    ])),
    T.StructField("vulnerabilities", T.ArrayType(T.StructType([
        T.StructField("package", T.StructType([
            T.StructField("ecosystem", T.StringType()),
            T.StructField("name", T.StringType()),
        ])),
        T.StructField("vulnerable_version_range", T.StringType()),
        T.StructField("first_patched_version", T.StringType()),
    ]))),
])

# Severity classes requested, in request order.
SEVERITY_ORDER = ("critical", "high", "medium")


def cvss_pick(doc: Column | None = None) -> Column:
    """v4 score, else v3, else legacy; a score of 0 counts as missing."""
    def nz(c: Column) -> Column:
        return F.when(c != 0, c)
    v4 = F.col("cvss_severities.cvss_v4.score")
    v3 = F.col("cvss_severities.cvss_v3.score")
    legacy = F.col("cvss.score")
    return F.coalesce(nz(v4), nz(v3), nz(legacy)).cast("double")


def _has_fix(v: Column) -> Column:
    return v["first_patched_version"].isNotNull() & (v["first_patched_version"] != "")


def sibling_patched() -> Column:
    """Per advisory: any package in the document already has a first patched version."""
    return F.coalesce(F.exists(F.col("vulnerabilities"), _has_fix), F.lit(False))


def flatten(
    docs: DataFrame,
    *,
    ecosystem: str = "npm",
    only_unpatched: bool = True,
    per_page: int | None = None,
    limit: int | None = None,
    page_order: str = "page_pos",
) -> DataFrame:
    """Nested documents -> one advisory row per affected package of ``ecosystem``.

    ``only_unpatched`` keeps packages without a fix, otherwise only patched ones.
    ``per_page`` keeps the first N documents per severity class (page order),
    ``limit`` cuts the flattened rows in emission order (severity class, page
    position, package position). Both limits are per-group top-k / global
    top-k, so they never pull the input into one task.
    """
    sev_rank = F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.lower(F.col("severity"))).cast("int"),
        F.lit(len(SEVERITY_ORDER) + 1),
    )
    d = docs.where(F.lower(F.col("severity")).isin(*SEVERITY_ORDER))
    d = d.withColumn("sev_rank", sev_rank)
    if per_page is not None:
        d = top_k_per_group(d, ["sev_rank"], [F.col(page_order).asc(), F.col("ghsa_id").asc()], per_page)
    # A withdrawn document takes its place on the page.
    d = d.where(F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") == ""))
    d = d.withColumn("has_patched_sibling_doc", sibling_patched())
    x = d.select("*", F.posexplode_outer("vulnerabilities").alias("vuln_pos", "v"))
    fixed = x["v.first_patched_version"]
    has_fix = fixed.isNotNull() & (fixed != "")
    keep = (
        F.col("v").isNotNull()
        & F.col("v.package.name").isNotNull() & (F.col("v.package.name") != "")
        & (F.lower(F.coalesce(F.col("v.package.ecosystem"), F.lit(""))) == ecosystem)
        & (~has_fix if only_unpatched else has_fix)
    )
    out = x.where(keep).select(
        F.col("ghsa_id").alias("id"),
        purl_build(F.col("v.package.ecosystem"), F.col("v.package.name"), lower_eco=True).alias("project_purl"),
        F.col("severity"),
        cvss_pick().alias("cvss"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
        F.col("v.vulnerable_version_range").alias("affected_versions"),
        F.when(has_fix, F.array(fixed)).otherwise(F.array().cast("array<string>")).alias("fixed_versions"),
        F.coalesce(F.col("references"), F.array().cast("array<string>")).alias("refs"),
        parse_ts("published_at").alias("published_at"),
        F.when(F.col("source_code_location") != "", F.col("source_code_location")).alias("repo_url"),
        (F.col("has_patched_sibling_doc") & ~has_fix).alias("has_patched_sibling"),
        F.col("sev_rank"),
        F.col(page_order).alias("page_pos"),
        F.col("vuln_pos"),
    )
    if limit is not None:
        out = out.orderBy("sev_rank", "page_pos", "id", "vuln_pos").limit(limit)
    return out


def flt_sibling_patched(advisories: DataFrame) -> DataFrame:
    """Drop advisories whose document already has a patched sibling package."""
    return advisories.where(~F.coalesce(as_col("has_patched_sibling"), F.lit(False)))
