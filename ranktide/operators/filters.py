"""Fail-open row filters: a row is dropped only when the predicate is provably false.

Unknown inputs (NULL downloads, unknown latest version, unparseable ranges,
unreachable repos) keep the row, so every filter is ``coalesce(pred, true)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.semver import version_in_range
from ranktide.functions.strings import purl_name
from ranktide.functions.util import as_col

# Fixed values.
MIN_WEEKLY_DOWNLOADS = 50_000
NPM_NAME_PATTERN = r"^(@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*$"
# End of fixed values.


def eligible(archived="archived", downloads="downloads_weekly", floor: int = MIN_WEEKLY_DOWNLOADS):
    return ~F.coalesce(as_col(archived), F.lit(False)) & F.coalesce(as_col(downloads) >= F.lit(floor), F.lit(True))


def flt_eligible(projects: DataFrame, floor: int = MIN_WEEKLY_DOWNLOADS) -> DataFrame:
    """Drop archived projects and those below the weekly-downloads floor (NULL passes)."""
    return projects.where(eligible(floor=floor))


def with_outdated_verdict(advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach ``latest`` (by short package name) and ``in_range`` (true / false / NULL).

    ``latest`` has one row per package name, so the join cannot fan out. It is a
    plain left join: AQE turns it into a broadcast when the registry table is
    small at run time and keeps a shuffle join when it is not.
    """
    l = latest.select(F.col("name").alias("__lname"), F.col("latest"))
    a = advisories.withColumn("__name", purl_name("project_purl"))
    j = a.join(l, a["__name"] == l["__lname"], "left").drop("__lname", "__name")
    return j.withColumn("in_range", version_in_range(F.col("latest"), F.col("affected_versions")))


def flt_outdated(advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """Drop an advisory when the package's latest version is provably outside its range."""
    j = with_outdated_verdict(advisories, latest)
    no_range = F.coalesce(F.col("affected_versions"), F.lit("")) == ""
    keep = no_range | F.col("latest").isNull() | F.coalesce(F.col("in_range"), F.lit(True))
    return j.where(keep)


def flt_valid_package_name(df: DataFrame, col: str = "name") -> tuple[DataFrame, DataFrame]:
    """Split into (valid, quarantined) by the registry name grammar."""
    ok = F.coalesce(as_col(col).rlike(NPM_NAME_PATTERN), F.lit(False))
    return df.where(ok), df.where(~ok)
