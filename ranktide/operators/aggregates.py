"""Aggregations: easiest band, dedupe-by-aggregate, counters, facets.

Where the reference keeps "the best row per key" we use ``max_by`` over an
ordering struct that ends in a unique key. That is a plain aggregate with a
partial (map-side) step, so a hot key collapses to one row per map task before
the shuffle; no group is materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.functions.scoring import effort_band_score

# Band ranking used when a manifest entry lists several ids
# (higher = easier). The floor is minor-migration.
BAND_RANK = {"drop-in": 4, "codemod-available": 3, "minor-migration": 2, "rewrite": 1}
BAND_FLOOR = "minor-migration"
# End of fixed values.


def band_rank(band) -> Column:
    m = F.create_map(*[x for k, v in BAND_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[band if isinstance(band, Column) else F.col(band)], F.lit(0))


def agg_easiest_band(df: DataFrame, keys: Sequence[str], band: str = "band") -> DataFrame:
    """Easiest band per key, never below the floor (ties between equal ranks are the same band)."""
    g = df.groupBy(*keys).agg(F.max(band_rank(band)).alias("__r"))
    names = F.create_map(*[x for k, v in BAND_RANK.items() for x in (F.lit(v), F.lit(k))])
    floor = BAND_RANK[BAND_FLOOR]
    return g.select(*keys, names[F.greatest(F.col("__r"), F.lit(floor))].alias("effort"))


def dedupe_easiest(replacements: DataFrame, seq: str = "seq") -> DataFrame:
    """Per from-package keep the highest effort score; ties keep the earlier row.

    Also returns ``first_seq``: where the from-package first appeared, which is
    the stable order later rankings fall back to.
    """
    r = replacements.withColumn("effort_score", effort_band_score("effort"))
    cols = [c for c in r.columns if c != "from_purl"]
    g = r.groupBy("from_purl").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("effort_score"), -F.col(seq))).alias("__best"),
        F.min(seq).alias("first_seq"),
    )
    return g.select("from_purl", *[F.col("__best")[c].alias(c) for c in cols], "first_seq")
