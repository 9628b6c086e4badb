"""Scoring model as Column expressions (no UDFs: everything stays in codegen).

Scale 0..100 for the sub-scores and the final blend; ``score_macro`` is the
same vulnerability score divided by 100 (0..1), as the warehouse mart uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranktide.functions.util import as_col, dlit

# Fixed values of the scoring model (must equal the reference for equal scores).
DOWNLOADS_REF = 100_000_000  # weekly downloads that map to full popularity
STARS_REF = 100_000
W_DOWNLOADS = 0.7
W_STARS = 0.3
W_IMPACT = 0.6
W_EFFORT = 0.25
W_CONFIDENCE = 0.15
CONFIDENCE_FRESH_DAYS = 14.0
CONFIDENCE_STALE_DAYS = 365.0
CONFIDENCE_UNKNOWN = 30.0
SEVERITY_UNKNOWN_CVSS = 5.0
EFFORT_UNPATCHED = 20.0
EFFORT_BREAKING = 60.0
EFFORT_BUMP = 95.0
EFFORT_OTHER = 70.0
BREAKING_WORDS = ("breaking", "rewrite", "rearchitect", "removed api")
# Effort band -> score; any other band scores 50.
EFFORT_BAND_SCORE = {
    "drop-in": 95.0,
    "minor-migration": 70.0,
    "codemod-available": 60.0,
    "rewrite": 20.0,
}
EFFORT_BAND_OTHER = 50.0
# Replacement baseline severity.
REPL_SEV_NATIVE = 75.0
REPL_SEV_PERF = 60.0
REPL_SEV_OTHER = 45.0
# End of fixed values.

MICROS_PER_DAY = 86_400_000_000.0


def _clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(dlit(lo), F.least(dlit(hi), c))


def popularity(downloads, stars) -> Column:
    """Log-normalised popularity in [0, 100]; unknown counts contribute 0.

    ``log10`` of a non-positive argument is NULL in Spark, so the coalesce also
    covers negative counts (the reference would raise there).
    """
    d = as_col(downloads).cast("double")
    s = as_col(stars).cast("double")
    pd_ = F.coalesce(F.log10(dlit(1.0) + d) / F.log10(dlit(1.0 + DOWNLOADS_REF)), dlit(0.0))
    ps = F.coalesce(F.log10(dlit(1.0) + s) / F.log10(dlit(1.0 + STARS_REF)), dlit(0.0))
    return _clamp(dlit(100.0) * (dlit(W_DOWNLOADS) * pd_ + dlit(W_STARS) * ps))


def severity(cvss) -> Column:
    """CVSS 0..10 -> 0..100, unknown -> 50."""
    return _clamp(F.coalesce(as_col(cvss).cast("double"), dlit(SEVERITY_UNKNOWN_CVSS)) * dlit(10.0))


def effort(fixed_versions, summary) -> Column:
    """Effort heuristic for a vulnerability fix (higher = easier)."""
    fv = as_col(fixed_versions)
    text = F.lower(F.coalesce(as_col(summary), F.lit("")))
    breaking = None
    for w in BREAKING_WORDS:
        cond = text.contains(w)
        breaking = cond if breaking is None else (breaking | cond)
    first = F.get(fv, 0)
    return (
        F.when(fv.isNull() | (F.size(fv) == 0), dlit(EFFORT_UNPATCHED))
        .when(breaking, dlit(EFFORT_BREAKING))
        .when(F.coalesce(first.rlike(r"^[vV]*[0-9]+([.].*)?$"), F.lit(False)), dlit(EFFORT_BUMP))
        .otherwise(dlit(EFFORT_OTHER))
    )


def effort_band_score(band) -> Column:
    """Band -> score via a literal map (folded to a constant by Catalyst)."""
    m = F.create_map(*[x for k, v in EFFORT_BAND_SCORE.items() for x in (F.lit(k), dlit(v))])
    return F.coalesce(m[as_col(band)], dlit(EFFORT_BAND_OTHER))


def is_native(to_purls) -> Column:
    return F.coalesce(F.exists(as_col(to_purls), lambda p: p.contains("<native>")), F.lit(False))


def replacement_severity(axis, native) -> Column:
    return (
        F.when(as_col(native), dlit(REPL_SEV_NATIVE))
        .when(as_col(axis) == "perf", dlit(REPL_SEV_PERF))
        .otherwise(dlit(REPL_SEV_OTHER))
    )


def impact(pop, sev) -> Column:
    return as_col(pop) / dlit(100.0) * as_col(sev)


def age_days(ts, as_of) -> Column:
    """Fractional days between a TIMESTAMP_NTZ and the evaluation instant."""
    return F.timestamp_diff("MICROSECOND", as_col(ts), as_col(as_of)) / dlit(MICROS_PER_DAY)


def confidence(last_pr_merged_at, as_of) -> Column:
    days = age_days(last_pr_merged_at, as_of)
    span = CONFIDENCE_STALE_DAYS - CONFIDENCE_FRESH_DAYS
    return (
        F.when(as_col(last_pr_merged_at).isNull(), dlit(CONFIDENCE_UNKNOWN))
        .when(days <= dlit(CONFIDENCE_FRESH_DAYS), dlit(100.0))
        .when(days >= dlit(CONFIDENCE_STALE_DAYS), dlit(0.0))
        .otherwise(dlit(100.0) * (dlit(1.0) - (days - dlit(CONFIDENCE_FRESH_DAYS)) / dlit(span)))
    )


def final_score(impact_value, effort_value, confidence_value) -> Column:
    return (
        dlit(W_IMPACT) * as_col(impact_value)
        + dlit(W_EFFORT) * as_col(effort_value)
        + dlit(W_CONFIDENCE) * as_col(confidence_value)
    )


def score_macro(cvss, downloads, stars, fixed_versions, summary, last_pr_merged_at, as_of) -> Column:
    """Whole vulnerability score as one expression, on the 0..1 scale."""
    imp = impact(popularity(downloads, stars), severity(cvss))
    return final_score(imp, effort(fixed_versions, summary), confidence(last_pr_merged_at, as_of)) / dlit(100.0)
