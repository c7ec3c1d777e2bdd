"""Scores, labels and severities of findings and documents: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scoring scale.
RISK_LABELS = ((25, "Low tampering risk"), (50, "Moderate tampering risk"), (75, "High tampering risk"))
HIGHEST_LABEL = "Critical tampering risk"
SEVERITIES = ((85, "critical"), (65, "high"), (40, "medium"), (15, "low"))
LOWEST_SEVERITY = "info"


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finding_risk(mean_delta: Column, changed: Column, area: Column, page_area: Column, has_text: Column) -> Column:
    """Risk of one finding, 1 to 99: intensity, density, share of the page, and a bonus for changed text."""
    density = changed / F.greatest(area, F.lit(1))
    share = area / F.greatest(page_area, F.lit(1))
    points = (
        F.lit(32.0)
        + 24.0 * F.least(F.lit(1.0), mean_delta / 100.0)
        + 18.0 * F.least(F.lit(1.0), density * 2.5)
        + 11.0 * F.least(F.lit(1.0), share / 0.008)
        + F.when(has_text, F.lit(15.0)).otherwise(F.lit(0.0))
    )
    return F.round(clip(points, 1.0, 99.0), 1)


def finding_confidence(alignment: Column, changed: Column, area: Column, has_text: Column) -> Column:
    density = changed / F.greatest(area, F.lit(1))
    points = F.lit(50.0) + 35.0 * alignment + 8.0 * F.least(F.lit(1.0), density * 3.0) + F.when(has_text, F.lit(7.0)).otherwise(F.lit(0.0))
    return F.round(clip(points, 1.0, 99.0), 1)


def overall_risk(max_risk: Column, n_findings: Column, changed_ratio: Column) -> Column:
    """Without findings at most 20, by the changed share; else the largest risk and a little for each further finding.

    Rounded to nine digits first, so that a half that binary products leave a little below goes up."""
    none = F.least(F.lit(20.0), changed_ratio * 1500.0)
    some = F.least(F.lit(100.0), max_risk + F.least(F.lit(6.0), (n_findings - 1) * 1.5))
    return F.round(F.round(F.when(F.coalesce(n_findings, F.lit(0)) == 0, none).otherwise(some), 9), 1)


def risk_label(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, name in RISK_LABELS:
        out = out.when(score < limit, name)
    return out.otherwise(HIGHEST_LABEL)


def severity(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, name in SEVERITIES:
        out = out.when(score >= limit, name)
    return out.otherwise(LOWEST_SEVERITY)


def assessment_confidence(alignment: Column, has_text: Column) -> Column:
    return F.round(F.least(F.lit(99.0), 65.0 + 27.0 * alignment + F.when(has_text, F.lit(7.0)).otherwise(F.lit(0.0))), 1)


def analysis_coverage(has_text: Column) -> Column:
    return F.when(has_text, F.lit(100.0)).otherwise(F.lit(88.0))
