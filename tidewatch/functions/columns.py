"""Column expressions: cleaning, bands, labels, fixed scores. No UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default band limits, lifetime and intervention parameters.
MEDIUM_RISK = 0.3
HIGH_RISK = 0.7
LIFETIME_MONTHS = 24
MONTHS_PER_YEAR = 12

# Accepted boolean spellings (exact case).
TRUE_WORDS = ["true", "True", "yes", "Yes", "y", "Y", "1"]
FALSE_WORDS = ["false", "False", "no", "No", "n", "N", "0"]
# The validator accepts a smaller set.
BOOLEAN_LIKE = ["0", "1", "true", "false", "True", "False", "yes", "no", "Yes", "No"]

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: Column | str) -> Column:
    """Text to double; blank or malformed text becomes null."""
    text = F.trim(_col(c))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def clip(c: Column | str, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; null stays null (least/greatest would skip it)."""
    value = _col(c)
    limited = value
    if low is not None:
        limited = F.greatest(limited, F.lit(float(low)))
    if high is not None:
        limited = F.least(limited, F.lit(float(high)))
    return F.when(value.isNotNull(), limited)


def keep_allowed(c: Column | str, allowed: Sequence[str]) -> Column:
    value = _col(c)
    return F.when(value.isin(list(allowed)), value)


def to_boolean(c: Column | str) -> Column:
    text = _col(c).cast("string")
    return F.when(text.isin(TRUE_WORDS), F.lit(True)).when(text.isin(FALSE_WORDS), F.lit(False))


def divide_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def risk_band(p: Column | str, medium: float = MEDIUM_RISK, high: float = HIGH_RISK) -> Column:
    p = _col(p)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit(None).cast("string"))
        .when(p >= high, F.lit("HIGH"))
        .when(p >= medium, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def confidence_level(p: Column | str) -> Column:
    p = _col(p)
    return (
        F.when((p > 0.8) | (p < 0.2), F.lit("High"))
        .when((p > 0.6) | (p < 0.4), F.lit("Medium"))
        .when(p.isNotNull(), F.lit("Low"))
    )


def confidence_score(p: Column | str) -> Column:
    return F.when(confidence_level(p) == "High", F.lit(0.9)).when(_col(p).isNotNull(), F.lit(0.7))


def hard_label(p: Column | str, threshold: float = 0.5) -> Column:
    return (_col(p) >= threshold).cast("int")


def label_text(label: Column | str) -> Column:
    label = _col(label)
    return F.when(label == 1, F.lit("Churn")).when(label.isNotNull(), F.lit("Retain"))


def logistic_score(intercept: float, weights: Mapping[str, float], digits: int = 6) -> Column:
    """Fixed-weight logistic score, reported to ``digits`` decimals."""
    z = F.lit(float(intercept))
    for name, weight in weights.items():
        z = z + F.col(name) * F.lit(float(weight))
    return F.round(1 / (1 + F.exp(-z)), digits)


def rule_score(tenure: Column | str, monthly: Column | str) -> Column:
    """Two-rule baseline: new customers and high bills are risky; at most 0.95."""
    base = F.when(_col(tenure) < 6, F.lit(0.8)).when(_col(tenure).isNotNull(), F.lit(0.3))
    extra = F.when(_col(monthly) > 70, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.when(base.isNotNull(), F.round(F.least(base + extra, F.lit(0.95)), 2))


def rule_band(score: Column | str) -> Column:
    """Bands of the rule score use strict limits."""
    s = _col(score)
    return (
        F.when(s > HIGH_RISK, F.lit("HIGH"))
        .when(s > MEDIUM_RISK, F.lit("MEDIUM"))
        .when(s.isNotNull(), F.lit("LOW"))
    )


def average_spend(monthly: Column | str, total: Column | str, tenure: Column | str) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(_col(monthly), zero) + F.coalesce(_col(total), zero)) / (_col(tenure) + 1)


def tenure_bucket(tenure: Column | str) -> Column:
    """Right-closed buckets (0,12], (12,36], (36,60], (60,inf)."""
    t = _col(tenure)
    return (
        F.when(t <= 0, F.lit(None).cast("string"))
        .when(t <= 12, F.lit("New"))
        .when(t <= 36, F.lit("Mid"))
        .when(t <= 60, F.lit("Long"))
        .when(t.isNotNull(), F.lit("Loyal"))
    )


def revenue_at_risk(band: Column | str, monthly: Column | str) -> Column:
    return F.when(_col(band) == "HIGH", _col(monthly).cast("double")).otherwise(F.lit(0.0))


def needs_action(band: Column | str) -> Column:
    return F.coalesce(_col(band).isin("HIGH", "MEDIUM"), F.lit(False))


def priority(band: Column | str) -> Column:
    return F.when(_col(band) == "HIGH", 3).when(_col(band) == "MEDIUM", 2).otherwise(1)


def business_record(band: Column | str, monthly: Column | str) -> Column:
    """The business columns as one nested record."""
    return F.struct(
        revenue_at_risk(band, monthly).alias("monthly_revenue_at_risk"),
        needs_action(band).alias("intervention_recommended"),
        (_col(monthly) * LIFETIME_MONTHS).alias("estimated_lifetime_value"),
        _col(band).alias("retention_priority"),
    )


def metric_text(name: Column | str, value: Column | str, digits: int = 4) -> Column:
    """``roc_auc``, 0.5 -> ``Roc Auc: 0.5000``."""
    return F.format_string(f"%s: %.{digits}f", F.initcap(F.replace(_col(name), F.lit("_"), F.lit(" "))), _col(value))
