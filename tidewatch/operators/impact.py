"""Business value of predictions: summaries, campaign economics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import LIFETIME_MONTHS, MONTHS_PER_YEAR, divide_or_zero

# Campaign parameters.
COST_PER_CONTACT = 15.0
RETENTION_RATE = 0.35
FLAT_MONTHLY_REVENUE = 65.0
BASE_CHURN_RATE = 0.27
CUSTOMER_VALUE = 1200.0
CHURN_RATE = 0.17
CAMPAIGN_COST = 75.0
CAMPAIGN_SUCCESS = 0.6
TEST_SHARE = 0.2

# Report lines.
CONTACT_LINE = "Immediately contact %d high-risk customers"
CAMPAIGN_LINE = "Deploy retention campaigns for %d medium-risk customers"
BUDGET_LINE = "Allocate $%s for intervention programs"
RETURN_LINE = "Expected ROI: %.0f%% ($%s net benefit)"


def _band(name: str) -> Column:
    return F.count_if(F.col("risk_level") == name)


def batch_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, band shares and revenue at risk of a scored table, in one aggregate."""
    n = F.count("*")
    errors, high, medium, low = (_band(b) for b in ("ERROR", "HIGH", "MEDIUM", "LOW"))
    at_risk = F.coalesce(F.sum("monthly_revenue_at_risk"), F.lit(0.0))
    return scored.groupBy(*(by or [])).agg(
        n.alias("total_records"),
        (n - errors).alias("successful_predictions"),
        errors.alias("errors"),
        high.alias("high_risk_count"),
        medium.alias("medium_risk_count"),
        low.alias("low_risk_count"),
        (divide_or_zero(high, n) * 100).alias("high_risk_pct"),
        (divide_or_zero(medium, n) * 100).alias("medium_risk_pct"),
        (divide_or_zero(low, n) * 100).alias("low_risk_pct"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        at_risk.alias("monthly_revenue_at_risk"),
        (at_risk * MONTHS_PER_YEAR).alias("annual_revenue_at_risk"),
        (high + medium).alias("customers_requiring_intervention"),
    )


def retention_value(
    n_high: Column, monthly: Column, cost: float = COST_PER_CONTACT, rate: float = RETENTION_RATE
) -> dict[str, Column]:
    """Cost, revenue saved, net benefit and ROI % of contacting the high-risk customers."""
    total_cost = n_high * F.lit(cost)
    kept = n_high * F.lit(rate)
    saved = kept * monthly * LIFETIME_MONTHS
    net = saved - total_cost
    return {
        "intervention_cost": total_cost,
        "customers_retained": kept,
        "revenue_saved": saved,
        "net_benefit": net,
        "roi_percentage": divide_or_zero(net, F.nullif(total_cost, F.lit(0.0))) * 100,
    }


def business_report(scored: DataFrame) -> DataFrame:
    """Executive, financial and campaign figures of a scored table as one row."""
    base = scored.agg(
        F.count("*").alias("total_customers"),
        _band("HIGH").alias("high_risk_customers"),
        _band("MEDIUM").alias("medium_risk_customers"),
        F.coalesce(F.sum("MonthlyCharges"), F.lit(0.0)).alias("total_monthly_revenue"),
        F.coalesce(F.sum(F.when(F.col("risk_level") == "HIGH", F.col("MonthlyCharges"))), F.lit(0.0)).alias(
            "monthly_revenue_at_risk"
        ),
        F.avg("MonthlyCharges").alias("avg_monthly_revenue"),
    )
    n_high = F.col("high_risk_customers")
    report = base.withColumns(
        {
            "churn_risk_rate": divide_or_zero(n_high, F.col("total_customers")) * 100,
            "annual_revenue_at_risk": F.col("monthly_revenue_at_risk") * MONTHS_PER_YEAR,
            "lifetime_value_at_risk": n_high * F.col("avg_monthly_revenue") * LIFETIME_MONTHS,
            "recommended_interventions": n_high + F.col("medium_risk_customers"),
            **retention_value(n_high, F.col("avg_monthly_revenue")),
        }
    )
    return report


def action_items(report: DataFrame) -> DataFrame:
    """The business report as text lines."""
    money = lambda c: F.format_number(F.col(c), 0)
    lines = F.array(
        F.format_string(CONTACT_LINE, F.col("high_risk_customers")),
        F.format_string(CAMPAIGN_LINE, F.col("medium_risk_customers")),
        F.format_string(BUDGET_LINE, money("intervention_cost")),
        F.format_string(RETURN_LINE, F.col("roi_percentage"), money("net_benefit")),
    )
    return report.select(F.posexplode(lines).alias("line", "text"))


def portfolio_report(
    scored: DataFrame,
    p: str = "churn_probability",
    multiplier: int = 1000,
    monthly: float = FLAT_MONTHLY_REVENUE,
    base_rate: float = BASE_CHURN_RATE,
) -> DataFrame:
    """Flat-revenue portfolio figures with band counts scaled by ``multiplier``."""
    bands = scored.agg(
        (F.count("*") * multiplier).alias("total_customers"),
        *[(_band(b) * multiplier).alias(f"{b.lower()}_risk") for b in ("HIGH", "MEDIUM", "LOW")],
        F.avg(p).alias("predicted_churn_rate"),
    )
    n_high = F.col("high_risk")
    return bands.withColumns(
        {
            "monthly_revenue_at_risk": n_high * F.lit(monthly),
            "annual_revenue_at_risk": n_high * F.lit(monthly) * MONTHS_PER_YEAR,
            "clv_at_risk": n_high * F.lit(monthly) * LIFETIME_MONTHS,
            **retention_value(n_high, F.lit(monthly)),
            "improvement_pct": (F.lit(base_rate) - F.col("predicted_churn_rate")) / F.lit(base_rate) * 100,
        }
    )


def retention_roi(scored: DataFrame, monthly: float = FLAT_MONTHLY_REVENUE) -> DataFrame:
    """ROI of contacting only the high-risk customers at a flat monthly revenue."""
    return scored.agg(_band("HIGH").alias("high_risk")).withColumns(
        {
            "monthly_revenue_at_risk": F.col("high_risk") * F.lit(monthly),
            "annual_revenue_at_risk": F.col("high_risk") * F.lit(monthly) * MONTHS_PER_YEAR,
            **retention_value(F.col("high_risk"), F.lit(monthly)),
        }
    )


def campaign_impact(
    metrics: DataFrame,
    customer_base: Column,
    value: float = CUSTOMER_VALUE,
    churn: float = CHURN_RATE,
    cost: float = CAMPAIGN_COST,
    success: float = CAMPAIGN_SUCCESS,
) -> DataFrame:
    """Campaign economics for each row with ``recall`` and ``precision``."""
    churners = customer_base * F.lit(churn)
    caught = churners * F.col("recall")
    saved = caught * F.lit(success)
    contacted = divide_or_zero(caught, F.nullif(F.col("precision"), F.lit(0.0)))
    total_cost = contacted * F.lit(cost)
    net = saved * F.lit(value) - total_cost
    return metrics.withColumns(
        {
            "baseline_loss": churners * F.lit(value),
            "revenue_saved": saved * F.lit(value),
            "intervention_cost": total_cost,
            "net_benefit": net,
            "roi_ratio": divide_or_zero(net, F.nullif(total_cost, F.lit(0.0))),
            "customers_saved": saved.cast("bigint"),
            "false_positives": (contacted - caught).cast("bigint"),
            "total_interventions": contacted.cast("bigint"),
            "churn_reduction_pct": divide_or_zero(saved, F.nullif(churners, F.lit(0.0))) * 100,
        }
    )


def extrapolated_impact(metrics: DataFrame, test_rows: Column) -> DataFrame:
    """Campaign economics for the whole base that a test split of one fifth stands for."""
    return campaign_impact(metrics, test_rows / F.lit(TEST_SHARE)).withColumn(
        "roi_text", F.format_string("%.1f:1", F.col("roi_ratio"))
    )


def response_summary(scored: DataFrame) -> DataFrame:
    """Band counts and mean probability of a batch response; 0 for an empty batch."""
    return scored.agg(
        F.count("*").alias("total_predictions"),
        *[_band(b).alias(f"{b.lower()}_risk_count") for b in ("HIGH", "MEDIUM", "LOW")],
        F.coalesce(F.avg("churn_probability"), F.lit(0.0)).alias("avg_churn_probability"),
    )


def inference_summary(scored: DataFrame, label: str) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total_customers"), F.coalesce(F.sum(label), F.lit(0)).alias("predicted_churners")
    ).withColumn("churn_rate_pct", divide_or_zero(F.col("predicted_churners"), F.col("total_customers")) * 100)
