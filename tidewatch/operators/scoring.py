"""Score tables and the columns derived from a churn probability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.schema import REQUEST_FIELDS, Field
from tidewatch.operators.ordered import number_rows
from tidewatch.operators.validation import split_requests

# Stand-in model with fixed weights, for runs without a trained model.
INTERCEPT = 1.6
WEIGHTS: Mapping[str, float] = {"tenure": -0.05, "MonthlyCharges": 0.008, "TotalCharges": -0.0008}

# The same for single orders, used where many batches are scored.
ORDER_INTERCEPT = -1.5
ORDER_WEIGHTS: Mapping[str, float] = {"o_totalprice": 0.000006}


def score_linear(
    df: DataFrame,
    intercept: float = INTERCEPT,
    weights: Mapping[str, float] = WEIGHTS,
    out: str = "churn_probability",
    digits: int = 6,
) -> DataFrame:
    return df.withColumn(out, C.logistic_score(intercept, weights, digits))


def add_bands(
    df: DataFrame, p: str = "churn_probability", medium: float = C.MEDIUM_RISK, high: float = C.HIGH_RISK
) -> DataFrame:
    return df.withColumn("risk_level", C.risk_band(p, medium, high))


def add_business_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "monthly_revenue_at_risk": C.revenue_at_risk("risk_level", "MonthlyCharges"),
            "intervention_recommended": C.needs_action("risk_level"),
            "estimated_ltv": F.col("MonthlyCharges") * C.LIFETIME_MONTHS,
            "priority_score": C.priority("risk_level"),
        }
    )


def stamp(df: DataFrame, asof: str | Column, version: str) -> DataFrame:
    at = F.lit(asof).cast("timestamp_ntz") if isinstance(asof, str) else asof
    return df.withColumns({"prediction_timestamp": at, "model_version": F.lit(version)})


def score_with_errors(df: DataFrame, fields: list[Field] = REQUEST_FIELDS) -> DataFrame:
    """Score the valid records; the others get probability 0, band ERROR and a message."""
    valid, rejected = split_requests(df, fields)
    scored = add_bands(score_linear(valid)).withColumn("error_message", F.lit(None).cast("string"))
    errors = rejected.select(
        *df.columns,
        F.lit(0.0).alias("churn_probability"),
        F.lit("ERROR").alias("risk_level"),
        F.array_join("reasons", "; ").alias("error_message"),
    )
    return scored.unionByName(errors)


def rich_result(df: DataFrame, inputs: list[str], asof: str, version: str, p: str = "churn_probability") -> DataFrame:
    """Label, text, confidence and the echoed inputs next to each probability."""
    label = C.hard_label(p)
    return stamp(
        df.withColumns(
            {
                "prediction": label,
                "prediction_label": C.label_text(label),
                "confidence_level": C.confidence_level(p),
                "confidence_score": C.confidence_score(p),
                "input_features": F.struct(*inputs),
            }
        ),
        asof,
        version,
    )


def batch_numbers(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Number chunks of ``size`` rows, from 1, in the order of a unique key."""
    position = F.col("_position") - 1
    return (
        number_rows(df, key, "_position")
        .withColumn("batch_number", F.floor(position / size) + 1)
        .drop("_position")
    )


def outreach_list(df: DataFrame, key: str) -> DataFrame:
    """Customers to contact, most urgent first, with their ``place`` from 1; places are found range by range."""
    urgency = F.struct(-F.col("priority_score"), -F.col("MonthlyCharges"), key)
    listed = df.where("intervention_recommended").withColumn("_urgency", urgency)
    return number_rows(listed, "_urgency", "place").drop("_urgency").orderBy("place")
