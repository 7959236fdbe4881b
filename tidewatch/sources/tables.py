"""Parquet tables and the subscriber views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import use_utc

ASOF = "2000-08-01 00:00:00"
HORIZON_DAYS = 365
DAYS_PER_MONTH = 30.4375


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the data folder."""
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def subscribers(spark: SparkSession, folder: str, asof: str = ASOF, horizon: int = HORIZON_DAYS) -> DataFrame:
    """One row per customer active before ``asof``; churned = no order in the horizon after it.

    One pass over the orders with map-side partial sums, so a customer holding
    a large share of all orders does not hold up a task.
    """
    start = F.lit(asof).cast("timestamp_ntz")
    past = F.col("o_orderdate") < start
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    activity = (
        orders.where(F.col("o_orderdate") < start + F.expr(f"INTERVAL {horizon} DAYS"))
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(past, F.col("o_orderdate"))).alias("first_order"),
            F.count_if(past).alias("n_orders"),
            # whole cents: the sum does not depend on the order of the rows
            F.sum(F.when(past, F.round(F.col("o_totalprice") * 100).cast("bigint"))).alias("cents"),
            F.max((~past).cast("int")).alias("came_back"),
        )
        .where(F.col("first_order").isNotNull())
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return activity.join(customer, activity.o_custkey == customer.c_custkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.floor(F.datediff(F.lit(asof).cast("date"), F.to_date("first_order")) / DAYS_PER_MONTH)
        .cast("double")
        .alias("tenure"),
        (F.expr("cents div n_orders") / 100000).alias("MonthlyCharges"),
        (F.col("cents") / 100000).alias("TotalCharges"),
        F.col("c_mktsegment").alias("Contract"),
        (1 - F.col("came_back")).cast("int").alias("Churn"),
        "c_name",
        "c_nationkey",
        "c_acctbal",
    )


def _pick(number: str, *values: str | None) -> str:
    branches = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)
    )
    return f"CASE {number} % {len(values)} {branches} END"


# Raw text fields of a subscriber export, with the usual dirt: blanks, words in
# number columns, odd spellings, values out of range. Portable SQL, so that the
# checks in DuckDB see the same input.
RAW_FIELDS = {
    "customerID": "CASE WHEN c_acctbal < -900 THEN '' ELSE c_name END",
    "gender": _pick("c_nationkey", "Male", "Female", "male", None),
    "SeniorCitizen": _pick("c_nationkey", "0", "1", "yes", "TRUE", "n", "False"),
    "Partner": "CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END",
    "Dependents": "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 3000 THEN 'Yes' ELSE 'No' END",
    "tenure": "CASE WHEN c_nationkey = 7 THEN 'unknown' WHEN c_nationkey = 8 "
    "THEN CAST(CAST(tenure * 3 AS INT) AS STRING) ELSE CAST(CAST(tenure AS INT) AS STRING) END",
    "PhoneService": "CASE WHEN tenure < 55 THEN 'Yes' ELSE 'No' END",
    "MultipleLines": _pick("(c_nationkey + 1)", "Yes", "No", "No phone service"),
    "InternetService": _pick("(c_nationkey + 2)", "DSL", "Fiber optic", "No", "Cable"),
    "OnlineSecurity": _pick("(c_nationkey + 3)", "Yes", "No", "No internet service"),
    "OnlineBackup": _pick("(c_nationkey + 4)", "No", "Yes", "No internet service"),
    "DeviceProtection": _pick("(c_nationkey + 5)", "No", "No internet service", "Yes"),
    "TechSupport": _pick("(c_nationkey + 6)", "Yes", "No internet service", "No"),
    "StreamingTV": _pick("(c_nationkey + 7)", "Yes", "No", "No internet service"),
    "StreamingMovies": _pick("(c_nationkey + 8)", "Yes", "No", None),
    "Contract": "CASE Contract WHEN 'BUILDING' THEN 'Two year' WHEN 'MACHINERY' THEN 'One year' "
    "ELSE 'Month-to-month' END",
    "PaperlessBilling": _pick("c_nationkey", "Yes", "No"),
    "PaymentMethod": _pick(
        "c_nationkey", "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)", "Cash"
    ),
    "MonthlyCharges": "CASE WHEN c_acctbal < -800 THEN '' "
    "ELSE CAST(CAST(round(MonthlyCharges * 4, 5) AS DECIMAL(14,5)) AS STRING) END",
    "TotalCharges": "CASE WHEN c_nationkey = 3 THEN ' ' WHEN c_nationkey = 4 THEN 'n/a' WHEN c_acctbal < -700 "
    "THEN '-12.5' ELSE CAST(CAST(round(TotalCharges * 4, 5) AS DECIMAL(14,5)) AS STRING) END",
}


def raw_subscribers(spark: SparkSession, folder: str) -> DataFrame:
    """The subscriber table as an uncleaned text export, plus its key and label."""
    base = subscribers(spark, folder)
    return base.select(
        "customer_id", *[F.expr(sql).alias(name) for name, sql in RAW_FIELDS.items()], F.col("Churn")
    )


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scoring records: monthly batches per model, with the later outcome in the status."""
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("model_version"),
        F.trunc("o_orderdate", "month").alias("batch_month"),
        "o_orderdate",
        "o_totalprice",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("known_status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("actual"),
    )
