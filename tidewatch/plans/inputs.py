"""Inputs shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.cleaning import parse_number
from tidewatch.operators.scoring import (
    ORDER_INTERCEPT,
    ORDER_WEIGHTS,
    add_bands,
    add_business_columns,
    score_linear,
)
from tidewatch.sources.tables import order_features, raw_subscribers, subscribers, table

NUMBERS = ["tenure", "MonthlyCharges", "TotalCharges"]
SPLIT_DATE = "1998-07-01 00:00:00"
MIDDLE_DATE = "2024-01-16 00:00:00"


def scored_subscribers(spark: SparkSession, folder: str) -> DataFrame:
    return add_bands(score_linear(subscribers(spark, folder)))


def business_subscribers(spark: SparkSession, folder: str) -> DataFrame:
    return add_business_columns(scored_subscribers(spark, folder))


def parsed_subscribers(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_subscribers(spark, folder)
    return raw.select("customer_id", *[parse_number(c).alias(c) for c in NUMBERS])


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    return score_linear(order_features(spark, folder), ORDER_INTERCEPT, ORDER_WEIGHTS, "p")


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items where a zero discount or tax, or flag N, counts as not recorded."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        "l_linestatus",
        "l_shipdate",
    )


def shipped_before_after(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = gappy_lineitem(spark, folder)
    limit = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return rows.where(F.col("l_shipdate") < limit), rows.where(F.col("l_shipdate") >= limit)


def events_halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All events, cut at the middle of the month, with type and whole-number class of value as one category.

    Rare classes of value turn up in one half alone, so new and vanished categories are real ones.
    """
    rows = table(spark, folder, "events").select(
        "ts",
        F.concat_ws(" ", "event_type", F.floor(F.col("value") / 25).cast("string")).alias("event_type"),
        "value",
        "user_id",
    )
    middle = F.lit(MIDDLE_DATE).cast("timestamp_ntz")
    return rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle)


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Ten class scores per vector, the true label and the class with the largest score.

    The score of class c adds up every tenth component from the c-th on, so the
    whole vector counts; six decimals make sums independent of their order.
    """
    vector = F.col("embedding").cast("array<double>")
    score = lambda c: F.round(
        F.aggregate(F.filter(vector, lambda x, i: i % 10 == c), F.lit(0.0), lambda a, x: a + x), 6
    )
    rows = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.array(*[score(c) for c in range(10)]).alias("scores")
    )
    return rows.withColumn("pred", F.array_position("scores", F.array_max("scores")) - 1)
