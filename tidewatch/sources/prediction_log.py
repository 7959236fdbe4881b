"""Append-only log of prediction batches as nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = """
  timestamp timestamp_ntz, model_version string, batch_size bigint,
  prediction_stats struct<positive_rate: double, negative_rate: double, unique_predictions: bigint>,
  probability_stats struct<mean_probability: double, std_probability: double, min_probability: double,
    max_probability: double, high_confidence_rate: double, low_confidence_rate: double>,
  input_stats struct<feature_count: bigint, missing_rate: double, numeric_feature_means: map<string, double>>
"""


def append(stats: DataFrame, path: str) -> str:
    """Add batch rows; older rows are never rewritten (readers keep the newest they need)."""
    stats.select(F.col("timestamp"), *[c for c in stats.columns if c != "timestamp"]).write.mode("append").json(path)
    return path


def read(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``multi_line`` reads a single pretty-printed array of entries."""
    return spark.read.schema(LOG_SCHEMA).option("multiLine", multi_line).json(path)
