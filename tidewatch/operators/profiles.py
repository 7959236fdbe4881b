"""Profiles that are kept per part of a table and merged for any set of parts.

A part (a day, a month, a delivery) is scanned once. What is kept of each of its columns is a row of
bounded size: counts, a HyperLogLog sketch of the distinct values and a sketch of the frequent ones.
Any range of parts is then profiled from these rows alone. A part that is delivered again
replaces its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.quality import value_counts
from tidewatch.session import materialize

DISTINCT_BITS = 14  # 2^14 registers: a relative standard error of about 0.8 %
TRACKED = 1_000  # frequent values of a part and column that are kept


def profile(df: DataFrame, part: str, columns: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """``(part, column, n_rows, n_missing, distinct_sketch, top_sketch)``; values are compared as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    longform = df.select(F.col(part).alias("part"), F.inline(F.array(*pairs)))
    return longform.groupBy("part", "column").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.hll_sketch_agg("value", F.lit(DISTINCT_BITS)).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {int(tracked)}) FILTER (WHERE value IS NOT NULL)").alias("top_sketch"),
    )


def save_profile(profiles: DataFrame, path: str) -> None:
    """Write profiles by part; parts that are already there are replaced, others stay."""
    (
        profiles.repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """Stored profiles; a condition on ``part`` prunes folders."""
    return spark.read.parquet(path)


def merged_profile(profiles: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One row a column over all given parts: ``(column, n_rows, n_missing, n_distinct, top_sketch)``.

    Counts are exact, ``n_distinct`` is the estimate of the merged sketch.
    """
    return profiles.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.expr(f"approx_top_k_combine(top_sketch, {int(tracked)})").alias("top_sketch"),
    )


def candidate_values(merged: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``(column, value, outside)``: frequent values by the merged sketch, and the most rows any other value can have.

    A value that the sketch does not hold has at most 3.5 / slots of the rows, one that it holds but does not name
    at most twice that; of a list that is cut at ``tracked`` values the smallest estimate bounds the rest. A list
    that accounts for all rows leaves nothing outside.
    """
    slots = 2 ** math.ceil(math.log2(tracked / 0.75))
    present = F.col("n_rows") - F.col("n_missing")
    listed = merged.select(
        "column", present.alias("present"), F.expr(f"approx_top_k_estimate(top_sketch, {int(tracked)})").alias("list")
    )
    total = F.aggregate("list", F.lit(0).cast("bigint"), lambda s, x: s + x["count"])
    doubt = F.ceil(F.lit(7.0 / slots) * F.col("present")).cast("bigint")
    cut = F.when(F.size("list") >= tracked, F.array_min(F.transform("list", lambda x: x["count"])))
    outside = F.when((F.size("list") < tracked) & (total == F.col("present")), F.lit(0)).otherwise(
        F.greatest(doubt, F.coalesce(cut, F.lit(0)))
    )
    return listed.select("column", outside.cast("bigint").alias("outside"), F.inline("list")).select(
        "column", F.col("item").alias("value"), "outside"
    )


def top_values(
    profiles: DataFrame, source: DataFrame, columns: Sequence[str], k: int = 5, tracked: int = TRACKED
) -> DataFrame:
    """``(column, value, n, rank)``: the exact k most frequent values of the parts, ties by value.

    ``source`` holds the rows of the same parts. The sketches name the candidates, one scan counts these (nothing
    but candidates is shuffled), and a column's answer stands if its kth count is above what any other value can
    have. Columns without such frequent values are counted in full.
    """
    names = list(columns)
    merged = merged_profile(profiles.where(F.col("column").isin(names)), tracked)
    found = materialize(candidate_values(merged, tracked))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names]
    counts = materialize(
        source.select(F.inline(F.array(*pairs)))
        .join(F.broadcast(found), ["column", "value"])  # at most `tracked` values a column
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.max("outside").alias("outside"))
    )
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # One row a column reaches the driver.
    checks = ranked.groupBy("column").agg(
        F.count("*").alias("listed"), F.min("n").alias("least"), F.max("outside").alias("outside")
    )
    sure = {
        r["column"] for r in checks.collect() if r["outside"] == 0 or (r["listed"] == k and r["least"] > r["outside"])
    }
    result = ranked.where(F.col("column").isin(list(sure))).select("column", "value", "n", "rank")
    rest = [c for c in names if c not in sure]
    if rest:
        full = value_counts(source, rest).where(F.col("value").isNotNull())
        full = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        result = result.unionByName(full.select("column", "value", "n", "rank"))
    return result
