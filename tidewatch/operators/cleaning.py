"""Cleaning of raw tables: coercion, sanitizing, fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.columns import clip, keep_allowed, parse_number, to_boolean
from tidewatch.functions.schema import BOOLEAN, CATEGORICAL, NUMERIC, Field
from tidewatch.operators.ordered import nan_to_null, quantile_row
from tidewatch.operators.quality import value_counts


def sanitized(f: Field) -> Column:
    if f.kind == NUMERIC:
        return clip(parse_number(F.col(f.name).cast("string")), f.low, f.high)
    if f.kind == CATEGORICAL and f.allowed:
        return keep_allowed(f.name, f.allowed)
    if f.kind == BOOLEAN:
        return to_boolean(f.name)
    return F.col(f.name)


def sanitize(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Coerce, clip and blank out values by field; other columns pass through. One projection."""
    rules = {f.name: sanitized(f) for f in fields}
    return df.select(*[rules.get(c, F.col(c)).alias(c) for c in df.columns])


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    return df.na.fill(value, subset=list(columns))


def fill_median(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Fill missing numbers with the column median."""
    medians = quantile_row(df, columns, 0.5, approx)
    filled = {c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"q_{c}")) for c in columns}
    return df.join(F.broadcast(medians)).select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])  # one row


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(column, mode)``: the most frequent value, the smallest one on a tie.

    Values are counted first, so no task holds a column's value map; Spark then
    keeps one candidate per task and column before the shuffle.
    """
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == 1)
        .select("column", F.col("value").alias("mode"))
    )


def fill_mode(df: DataFrame, columns: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """Fill missing text with the column mode, or ``unknown`` when the column is empty."""
    wide = modes(df, columns).agg(
        *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"m_{c}") for c in columns]
    )
    filled = {c: F.coalesce(c, F.col(f"m_{c}"), F.lit(unknown)) for c in columns}
    return df.join(F.broadcast(wide)).select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])  # one row


def clean(df: DataFrame, numeric_text: Sequence[str], numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Parse number columns held as text, then fill medians and modes."""
    parsed = df.withColumns({c: parse_number(c) for c in numeric_text})
    return fill_mode(fill_median(parsed, [*numeric_text, *numbers]), texts)
