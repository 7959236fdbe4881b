"""Checks of a table and of single records against declared fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import BOOLEAN_LIKE, parse_number
from tidewatch.functions.schema import BOOLEAN, CATEGORICAL, NUMERIC, STRING, Field, of_kind
from tidewatch.operators.ordered import unpivot_numeric
from tidewatch.operators.quality import iqr_bounds, is_missing, value_counts

# Warning limits.
HIGH_CARDINALITY = 50
LONG_TEXT = 1000
OUTLIER_SHARE = 0.05

# Limits and messages of the checks on a scoring input.
MAX_TENURE = 100
MAX_MONTHLY = 1000
MAX_MISSING_RATIO = 0.1
NEGATIVE_MESSAGE = "Negative values found in %s"
TENURE_MESSAGE = "Tenure values > 100 months found"
MONTHLY_MESSAGE = "Monthly charges > $1000 found"
RATIO_MESSAGE = "High missing value ratio: %.1f%%"


def _finding(field: str, rule: str, severity: str, n: Column) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("n"),
    )


def column_findings(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Missing required columns (error) and undeclared columns (warning)."""
    absent = [f.name for f in fields if f.required and f.name not in df.columns]
    extra = [c for c in df.columns if c not in {f.name for f in fields}]
    rows = [(c, "missing_field", "error", 1) for c in absent] + [(c, "extra_field", "warning", 1) for c in extra]
    return df.sparkSession.createDataFrame(rows, "field string, rule string, severity string, n bigint")


def cell_findings(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Counts of every per-cell rule, all fields in one pass; rules with no hit are left out.

    Range rules of a numeric field are skipped while it holds text that is not a number.
    """
    aggs, rows = [], []

    def count(name: str, condition: Column) -> Column:
        aggs.append(F.count_if(condition).alias(name))
        return F.col(name)

    for f in [f for f in fields if f.name in df.columns]:
        c, missing = F.col(f.name), is_missing(df, f.name)
        if not f.nullable:
            rows.append(_finding(f.name, "null", "error", count(f"null_{f.name}", missing)))
        if f.kind == NUMERIC:
            number = parse_number(c.cast("string"))
            bad = count(f"bad_{f.name}", ~missing & number.isNull())
            rows.append(_finding(f.name, "not_numeric", "error", bad))
            for rule, limit, test in (
                ("below_minimum", f.low, number < f.low if f.low is not None else None),
                ("above_maximum", f.high, number > f.high if f.high is not None else None),
            ):
                if limit is not None:
                    hits = count(f"{rule}_{f.name}", test)
                    rows.append(_finding(f.name, rule, "error", F.when(bad == 0, hits).otherwise(F.lit(0))))
        elif f.kind == CATEGORICAL and f.allowed:
            hits = count(f"unlisted_{f.name}", ~missing & ~c.isin(list(f.allowed)))
            rows.append(_finding(f.name, "invalid_value", "error", hits))
        elif f.kind == BOOLEAN:
            hits = count(f"notbool_{f.name}", ~missing & ~c.cast("string").isin(BOOLEAN_LIKE))
            rows.append(_finding(f.name, "not_boolean", "error", hits))
        elif f.kind == STRING:
            rows.append(_finding(f.name, "empty_text", "warning", count(f"empty_{f.name}", c == "")))
            aggs.append(F.max(F.length(c)).alias(f"longest_{f.name}"))
            longest = F.col(f"longest_{f.name}")
            rows.append(_finding(f.name, "long_text", "warning", F.when(longest > LONG_TEXT, longest).otherwise(0)))
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("n") > 0)


def invalid_values(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Every value outside the list of its categorical or boolean field, with its count."""
    checked = [
        (f.name, list(f.allowed) if f.kind == CATEGORICAL else BOOLEAN_LIKE)
        for f in fields
        if f.name in df.columns and ((f.kind == CATEGORICAL and f.allowed) or f.kind == BOOLEAN)
    ]
    unlisted = F.lit(False)
    for name, allowed in checked:
        unlisted = unlisted | ((F.col("column") == name) & ~F.col("value").isin(allowed))
    counts = value_counts(df, [name for name, _ in checked])
    return counts.where(F.col("value").isNotNull() & unlisted).select(F.col("column").alias("field"), "value", "n")


def cardinality_warnings(df: DataFrame, fields: Sequence[Field], limit: int = HIGH_CARDINALITY) -> DataFrame:
    names = [f.name for f in of_kind(list(fields), CATEGORICAL, df.columns)]
    return (
        value_counts(df, names)
        .groupBy("column")
        .agg(F.count("value").alias("n"))
        .where(F.col("n") > limit)
        .select(
            F.col("column").alias("field"),
            F.lit("high_cardinality").alias("rule"),
            F.lit("warning").alias("severity"),
            "n",
        )
    )


def outlier_warnings(
    df: DataFrame, fields: Sequence[Field], width: float = 3.0, share: float = OUTLIER_SHARE
) -> DataFrame:
    """Numeric fields with more than ``share`` of their values outside the wide IQR fence.

    As with the range rules, a field that holds text that is not a number is skipped.
    """
    names = [f.name for f in of_kind(list(fields), NUMERIC, df.columns)]
    bad = [F.count_if(~is_missing(df, c) & parse_number(F.col(c).cast("string")).isNull()).alias(c) for c in names]
    broken = df.agg(*bad).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) > 0).alias("broken")) for c in names]))
    )
    numbers = df.select(*[parse_number(F.col(c).cast("string")).alias(c) for c in names])
    bounds = iqr_bounds(numbers, names, width).join(F.broadcast(broken), "column")
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    return (
        unpivot_numeric(numbers, names)
        .where(F.col("value").isNotNull())
        .join(F.broadcast(bounds), "column")  # one row per field
        .where(~F.col("broken"))
        .groupBy("column")
        .agg(F.count_if(outside).alias("n"), F.count("*").alias("total"))
        .where(F.col("n") > share * F.col("total"))
        .select(
            F.col("column").alias("field"), F.lit("outliers").alias("rule"), F.lit("warning").alias("severity"), "n"
        )
    )


def validate(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """All findings; the table is valid when none of them is an error."""
    return (
        column_findings(df, fields)
        .unionByName(cell_findings(df, fields))
        .unionByName(cardinality_warnings(df, fields))
        .unionByName(outlier_warnings(df, fields))
    )


def verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("valid"),
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )


def record_issues(df: DataFrame, fields: Sequence[Field]) -> Column:
    """Array of the broken rules of one record."""
    checks = []

    def issue(condition: Column, name: str, text: str) -> None:
        checks.append(F.when(condition, F.lit(f"{name}: {text}")))

    for f in [f for f in fields if f.name in df.columns]:
        c, missing = F.col(f.name), is_missing(df, f.name)
        if not f.nullable:
            issue(missing, f.name, "null")
        if f.kind == NUMERIC:
            number = parse_number(c.cast("string"))
            issue(~missing & number.isNull(), f.name, "not numeric")
            if f.low is not None:
                issue(number < f.low, f.name, "below minimum")
            if f.high is not None:
                issue(number > f.high, f.name, "above maximum")
        elif f.kind == CATEGORICAL and f.allowed:
            issue(~missing & ~c.isin(list(f.allowed)), f.name, "invalid value")
        elif f.kind == BOOLEAN:
            issue(~missing & ~c.cast("string").isin(BOOLEAN_LIKE), f.name, "not boolean")
        elif f.kind == STRING:
            issue(c == "", f.name, "empty text")
    return F.array_compact(F.array(*checks))


def record_verdicts(df: DataFrame, fields: Sequence[Field], key: str) -> DataFrame:
    """``(key, valid, issues)``; empty text is only a warning."""
    issues = record_issues(df, fields)
    errors = F.filter(issues, lambda m: ~m.endswith(": empty text"))
    return df.select(key, (F.size(errors) == 0).alias("valid"), issues.alias("issues"))


def split_requests(df: DataFrame, fields: Sequence[Field]) -> tuple[DataFrame, DataFrame]:
    """Records that keep every limit, and the rejected ones with their reasons."""
    marked = df.withColumn("reasons", record_issues(df, fields))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def batch_rules(df: DataFrame) -> DataFrame:
    """Table-level rules for a scoring input: one row per rule that is broken, plus the quality score."""
    columns = ["tenure", "MonthlyCharges", "TotalCharges"]
    missing = sum((F.count_if(is_missing(df, c)) for c in columns[1:]), F.count_if(is_missing(df, columns[0])))
    wide = df.agg(
        *[F.coalesce(F.bool_or(F.col(c) < 0), F.lit(False)).alias(f"neg_{c}") for c in columns],
        F.coalesce(F.bool_or(F.col("tenure") > MAX_TENURE), F.lit(False)).alias("long_tenure"),
        F.coalesce(F.bool_or(F.col("MonthlyCharges") > MAX_MONTHLY), F.lit(False)).alias("high_bill"),
        F.coalesce(F.try_divide(missing, F.count("*") * F.lit(len(columns))), F.lit(0.0)).alias("missing_ratio"),
    )
    issues = F.array_compact(
        F.array(
            *[F.when(F.col(f"neg_{c}"), F.lit(NEGATIVE_MESSAGE % c)) for c in columns],
            F.when(F.col("long_tenure"), F.lit(TENURE_MESSAGE)),
            F.when(F.col("high_bill"), F.lit(MONTHLY_MESSAGE)),
            F.when(
                F.col("missing_ratio") > MAX_MISSING_RATIO,
                F.format_string(RATIO_MESSAGE, F.col("missing_ratio") * 100),
            ),
        )
    )
    return wide.select(
        (F.size(issues) == 0).alias("valid"),
        F.array_join(issues, "; ").alias("issues"),
        (1 - F.col("missing_ratio")).alias("quality_score"),
    )
