"""Statistics of prediction batches, health checks, degradation and alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.functions.columns import HIGH_RISK, MEDIUM_RISK, divide_or_zero, hard_label
from tidewatch.operators.drift import psi, psi_report
from tidewatch.operators.evaluation import threshold_performance
from tidewatch.operators.ordered import nan_to_null, running_totals
from tidewatch.operators.quality import duplicate_rows, is_missing, null_profile, quantile_columns

# Retention, history and thresholds.
LOG_ENTRIES = 1000
CHECK_SCHEMA = "check string, passed boolean, message string, severity string"
CHECK_FAILED = "Check failed: %s: %s"
HISTORY_BATCHES = 10
ACCURACY_DROP = 0.05
DASHBOARD_BATCHES = 100
ALERT_HOURS = 24
MANY_FEATURES = 2
LARGE_DROP = 0.1
HIGH_RISK_SPIKE = 0.2
MAX_MISSING_RATE = 0.5
MAX_DUPLICATE_RATE = 0.1
POSITIVE_RATE_RANGE = (0.05, 0.5)

# Message formats, actions and recommendations.
DRIFT_MESSAGE = "Data drift detected in features: %s"
DRIFT_ACTION = "Consider model retraining"
DEGRADED_MESSAGE = "Model performance degraded by %.3f"
DEGRADED_ACTION = "Investigate and potentially retrain model"
SPIKE_MESSAGE = "Unusually high churn risk detected: %.1f%% high risk customers"
SPIKE_ACTION = "Investigate business conditions and customer behavior"
MISSING_MESSAGE = "High missing data rate: %.1f%%"
DUPLICATE_MESSAGE = "High duplicate rate: %.1f%%"
QUALITY_FINE = "Data quality within acceptable bounds"
RATE_MESSAGE = "Unusual prediction distribution: %.1f%% positive rate"
RATE_FINE = "Prediction distribution normal"
CRITICAL_ADVICE = "Immediate action required - investigate alerts and consider model rollback"
WARNING_ADVICE = "Monitor closely and prepare for potential intervention"
HEALTHY_ADVICE = "System operating normally"

CHUNK = 100_000  # batches per task when degradation is computed on dense batch numbers


def batch_stats(df: DataFrame, by: Sequence[str], p: str, features: Sequence[str]) -> DataFrame:
    """One prediction-log row per batch, combined map-side."""
    label, prob = hard_label(p), F.col(p)
    n = F.count("*")
    missing = sum((F.count_if(is_missing(df, c)) for c in features[1:]), F.count_if(is_missing(df, features[0])))
    means = F.map_from_arrays(
        F.array(*[F.lit(c) for c in features]),
        F.array(*[F.avg(nan_to_null(F.col(c).cast("double"))) for c in features]),
    )
    return df.groupBy(*by).agg(
        n.alias("batch_size"),
        F.struct(
            F.avg(label).alias("positive_rate"),
            (1 - F.avg(label)).alias("negative_rate"),
            ((F.count_if(label == 1) > 0).cast("bigint") + (F.count_if(label == 0) > 0).cast("bigint")).alias(
                "unique_predictions"
            ),
        ).alias("prediction_stats"),
        F.struct(
            F.avg(prob).alias("mean_probability"),
            F.stddev_pop(prob).alias("std_probability"),
            F.min(prob).alias("min_probability"),
            F.max(prob).alias("max_probability"),
            F.avg((prob > 0.8).cast("int")).alias("high_confidence_rate"),
            F.avg((prob < 0.2).cast("int")).alias("low_confidence_rate"),
        ).alias("probability_stats"),
        F.struct(
            F.lit(len(features)).cast("bigint").alias("feature_count"),
            F.try_divide(missing, n * F.lit(len(features))).alias("missing_rate"),
            means.alias("numeric_feature_means"),
        ).alias("input_stats"),
    )


def band_rates(p: Column, medium: float = MEDIUM_RISK, high: float = HIGH_RISK) -> list[Column]:
    total = F.count("*")
    return [
        total.alias("total_predictions"),
        divide_or_zero(F.count_if(p >= high), total).alias("high_risk_rate"),
        divide_or_zero(F.count_if((p >= medium) & (p < high)), total).alias("medium_risk_rate"),
        divide_or_zero(F.count_if(p < medium), total).alias("low_risk_rate"),
        F.avg(p).alias("avg_prediction"),
        F.stddev_pop(p).alias("prediction_std"),
    ]


def prediction_distribution(df: DataFrame, p: str) -> DataFrame:
    """Band rates, mean, population std and five quantiles of one batch."""
    probs = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    points = quantile_columns(df, [p], probs).drop("column")
    return df.agg(*band_rates(F.col(p))).join(F.broadcast(points))  # one row each


def batch_performance(df: DataFrame, by: Sequence[str], p: str, actual: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *threshold_performance(F.col(p), F.col(actual)))


def with_halo(df: DataFrame, bucket: Column, carried: Column) -> DataFrame:
    """Rows with ``_bucket`` and ``_own``; those ``carried`` stand once more, not owned, in the bucket after theirs."""
    own = F.struct(bucket.alias("bucket"), F.lit(True).alias("own"))
    again = F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))
    places = F.when(carried, F.array(own, again)).otherwise(F.array(own))
    return df.withColumn("_place", F.explode(places)).select(
        *df.columns, F.col("_place.bucket").alias("_bucket"), F.col("_place.own").alias("_own")
    )


def degradation(
    history: DataFrame,
    by: Sequence[str],
    order: str,
    drop: float = ACCURACY_DROP,
    dense: bool = False,
    long: bool = False,
) -> DataFrame:
    """Compare each batch's accuracy with the mean of the previous ten; the first is never degraded.

    ``dense=True`` says that ``order`` counts 1, 2, 3… within ``by``; ``long=True`` numbers batches of any
    spacing first, range by range. Either way the history is cut into chunks that carry
    the last ten batches of the chunk before, so that a very long history is not one task.
    """
    by = list(by)
    number = F.col(order)
    if long:
        key = [F.struct(*by).alias("_key")] if by else []  # a struct compares null keys as equal
        counts = history.groupBy(*key, F.col(order).alias("_at")).agg(F.count("*").alias("_n"))
        numbers = running_totals(counts, "_at", ["_n"], ["_key"] if by else []).withColumnRenamed("run__n", "_number")
        same = F.col(order) == F.col("_at")
        if by:
            same = same & (F.struct(*by) == F.col("_key"))
        columns, number = history.columns, F.col("_number")
        history = history.join(numbers, same).select(*columns, "_number")
    if dense or long:
        tail = number % CHUNK >= CHUNK - HISTORY_BATCHES
        placed, groups = with_halo(history, F.floor(number / CHUNK), tail), [*by, "_bucket"]
    else:
        placed, groups = history.withColumn("_own", F.lit(True)), by
    if long:
        history = history.drop("_number")
    previous = Window.partitionBy(*groups).orderBy(order).rowsBetween(-HISTORY_BATCHES, -1)
    recent = F.avg("accuracy").over(previous)
    return (
        placed.withColumn("recent_accuracy", recent)
        .where("_own")
        .select(
            *history.columns,
            "recent_accuracy",
            F.coalesce(F.col("accuracy") < F.col("recent_accuracy") - drop, F.lit(False)).alias("degraded"),
        )
        .withColumn(
            "degradation_amount",
            F.when(F.col("degraded"), F.col("recent_accuracy") - F.col("accuracy")).otherwise(F.lit(0.0)),
        )
    )


def divide_or_null(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def newest(df: DataFrame, ts: str, n: int, *tie: str) -> DataFrame:
    """The newest n rows (Spark keeps only n per task before the merge)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie]).limit(n)


def newest_per_group(df: DataFrame, by: Sequence[str], ts: str, n: int, *tie: str) -> DataFrame:
    """The newest n rows of each group; rows of equal time by ``tie``, or else by all their sortable columns."""
    plain = (T.AtomicType, T.NullType)
    tie = tie or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, plain) and f.name not in {*by, ts})
    order = Window.partitionBy(*by).orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie])
    return df.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= n).drop("_row")


def within_hours(df: DataFrame, ts: str, asof: Column, hours: int = ALERT_HOURS) -> DataFrame:
    """Rows strictly newer than ``asof`` minus the window, and not after ``asof``."""
    return df.where((F.col(ts) > asof - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= asof))


def volume_trend(log: DataFrame, ts: str, *tie: str) -> DataFrame:
    """Mean batch size of the second half of a log against the first half, over all its rows.

    Rows of equal time and ties are added up first and share their places evenly, so
    a log of any length is numbered range by range.
    """
    at = log.groupBy(F.struct(ts, *tie).alias("_at")).agg(
        F.count("*").alias("_rows"), F.sum("batch_size").alias("_size")
    )
    half = F.floor(F.col("all__rows") / 2)
    before = F.col("run__rows") - F.col("_rows")
    in_first = F.greatest(F.lit(0), F.least(F.col("_rows"), half - before))
    mean_size = F.col("_size") / F.col("_rows")
    return running_totals(at, "_at", ["_rows"]).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("batch_count"),
        divide_or_null(F.sum(mean_size * in_first), F.sum(in_first)).alias("first_half"),
        divide_or_null(F.sum(mean_size * (F.col("_rows") - in_first)), F.sum(F.col("_rows") - in_first)).alias("second_half"),
    ).withColumn(
        "prediction_volume_trend",
        F.when(F.col("batch_count") < 2, F.lit("insufficient_data"))
        .when(F.col("second_half") > F.col("first_half") * 1.1, F.lit("increasing"))
        .when(F.col("second_half") < F.col("first_half") * 0.9, F.lit("decreasing"))
        .otherwise(F.lit("stable")),
    )


def recent_stats(log: DataFrame, asof: Column, hours: int = ALERT_HOURS) -> DataFrame:
    """Totals over the last hours, however many batches they hold; the positive rate is averaged over batches, not rows."""
    recent = within_hours(log, "timestamp", asof, hours)
    totals = recent.agg(
        F.lit(hours).cast("bigint").alias("time_window_hours"),
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("total_predictions"),
        F.avg("prediction_stats.positive_rate").alias("average_positive_rate"),
    )
    trend = volume_trend(recent, "timestamp", "model_version").select("batch_count", "prediction_volume_trend")
    return totals.join(F.broadcast(trend))  # one row each


def rolling_stats(log: DataFrame, by: Sequence[str], ts: str, hours: int = 24) -> DataFrame:
    """For every log row, totals over the hours before it (inclusive), bucket by bucket of time."""
    width = hours * 3600
    timed = log.withColumn("_seconds", F.col(ts).cast("timestamp").cast("long"))
    at = F.col("_seconds")
    # A bucket is as long as the window, so a row looks back into the bucket before its own at most.
    placed = with_halo(timed, F.floor(at / width), F.pmod(at, F.lit(width)) > 0)
    span = Window.partitionBy(*by, "_bucket").orderBy("_seconds").rangeBetween(-width + 1, 0)
    return placed.select(
        "_own",
        *by,
        ts,
        F.sum("batch_size").over(span).alias("total_predictions"),
        F.count("*").over(span).alias("batch_count"),
        F.avg("prediction_stats.positive_rate").over(span).alias("average_positive_rate"),
    ).where("_own").drop("_own")


# Health checks: every check is a one-row table (check, passed, message, severity).


def _check(name: str, problem: Column, fine: str) -> list[Column]:
    return [
        F.lit(name).alias("check"),
        problem.isNull().alias("passed"),
        F.coalesce(problem, F.lit(fine)).alias("message"),
        F.when(problem.isNotNull(), F.lit("warning")).alias("severity"),
    ]


def data_quality_check(df: DataFrame) -> DataFrame:
    nulls = null_profile(df).agg((F.avg("pct_missing") / 100).alias("missing_rate"))
    copies = duplicate_rows(df).select(divide_or_zero(F.col("n_duplicates"), F.col("n_rows")).alias("duplicate_rate"))
    problem = F.when(
        F.col("missing_rate") > MAX_MISSING_RATE, F.format_string(MISSING_MESSAGE, F.col("missing_rate") * 100)
    ).when(
        F.col("duplicate_rate") > MAX_DUPLICATE_RATE, F.format_string(DUPLICATE_MESSAGE, F.col("duplicate_rate") * 100)
    )
    return nulls.join(F.broadcast(copies)).select(  # one row each
        *_check("data_quality", problem, QUALITY_FINE)
    )


def prediction_rate_check(
    df: DataFrame, p: str, low: float = POSITIVE_RATE_RANGE[0], high: float = POSITIVE_RATE_RANGE[1]
) -> DataFrame:
    rate = df.agg(F.avg(hard_label(p)).alias("rate"))
    problem = F.when(
        (F.col("rate") < low) | (F.col("rate") > high),
        F.format_string(RATE_MESSAGE, F.col("rate") * 100),
    )
    return rate.select(*_check("prediction_distribution", problem, RATE_FINE))


def degradation_check(history: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Fails when the newest batch of any model is degraded."""
    last = newest_per_group(degradation(history, by, order), by, order, 1)
    amount = last.agg(F.max(F.when(F.col("degraded"), F.col("degradation_amount"))).alias("worst"))
    problem = F.when(F.col("worst").isNotNull(), F.format_string("Accuracy dropped by %.3f", F.col("worst")))
    return amount.select(*_check("performance_degradation", problem, "No degradation"))


def overall_status(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.agg(
        F.count("*").alias("n_checks"),
        F.count_if(failed).alias("n_alerts"),
        F.when(F.coalesce(F.bool_or(failed & (F.col("severity") == "error")), F.lit(False)), F.lit("unhealthy"))
        .when(F.coalesce(F.bool_or(failed), F.lit(False)), F.lit("degraded"))
        .otherwise(F.lit("healthy"))
        .alias("overall_status"),
    )


def health_check(spark: SparkSession, checks: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run named checks; the caller may plug in any function that returns a table of the same shape.

    A check that raises becomes a failed row of severity ``error`` with the message of
    its exception, and the others go on. Checks have one row, so each is read as it runs.
    """
    rows = []
    for name, check in checks.items():
        try:
            found = check().select("passed", "message", "severity").collect()
            rows += [(name, *r) for r in found]
        except Exception as error:  # a broken check is a finding, not the end of the report
            first_line = str(error).strip().split("\n")[0]
            rows.append((name, False, CHECK_FAILED % (type(error).__name__, first_line[:200]), "error"))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


# Alerts


def alerts(metrics: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Alert rows from batch metrics ``drifted_features, degraded, degradation_amount, high_risk_rate``."""

    def alert(kind: str, severity: Column, message: Column, action: str) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            severity.alias("severity"),
            message.alias("message"),
            F.lit(action).alias("action_required"),
        )

    drifted = F.col("drifted_features")
    found = F.array_compact(
        F.array(
            F.when(
                F.size(drifted) > 0,
                alert(
                    "DATA_DRIFT",
                    F.when(F.size(drifted) > MANY_FEATURES, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
                    F.format_string(DRIFT_MESSAGE, F.array_join(drifted, ", ")),
                    DRIFT_ACTION,
                ),
            ),
            F.when(
                F.col("degraded"),
                alert(
                    "PERFORMANCE_DEGRADATION",
                    F.when(F.col("degradation_amount") > LARGE_DROP, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
                    F.format_string(DEGRADED_MESSAGE, F.col("degradation_amount")),
                    DEGRADED_ACTION,
                ),
            ),
            F.when(
                F.col("high_risk_rate") > HIGH_RISK_SPIKE,
                alert(
                    "HIGH_RISK_SPIKE",
                    F.lit("HIGH"),
                    F.format_string(SPIKE_MESSAGE, F.col("high_risk_rate") * 100),
                    SPIKE_ACTION,
                ),
            ),
        )
    )
    return metrics.select(*keys, F.col(ts).alias("timestamp"), F.inline(found))


def route_alerts(found: DataFrame) -> DataFrame:
    """Only HIGH alerts are stored; some trigger a response."""
    return found.where(F.col("severity") == "HIGH").withColumn(
        "response",
        F.when(F.col("type") == "DATA_DRIFT", F.lit("schedule_retraining")).when(
            F.col("type") == "PERFORMANCE_DEGRADATION", F.lit("flag_for_review")
        ),
    )


def active_alerts(found: DataFrame, asof: Column, hours: int = ALERT_HOURS) -> DataFrame:
    """Alerts younger than ``hours`` at ``asof``."""
    return within_hours(found, "timestamp", asof, hours)


def system_health(active: DataFrame) -> DataFrame:
    status = active.agg(
        F.count("*").alias("n_active"),
        F.when(F.coalesce(F.bool_or(F.col("severity") == "HIGH"), F.lit(False)), F.lit("CRITICAL"))
        .when(F.count("*") > 0, F.lit("WARNING"))
        .otherwise(F.lit("HEALTHY"))
        .alias("status"),
    )
    advice = F.create_map(
        *[F.lit(text) for text in ("CRITICAL", CRITICAL_ADVICE, "WARNING", WARNING_ADVICE, "HEALTHY", HEALTHY_ADVICE)]
    )
    return status.withColumn("recommendation", F.element_at(advice, F.col("status")))


def dashboard(metrics: DataFrame, stored: DataFrame, ts: str, asof: Column, *tie: str) -> DataFrame:
    """Summary over all batches, the newest of them, and the active alerts."""
    recent = newest(metrics, ts, DASHBOARD_BATCHES, *tie).agg(
        F.count_if(F.size("drifted_features") > 0).alias("drift_detected_batches"),
        F.count_if("degraded").alias("performance_issues"),
    )
    total = metrics.agg(F.count("*").alias("total_monitored_batches"))
    active = active_alerts(stored, asof).agg(F.count("*").alias("active_alerts"))
    return total.join(F.broadcast(recent)).join(F.broadcast(active))  # one row each


def monitor_batches(
    df: DataFrame,
    batch: str,
    baseline: DataFrame,
    features: Sequence[str],
    p: str,
    actual: str | None = None,
    dense: bool = True,
) -> DataFrame:
    """Drift, prediction distribution, performance and degradation per batch in one table."""
    drift = psi_report(psi(df, baseline, features, by=[batch]), by=[batch])
    aggregates = band_rates(F.col(p))
    if actual:
        aggregates += threshold_performance(F.col(p), F.col(actual))
    rates = df.groupBy(batch).agg(*aggregates)
    if actual:
        rates = degradation(rates, [], batch, dense=dense) if dense else degradation(rates, [], batch)
    else:
        rates = rates.withColumns({"degraded": F.lit(False), "degradation_amount": F.lit(0.0)})
    return rates.join(drift, batch, "left").withColumns(
        {
            "drifted_features": F.coalesce("drifted_features", F.array().cast("array<string>")),
            "drift_detected": F.coalesce("drift_detected", F.lit(False)),
        }
    )


def throughput(log: DataFrame) -> DataFrame:
    """Totals over a scoring log with ``batch_size`` and ``seconds``."""
    return log.agg(
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_inference_time"),
    ).withColumn(
        "average_time_per_prediction_ms",
        divide_or_zero(F.col("total_inference_time"), F.col("total_predictions")) * 1000,
    )
