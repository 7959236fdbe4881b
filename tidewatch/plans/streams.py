"""Streaming jobs run to completion over the tables; the SQL twins are their batch forms.

Append mode emits a window or session once the watermark has passed its end, so
the twins keep those that end by max(ts) minus the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.schema import NUMERIC, Field
from tidewatch.operators import drift
from tidewatch.operators.monitoring import batch_performance
from tidewatch.operators.scoring import ORDER_INTERCEPT, ORDER_WEIGHTS, score_linear
from tidewatch.plans.catalog import ORDER_SCORES, query
from tidewatch.plans.drift import PERFORMANCE
from tidewatch.plans.inputs import scored_orders
from tidewatch.session import scratch_path
from tidewatch.sources.tables import table
from tidewatch.streaming import jobs

EVENT_INTERCEPT, EVENT_WEIGHTS = -1.0, {"value": 0.01}
EVENT_SCORE = "round(1 / (1 + exp(-(-1e0 + value * 0.01e0))), 9)"


def _events(spark, folder):
    return score_linear(
        jobs.event_time(jobs.stream_table(spark, folder, "events")), EVENT_INTERCEPT, EVENT_WEIGHTS, "p", digits=9
    )


@query(
    "s1_score_stream",
    f"""WITH {ORDER_SCORES} SELECT o_orderkey, p, CASE WHEN p >= 0.7e0 THEN 'HIGH' WHEN p >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END
    AS risk_level, CASE WHEN p > 0.8e0 OR p < 0.2e0 THEN 0.9e0 ELSE 0.7e0 END AS confidence_score,
    round(CASE WHEN p >= 0.7e0 THEN o_totalprice ELSE 0e0 END, 6) AS at_risk FROM order_scores""",
)
def _(spark, folder):
    stream = jobs.stream_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    scored = jobs.score_stream(
        stream, lambda rows: score_linear(rows, ORDER_INTERCEPT, ORDER_WEIGHTS, "p"), "p", "o_totalprice"
    )
    return jobs.run_to_files(scored, spark).select(
        "o_orderkey", "p", "risk_level", "confidence_score",
        F.col("business_impact.monthly_revenue_at_risk").alias("at_risk"),
    )


LIMITS = [Field("l_quantity", NUMERIC, low=5, high=50), Field("l_discount", NUMERIC, low=0, high=0.08)]


@query(
    "s2_valid_rejected",
    """SELECT CASE WHEN l_quantity BETWEEN 5 AND 50 AND l_discount BETWEEN 0 AND 0.08e0 THEN 'valid' ELSE 'rejected' END AS route,
    CAST(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.08e0 THEN 1 ELSE 0 END AS BIGINT) AS n_reasons,
    CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2""",
)
def _(spark, folder):
    stream = jobs.stream_table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    valid_path, rejected_path = jobs.route_valid_rejected(stream, spark, LIMITS)
    valid = spark.read.parquet(valid_path).select(F.lit("valid").alias("route"), F.lit(0).alias("n_reasons"), "l_quantity")
    rejected = spark.read.parquet(rejected_path).select(
        F.lit("rejected").alias("route"), F.size("reasons").alias("n_reasons"), "l_quantity"
    )
    return valid.unionByName(rejected).groupBy("route", "n_reasons").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def _sql_window(hours: int, starts: str) -> str:
    return f"""WITH e AS (SELECT *, {EVENT_SCORE} AS p FROM events), x AS ({starts}),
    w AS (SELECT s AS a, s + INTERVAL {hours} HOUR AS z, event_type, p FROM x)
    SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(z, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
      CAST(count(*) AS BIGINT) AS batch_size, round(avg(CASE WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS positive_rate,
      round(avg(p), 6) AS mean_probability, round(stddev_pop(p), 6) AS std_probability, round(min(p), 6) AS min_probability,
      round(max(p), 6) AS max_probability, round(avg(CASE WHEN p > 0.8e0 THEN 1e0 ELSE 0e0 END), 6) AS high_confidence_rate,
      round(avg(CASE WHEN p < 0.2e0 THEN 1e0 ELSE 0e0 END), 6) AS low_confidence_rate
    FROM w WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY a, z, event_type"""


@query("s3_tumbling_stats", _sql_window(1, "SELECT date_trunc('hour', ts) AS s, event_type, p FROM e"))
def _(spark, folder):
    return jobs.run_to_files(jobs.windowed_stats(_events(spark, folder), "p", ["event_type"]), spark)


@query(
    "s4_sliding_stats",
    _sql_window(24, "SELECT date_trunc('hour', ts) - to_hours(i) AS s, event_type, p FROM e, range(24) r(i)"),
)
def _(spark, folder):
    stats = jobs.windowed_stats(_events(spark, folder), "p", ["event_type"], length="24 hours", slide="1 hour")
    return jobs.run_to_files(stats, spark)


_POINTS = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in drift.BASELINE_PROBS.items())
_SHIFTED = "value * CASE event_type WHEN 'error' THEN 1.6e0 WHEN 'signup' THEN 0.5e0 ELSE 1e0 END"
STREAM_DRIFT = f"""
b AS (SELECT min(value) AS mn, {_POINTS}, max(value) AS mx FROM events WHERE ts < TIMESTAMP '2024-01-11'),
ed AS (SELECT DISTINCT unnest([mn, p10, p25, p50, p75, p90, mx]) AS e FROM b),
bn AS (SELECT * FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS k FROM ed)
  WHERE hi IS NOT NULL),
v AS (SELECT event_type, {_SHIFTED} AS v, round(1 / (1 + exp(-(-1e0 + ({_SHIFTED}) * 0.01e0))), 9) AS p FROM events),
h AS (SELECT event_type, i, count(*) AS n FROM v JOIN bn ON v >= lo AND (v < hi OR (i = k - 1 AND v = hi)) GROUP BY 1, 2),
tt AS (SELECT event_type, CAST(sum(n) AS DOUBLE) AS t FROM h GROUP BY 1),
ps AS (SELECT event_type, abs(sum((a - 1e0 / k) * ln(a * k))) AS psi FROM (SELECT tt.event_type, k,
    CASE WHEN coalesce(n, 0) = 0 THEN 0.001e0 ELSE n / t END AS a FROM tt CROSS JOIN bn
    LEFT JOIN h ON h.event_type = tt.event_type AND h.i = bn.i) q GROUP BY 1),
hr AS (SELECT event_type, count(*) AS n, avg(CASE WHEN p >= 0.7e0 THEN 1e0 ELSE 0e0 END) AS high FROM v GROUP BY 1)"""


@query(
    "s5_batch_drift_alerts",
    f"""WITH {STREAM_DRIFT} SELECT event_type, CAST(n AS BIGINT) AS total_predictions, round(psi, 6) AS max_psi,
    round(high, 6) AS high_risk_rate, CAST((psi > 0.1e0)::INT + (high > 0.2e0)::INT AS BIGINT) AS n_alerts
    FROM hr JOIN ps USING (event_type)""",
)
def _(spark, folder):
    events = table(spark, folder, "events")
    baseline = drift.baseline_stats(events.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")), ["value"])
    factor = F.when(F.col("event_type") == "error", 1.6).when(F.col("event_type") == "signup", 0.5).otherwise(1.0)
    stream = jobs.stream_table(spark, folder, "events").withColumn("value", F.col("value") * factor)
    scored = score_linear(stream, EVENT_INTERCEPT, EVENT_WEIGHTS, "p", digits=9)
    metrics_path, alerts_path = jobs.monitor_stream(scored, spark, baseline, ["value"], ["event_type"], "p", "ts")
    found = spark.read.parquet(alerts_path).groupBy("event_type").agg(F.count("*").alias("n_alerts"))
    return (
        spark.read.parquet(metrics_path)
        .join(found, "event_type", "left")
        .select(
            "event_type", "total_predictions", "max_psi", "high_risk_rate",
            F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"),
        )
    )


@query(
    "s6_late_outcomes",
    f"""WITH e AS (SELECT event_type, {EVENT_SCORE} AS p FROM events WHERE value * 60 <= 7200)
    SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN (p >= 0.5e0) = (event_type = 'error')
    THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM e GROUP BY 1""",
)
def _(spark, folder):
    # The outcome of an event becomes known `value` minutes after it.
    predictions = _events(spark, folder).select("event_id", "event_type", "p", F.col("ts").alias("predicted_at"))
    outcomes = jobs.stream_table(spark, folder, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("actual"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("value") * 60)).alias("known_at"),
    ).withWatermark("known_at", "1 hour")
    joined = jobs.join_late_outcomes(predictions, outcomes, "event_id", "2 HOURS", "predicted_at", "known_at")
    rows = jobs.run_to_files(joined.select("event_type", "p", "actual"), spark)
    return batch_performance(rows, ["event_type"], "p", "actual").select("event_type", "n", "accuracy")


@query(
    "s7_degradation_stream",
    f"""WITH {ORDER_SCORES}, {PERFORMANCE} SELECT model_version, strftime(batch_month, '%Y-%m-%d %H:%M:%S') AS batch_month,
    round(accuracy, 6) AS accuracy, round(recent, 6) AS recent_accuracy, degraded FROM degr""",
)
def _(spark, folder):
    history = batch_performance(
        scored_orders(spark, folder), ["model_version", "batch_month"], "p", "actual"
    ).withColumn("batch_month", F.col("batch_month").cast("timestamp_ntz"))
    path = scratch_path(spark, "history")
    history.write.parquet(path)

    def compare(stream):
        return jobs.degradation_stream(jobs.event_time(stream, "batch_month", "0 seconds"), "model_version", "batch_month")

    return jobs.run_closed(path, "batch_month", compare, spark)


@query(
    "s8_user_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM events),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    x AS (SELECT user_id, s, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS n_events, sum(value) AS total FROM n GROUP BY 1, 2)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(z, '%Y-%m-%d %H:%M:%S') AS session_end,
      CAST(n_events AS BIGINT) AS n_events, round(total, 4) AS total_value FROM x
    WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def _(spark, folder):
    events = jobs.event_time(jobs.stream_table(spark, folder, "events"))
    rows = jobs.run_to_files(jobs.sessions(events, "user_id", "value"), spark)
    return rows.withColumn("total_value", F.round("total_value", 4))
