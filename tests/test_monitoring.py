import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import monitoring
from tidewatch.sources import prediction_log


def asof(text):
    return F.lit(text).cast("timestamp_ntz")


# Mean probability and positive rate of ten recorded one-row batches, in order.
RECORDED = [(0.4, 0.0), (0.4, 0.0), (0.1, 0.0), (0.1, 0.0), (0.4, 0.0), (0.5, 0.0), (0.0, 0.0), (0.7, 1.0), (0.7, 1.0), (0.6, 1.0)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (dt.datetime(2026, 2, 9, 10) + dt.timedelta(minutes=i), "v1", 1, {"positive_rate": r}, {"mean_probability": p})
        for i, (p, r) in enumerate(RECORDED)
    ]
    schema = (
        "timestamp timestamp_ntz, model_version string, batch_size bigint, "
        "prediction_stats struct<positive_rate: double>, probability_stats struct<mean_probability: double>"
    )
    return spark.createDataFrame(rows, schema)


def test_recorded_log(log):
    row = monitoring.recent_stats(log, asof("2026-02-09 12:00:00")).first()
    assert (row.total_predictions, row.batch_count, row.prediction_volume_trend) == (10, 10, "stable")
    assert row.average_positive_rate == pytest.approx(0.3)
    later = monitoring.recent_stats(log, asof("2026-02-11 12:00:00")).first()
    assert (later.total_predictions, later.prediction_volume_trend) == (0, "insufficient_data")


def test_trend_uses_floor_half(spark):
    rows = [(dt.datetime(2026, 1, 1, i), n) for i, n in enumerate([10, 12, 12])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, batch_size int")
    assert monitoring.volume_trend(df, "ts").first().prediction_volume_trend == "increasing"


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0.9, 1.0, dt.datetime(2026, 1, 1)), (0.1, None, dt.datetime(2026, 1, 1))], "p double, x double, timestamp timestamp_ntz")
    stats = monitoring.batch_stats(df.withColumn("model_version", F.lit("v")), ["model_version", "timestamp"], "p", ["x", "p"])
    path = prediction_log.append(stats, str(tmp_path / "log"))
    prediction_log.append(stats, path)
    rows = prediction_log.read(spark, path).collect()
    assert len(rows) == 2 and rows[0].prediction_stats.positive_rate == 0.5
    assert rows[0].input_stats.missing_rate == 0.25 and rows[0].input_stats.numeric_feature_means["x"] == 1.0
    assert rows[0].probability_stats.high_confidence_rate == 0.5


def test_dense_degradation_equals_plain(spark, monkeypatch):
    random.seed(5)
    rows = [("m", i, random.random()) for i in range(1, 131)] + [("n", i, 0.5) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "model string, i bigint, accuracy double")
    plain = monitoring.degradation(df, ["model"], "i").orderBy("model", "i").collect()
    monkeypatch.setattr(monitoring, "CHUNK", 16)
    dense = monitoring.degradation(df, ["model"], "i", dense=True).orderBy("model", "i").collect()
    assert len(plain) == 137 and [tuple(r) for r in plain] == [tuple(r) for r in dense]
    assert not plain[0].degraded and plain[0].recent_accuracy is None


def test_alert_rules(spark):
    rows = [
        (1, ["a"], False, 0.0, 0.1),
        (2, ["a", "b", "c"], True, 0.08, 0.25),
        (3, [], True, 0.2, 0.2),
    ]
    df = spark.createDataFrame(
        rows, "b int, drifted_features array<string>, degraded boolean, degradation_amount double, high_risk_rate double"
    ).withColumn("ts", asof("2026-01-01"))
    found = monitoring.alerts(df, ["b"], "ts")
    got = {(r.b, r.type): r.severity for r in found.collect()}
    assert got == {
        (1, "DATA_DRIFT"): "MEDIUM",
        (2, "DATA_DRIFT"): "HIGH",
        (2, "PERFORMANCE_DEGRADATION"): "MEDIUM",
        (2, "HIGH_RISK_SPIKE"): "HIGH",
        (3, "PERFORMANCE_DEGRADATION"): "HIGH",
    }
    routed = {(r.b, r.type): r.response for r in monitoring.route_alerts(found).collect()}
    assert routed == {
        (2, "DATA_DRIFT"): "schedule_retraining", (2, "HIGH_RISK_SPIKE"): None, (3, "PERFORMANCE_DEGRADATION"): "flag_for_review"
    }
    assert monitoring.active_alerts(found, asof("2026-01-02")).count() == 0
    health = monitoring.system_health(monitoring.active_alerts(found, asof("2026-01-01 23:00:00"))).first()
    assert (health.n_active, health.status) == (5, "CRITICAL")
    assert monitoring.system_health(found.where("severity = 'MEDIUM'")).first().status == "WARNING"
    assert monitoring.system_health(found.where("false")).first().status == "HEALTHY"


def test_overall_status(spark):
    schema = "check string, passed boolean, message string, severity string"

    def status(*rows):
        return monitoring.overall_status(spark.createDataFrame(list(rows), schema)).first().overall_status

    assert status(("a", True, "", None)) == "healthy"
    assert status(("a", False, "", "warning")) == "degraded"
    assert status(("a", False, "", "warning"), ("b", False, "", "error")) == "unhealthy"


def test_checks(spark):
    sparse = spark.createDataFrame([(None, None), (1, None)], "a int, b int")
    assert monitoring.data_quality_check(sparse).first().message == "High missing data rate: 75.0%"
    twice = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert monitoring.data_quality_check(twice).first().message == "High duplicate rate: 50.0%"
    rates = spark.createDataFrame([(0.9,), (0.9,)], "p double")
    assert not monitoring.prediction_rate_check(rates, "p").first().passed


def test_batch_performance_undefined_is_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    row = monitoring.batch_performance(df, [], "p", "y").first()
    assert (row.accuracy, row.precision, row.recall) == (1.0, 0.0, 0.0)


def test_rolling_and_throughput(spark, log):
    rows = monitoring.rolling_stats(log, ["model_version"], "timestamp", 1).collect()
    assert max(r.total_predictions for r in rows) == 10
    empty = monitoring.throughput(spark.createDataFrame([], "batch_size bigint, seconds double")).first()
    assert tuple(empty) == (0, 0.0, 0.0)


def test_recent_stats_count_every_batch_of_the_window(spark):
    log = spark.range(1500).select(
        (F.lit("2026-02-09 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("timestamp"),
        F.lit("v").alias("model_version"),
        F.expr("id div 750 + 1").alias("batch_size"),
        F.struct(F.lit(0.25).alias("positive_rate")).alias("prediction_stats"),
    )
    row = monitoring.recent_stats(log, F.lit("2026-02-09 12:00:00").cast("timestamp_ntz")).first()
    assert (row.batch_count, row.total_predictions, row.prediction_volume_trend) == (1500, 2250, "increasing")
    halves = monitoring.volume_trend(log, "timestamp", "model_version").first()
    assert (halves.batch_count, halves.first_half, halves.second_half) == (1500, 1.0, 2.0)


def test_a_failing_check_is_reported(spark):
    def broken():
        raise RuntimeError("no connection\nmore")

    fine = lambda: spark.createDataFrame([(True, "ok", None)], "passed boolean, message string, severity string")
    rows = {r.check: r for r in monitoring.health_check(spark, {"a": fine, "b": broken, "c": fine}).collect()}
    assert rows["a"].passed and rows["c"].passed and not rows["b"].passed
    assert (rows["b"].severity, rows["b"].message) == ("error", "Check failed: RuntimeError: no connection")
    status = monitoring.overall_status(monitoring.health_check(spark, {"a": fine, "b": broken})).first()
    assert status.overall_status == "unhealthy"


def test_long_history_of_any_spacing_equals_the_plain_window(spark, monkeypatch):
    monkeypatch.setattr(monitoring, "CHUNK", 40)
    df = spark.range(500).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit("m")).alias("model"),
        (F.col("id") * F.col("id") * 20 + F.hash("id") % 7).alias("at"),
        (F.pmod(F.hash(F.col("id") + 1), F.lit(100)) / 100).alias("accuracy"),
    )
    rows = lambda d: sorted(
        (str(r.model), r.at, r.accuracy, round(r.recent_accuracy or -1, 9), r.degraded) for r in d.collect()
    )
    long = monitoring.degradation(df, ["model"], "at", long=True)
    assert rows(long) == rows(monitoring.degradation(df, ["model"], "at"))
    assert long.columns == [*df.columns, "recent_accuracy", "degraded", "degradation_amount"]


def test_rolling_stats_by_time_bucket_equal_the_plain_window(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    log = spark.range(400).select(
        F.lit("one").alias("m"),
        (start + F.make_dt_interval(secs=F.pmod(F.hash("id"), F.lit(400_000)).cast("decimal(18,6)"))).alias("t"),
        (F.col("id") % 9).alias("batch_size"),
        F.struct((F.col("id") % 5 / 4).alias("positive_rate")).alias("prediction_stats"),
    )
    got = sorted(tuple(r) for r in monitoring.rolling_stats(log, ["m"], "t", 6).collect())
    seen = [(r.t, r.batch_size, r.prediction_stats.positive_rate) for r in log.collect()]
    assert len(got) == 400
    for m, t, total, count, rate in got:
        near = [x for x in seen if 0 <= (t - x[0]).total_seconds() < 6 * 3600]
        assert (total, count) == (sum(x[1] for x in near), len(near))
        assert rate == pytest.approx(sum(x[2] for x in near) / len(near))


def test_newest_rows_of_equal_time_are_the_same_each_time(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(50)], "g string, t int, v int")
    for parts in (1, 7):
        assert {r.v for r in monitoring.newest_per_group(df.repartition(parts), ["g"], "t", 3).collect()} == {47, 48, 49}
