import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import impact, registry, scoring


def portfolio(spark, high, medium, low):
    rows = [("HIGH", 0.8)] * high + [("MEDIUM", 0.5)] * medium + [("LOW", 0.1)] * low
    return spark.createDataFrame(rows, "risk_level string, churn_probability double").withColumn(
        "MonthlyCharges", F.lit(65.0)
    )


def test_demo_portfolio(spark):
    row = impact.retention_roi(portfolio(spark, 98, 41, 57)).first()
    assert (row.monthly_revenue_at_risk, row.annual_revenue_at_risk, row.intervention_cost) == (6370.0, 76440.0, 1470.0)
    assert row.net_benefit == pytest.approx(52038.0) and row.roi_percentage == pytest.approx(3540.0)
    report = impact.business_report(portfolio(spark, 98, 41, 57)).first()
    assert report.net_benefit == pytest.approx(52038.0) and report.recommended_interventions == 139
    scaled = impact.portfolio_report(portfolio(spark, 2, 0, 0), multiplier=1000).first()
    assert scaled.high_risk == 2000 and scaled.roi_percentage == pytest.approx(3540.0)


def test_no_high_risk_costs_nothing(spark):
    row = impact.business_report(portfolio(spark, 0, 3, 3)).first()
    assert (row.intervention_cost, row.roi_percentage) == (0.0, 0.0)
    empty = impact.response_summary(portfolio(spark, 1, 0, 0).where("false")).first()
    assert (empty.total_predictions, empty.avg_churn_probability) == (0, 0.0)


def test_campaign_example(spark):
    metrics = spark.createDataFrame([(0.68, 0.75), (0.5, 0.0)], "recall double, precision double")
    row, undefined = impact.campaign_impact(metrics, F.lit(50_000)).collect()
    assert row.customers_saved == 3468 and row.total_interventions == 7706
    assert row.revenue_saved == pytest.approx(4_161_600) and row.intervention_cost == pytest.approx(578_000)
    assert row.net_benefit == pytest.approx(3_583_600) and row.roi_ratio == pytest.approx(6.2)
    assert row.churn_reduction_pct == pytest.approx(40.8)
    assert (undefined.total_interventions, undefined.roi_ratio) == (0, 0.0)
    text = impact.extrapolated_impact(metrics, F.lit(10_000)).first()
    assert text.roi_text == "6.2:1" and text.customers_saved == 3468


def test_batch_summary_counts_errors(spark):
    rows = portfolio(spark, 1, 1, 2).unionByName(
        spark.createDataFrame([("ERROR", 0.0, 0.0)], "risk_level string, churn_probability double, MonthlyCharges double")
    )
    row = impact.batch_summary(scoring.add_business_columns(rows)).first()
    assert (row.total_records, row.errors, row.successful_predictions) == (5, 1, 4)
    assert row.annual_revenue_at_risk == 780.0 and row.customers_requiring_intervention == 2


def test_error_rows(spark):
    df = spark.createDataFrame(
        [(10.0, 50.0, 500.0), (None, 50.0, 1.0), (5.0, 600.0, 1.0)], "tenure double, MonthlyCharges double, TotalCharges double"
    )
    rows = scoring.score_with_errors(df).collect()
    assert sorted(r.risk_level == "ERROR" for r in rows) == [False, True, True]
    assert {r.error_message for r in rows} == {None, "tenure: null", "MonthlyCharges: above maximum"}


def test_registry(spark, tmp_path):
    store = registry.ModelRegistry(spark, str(tmp_path))
    rows = spark.createDataFrame(
        [("v1", {"test_roc_auc": 0.7}), ("v2", {"test_roc_auc": 0.8}), ("v3", {})], "version string, performance map<string,double>"
    ).withColumn("created", F.lit("2026-01-01").cast("timestamp_ntz"))
    store.register(rows)
    assert store.champion().count() == 0
    with pytest.raises(ValueError):
        store.champion_path()
    with pytest.raises(ValueError):
        store.set_champion("v9", "2026-01-01")
    store.set_champion("v1", "2026-01-01")
    store.set_champion("v2", "2026-01-02")
    assert [r.version for r in store.champion().collect()] == ["v2"]
    ranked = store.compare().collect()
    assert [(r.version, r.test_roc_auc, r.is_champion) for r in ranked] == [("v2", 0.8, True), ("v1", 0.7, False), ("v3", 0.0, False)]
    again = rows.where("version = 'v3'").withColumn("created", F.lit(dt.datetime(2026, 2, 1)).cast("timestamp_ntz"))
    store.register(again.withColumn("performance", F.create_map(F.lit("test_roc_auc"), F.lit(0.9))))
    assert store.versions().count() == 3 and store.compare().first().version == "v3"
    assert "ROC-AUC: 0.800" in registry.model_card(store.champion()).first().card


def test_outreach_order_and_batches(spark):
    df = scoring.add_business_columns(portfolio(spark, 2, 2, 1).withColumn("id", F.monotonically_increasing_id()))
    assert [r.priority_score for r in scoring.outreach_list(df, "id").collect()] == [3, 3, 2, 2]
    numbers = scoring.batch_numbers(spark.range(0, 50, 2), "id", 10).groupBy("batch_number").count().collect()
    assert {r.batch_number: r["count"] for r in numbers} == {1: 10, 2: 10, 3: 5}
