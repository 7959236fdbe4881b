import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift

SCHEMA = "x double, c string"


def test_same_sample_has_no_drift(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    ks = drift.ks_test(df, df, ["x"]).first()
    assert (ks.statistic, ks.p_value, ks.drift_detected, ks.mean_shift) == (0.0, 1.0, False, 0.0)
    chi = drift.chi_square_test(df, df, ["c"]).first()
    assert chi.statistic == pytest.approx(0) and chi.p_value == 1.0 and chi.tv_distance == 0.0
    report = drift.drift_report(drift.drift_tests(df, df, ["x"], ["c"])).first()
    assert (report.columns_analyzed, report.n_drifted, report.drift_score) == (2, 0, 0.0)


def test_disjoint_samples(spark):
    ref = spark.range(100).select(F.col("id").cast("double").alias("x"))
    cur = spark.range(200, 300).select(F.col("id").cast("double").alias("x"))
    row = drift.ks_test(ref, cur, ["x"]).first()
    assert row.statistic == 1.0 and row.p_value < 1e-9 and row.drift_detected


def test_all_missing_now(spark):
    ref = spark.createDataFrame([(1.0, "a"), (2.0, "a")], SCHEMA)
    cur = spark.createDataFrame([(None, None), (float("nan"), None)], SCHEMA)
    row = drift.ks_test(ref, cur, ["x", "not there"]).first()
    assert (row.statistic, row.p_value, row.drift_detected, row.missing_rate_change) == (1.0, 0.0, True, 1.0)


def test_chi_square_by_hand(spark):
    ref = spark.createDataFrame([(0.0, "a")] * 50 + [(0.0, "b")] * 50, SCHEMA)
    cur = spark.createDataFrame([(0.0, "a")] * 60 + [(0.0, "b")] * 40, SCHEMA)
    row = drift.chi_square_test(ref, cur, ["c"]).first()
    assert row.statistic == pytest.approx(4.0) and row.p_value == pytest.approx(0.0455, abs=1e-4)
    assert row.tv_distance == pytest.approx(0.1)


def test_new_and_null_categories(spark):
    ref = spark.createDataFrame([(0.0, "a"), (0.0, None)], SCHEMA)
    cur = spark.createDataFrame([(0.0, "a"), (0.0, "z"), (0.0, "z"), (0.0, "z")], SCHEMA)
    assert [(r.value, r.n) for r in drift.new_categories(ref, cur, ["c"]).collect()] == [("z", 3)]
    row = drift.chi_square_test(ref, cur, ["c"]).first()
    assert row.degrees == 2 and row.n_new_categories == 1 and row.missing_rate_change == -0.5
    only = drift.chi_square_test(ref.where("c = 'a'"), cur.where("c = 'a'"), ["c"]).first()
    assert (only.degrees, only.p_value) == (0, 1.0)


def test_psi_against_own_baseline(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    base = drift.baseline_stats(df, ["x"])
    assert drift.psi(df, base, ["x"], expected="baseline").first().psi < 1e-6
    # By hand: shares .10 .15 .25 .25 .15 .10 against 1/7 each
    import math

    shares = [0.10, 0.15, 0.25, 0.25, 0.15, 0.10]
    want = abs(sum((a - 1 / 7) * math.log(a * 7) for a in shares))
    assert drift.psi(df, base, ["x"]).first().psi == pytest.approx(want, abs=1e-5)


def test_psi_repeated_edges_and_groups(spark):
    base = spark.createDataFrame([("x", 0.0, 1.0, 0.0, 10.0, 0.0, 0.0, 5.0, 10.0, 10.0)], drift.BASELINE_SCHEMA)
    cur = spark.createDataFrame([("g", 0.0), ("g", 10.0), ("g", 99.0), ("h", 1.0)], "g string, x double")
    got = {r.g: r.psi for r in drift.psi(cur, base, ["x"], by=["g"]).collect()}
    import math

    # edges 0, 5, 10: expected 1/3 per bin
    assert got["g"] == pytest.approx(2 * (0.5 - 1 / 3) * math.log(1.5))
    assert got["h"] == pytest.approx(abs((1 - 1 / 3) * math.log(3) + (0.001 - 1 / 3) * math.log(0.003)))
    report = {r.g: r.drifted_features for r in drift.psi_report(drift.psi(cur, base, ["x"], by=["g"]), by=["g"]).collect()}
    assert report == {"g": ["x"], "h": ["x"]}
    with pytest.raises(ValueError):
        drift.psi(cur, base, ["x"], expected="other")
