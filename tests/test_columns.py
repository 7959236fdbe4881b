from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.probability import chi_square_p_value, ks_p_value


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_parse_number(spark):
    values = ["1", " 2.5 ", "-3e2", ".5", "1.", "", " ", "1d", "NaN", "abc", None, "1,000"]
    assert column(spark, values, "string", C.parse_number("v")) == [
        1.0, 2.5, -300.0, 0.5, 1.0, None, None, None, None, None, None, None
    ]


def test_clip_keeps_null(spark):
    assert column(spark, [-1.0, 5.0, 11.0, None], "double", C.clip("v", 0, 10)) == [0.0, 5.0, 10.0, None]


def test_booleans_use_exact_spelling(spark):
    values = ["true", "True", "TRUE", "y", "N", "0", "maybe", None]
    assert column(spark, values, "string", C.to_boolean("v")) == [True, True, None, True, False, False, None, None]


def test_risk_band_edges(spark):
    values = [0.7, 0.6999, 0.3, 0.2999, None, float("nan")]
    assert column(spark, values, "double", C.risk_band("v")) == ["HIGH", "MEDIUM", "MEDIUM", "LOW", None, None]
    assert column(spark, [0.35, 0.4], "double", C.risk_band("v", medium=0.4)) == ["LOW", "MEDIUM"]


def test_confidence(spark):
    values = [0.81, 0.8, 0.61, 0.5, 0.39, 0.19, 0.2, None]
    expected = ["High", "Medium", "Medium", "Low", "Medium", "High", "Medium", None]
    assert column(spark, values, "double", C.confidence_level("v")) == expected
    assert column(spark, [0.9, 0.5], "double", C.confidence_score("v")) == [0.9, 0.7]


def test_labels(spark):
    assert column(spark, [0.5, 0.49, None], "double", C.label_text(C.hard_label("v"))) == ["Churn", "Retain", None]


def test_rule_score_examples(spark):
    rows = spark.createDataFrame([(2.0, 85.0), (48.0, 35.0), (12.0, 75.0)], "t double, m double")
    got = rows.select(C.rule_score("t", "m").alias("s")).select("s", C.rule_band("s").alias("b")).collect()
    assert [(r.s, r.b) for r in got] == [(0.9, "HIGH"), (0.3, "LOW"), (0.4, "MEDIUM")]


def test_tenure_bucket_and_spend(spark):
    values = [0.0, 0.5, 12.0, 12.1, 36.0, 60.0, 61.0, None]
    expected = [None, "New", "New", "Mid", "Mid", "Long", "Loyal", None]
    assert column(spark, values, "double", C.tenure_bucket("v")) == expected
    assert column(spark, [9.0], "double", C.average_spend(F.lit(None).cast("double"), F.lit(50.0), "v")) == [5.0]


def test_metric_text(spark):
    assert column(spark, [0.5], "double", C.metric_text(F.lit("roc_auc"), "v")) == ["Roc Auc: 0.5000"]


def test_chi_square_critical_values(spark):
    # 5 % critical values from the usual table
    table = [(3.841, 1), (5.991, 2), (7.815, 3), (9.488, 4), (11.070, 5), (18.307, 10), (124.342, 100)]
    df = spark.createDataFrame(table, "x double, d int")
    for row in df.select(chi_square_p_value(F.col("x"), F.col("d")).alias("p")).collect():
        assert abs(row.p - 0.05) < 1e-4
    edge = spark.createDataFrame([(5.0, 0), (0.0, 3), (1e16, 4), (1e16, 5), (0.0, 1)], "x double, d int")
    assert [r.p for r in edge.select(chi_square_p_value(F.col("x"), F.col("d")).alias("p")).collect()] == [1, 1, 0, 0, 1]


def test_ks_p_value(spark):
    df = spark.createDataFrame([(0.0, 50, 60), (1.0, 50, 60), (0.136, 200, 200)], "d double, a int, b int")
    p = [r.p for r in df.select(ks_p_value(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert p[0] == 1.0 and p[1] < 1e-9 and abs(p[2] - 0.0495) < 2e-3


def test_chi_square_of_many_categories(spark):
    # for so many degrees of freedom the statistic is close to normal: mean d, deviation sqrt(2 d)
    rows = [(float(d + z * (2 * d) ** 0.5), d) for d in (20_001, 20_000_000) for z in (-2.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, d long")
    got = [r.p for r in df.select(chi_square_p_value(F.col("x"), F.col("d")).alias("p")).collect()]
    assert all(abs(p - q) < 4e-3 for p, q in zip(got, [0.97725, 0.5, 0.02275] * 2))
    edge = spark.createDataFrame([(10_100.0, 9_999), (10_100.0, 10_000), (10_100.0, 10_001)], "x double, d long")
    near = [r.p for r in edge.select(chi_square_p_value(F.col("x"), F.col("d")).alias("p")).collect()]
    assert max(near) - min(near) < 0.01
