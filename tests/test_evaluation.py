import numpy as np
import pytest

from tidewatch.operators import evaluation


def binary(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def test_auc_and_average_precision(spark):
    df = binary(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    row = evaluation.ranking_metrics(df, "y", "s").first()
    assert row.roc_auc == pytest.approx(0.75) and row.average_precision == pytest.approx(0.8333333)


def test_auc_ties_and_reverse(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 12)) / 12) for _ in range(400)]
    auc = evaluation.ranking_metrics(binary(spark, rows), "y", "s").first().roc_auc
    turned = evaluation.ranking_metrics(binary(spark, [(y, -s) for y, s in rows]), "y", "s").first().roc_auc
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc == pytest.approx(want) and auc + turned == pytest.approx(1)


def test_one_class(spark):
    row = evaluation.ranking_metrics(binary(spark, [(1, 0.2), (1, 0.3)]), "y", "s").first()
    assert row.roc_auc is None and row.average_precision == 1.0


def test_curves(spark):
    df = binary(spark, [(0, 0.1), (1, 0.9), (1, 0.9), (0, 0.5)])
    roc = sorted((r.fpr, r.tpr) for r in evaluation.roc_curve(df, "y", "s").collect())
    assert roc == [(0.0, 0.0), (0.0, 1.0), (0.5, 1.0), (1.0, 1.0)]
    pr = evaluation.precision_recall_curve(df, "y", "s").collect()
    assert {(r.recall, round(r.precision, 4)) for r in pr} == {(0.0, 1.0), (1.0, 1.0), (1.0, 0.6667), (1.0, 0.5)}
    assert {r.base_rate for r in pr} == {0.5}


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 1)], "y int, p int")
    rows = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in evaluation.class_report(df, "y", "p").collect()}
    assert rows[1] == (0.0, 0.0, 0.0, 1) and rows[2] == (0.0, 0.0, 0.0, 1)
    assert rows[0][0] == pytest.approx(2 / 3) and rows[0][1] == 1.0
    assert evaluation.label_metrics(df, "y", "p").first().accuracy == 0.5
    grid = {(r.label, r.prediction): r.n for r in evaluation.confusion(df, "y", "p").collect()}
    assert len(grid) == 9 and grid[(2, 1)] == 1 and grid[(2, 2)] == 0


def test_report_text(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1)], "y int, p int, s double")
    rows = {r.metric: r.text for r in evaluation.model_report(df, "y", "p", "s").collect()}
    assert rows["roc_auc"] == "Roc Auc: 1.0000" and rows["1_support"] == "1 Support: 1.0000"
