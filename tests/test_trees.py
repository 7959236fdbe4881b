from multiprocessing.pool import ThreadPool
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidewatch.operators import modeling, trees
from tidewatch.plans import learning


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(1_500, 4)), 2)
    x[:, 3] = x[:, 3] > 0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=1_500) > 0).astype(int)
    rows = [(i, int(a), Vectors.dense(b)) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, ["id", "label", "features"]).coalesce(2).cache()


def probabilities(model, rows):
    found = model.transform(rows).orderBy("id").select(vector_to_array("probability")[1].alias("p")).collect()
    return np.array([r.p for r in found])


def test_boosted_trees_are_those_of_spark(points):
    settings = {"maxIter": 15, "maxDepth": 3, "stepSize": 0.2, "seed": 42}
    want, got = GBTClassifier(**settings).fit(points), trees.BoostedTrees(**settings).fit(points)
    assert type(got) is type(want) and got.treeWeights == want.treeWeights and got.getMaxIter() == 15
    assert got.totalNumNodes == want.totalNumNodes
    assert np.allclose(probabilities(got, points), probabilities(want, points), atol=1e-9)
    # Two features may cut a small node alike; then either is right.
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.01)


def test_a_tree_of_all_rows_and_features_is_that_of_spark(points):
    settings = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all", "maxDepth": 6, "seed": 42}
    want, got = RandomForestClassifier(**settings).fit(points), trees.Forest(**settings).fit(points)
    assert got.numClasses == 2 and got.totalNumNodes == want.totalNumNodes
    assert np.allclose(probabilities(got, points), probabilities(want, points), atol=1e-9)
    # Two features may cut a small node alike; then either is right.
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.01)


def test_a_forest_is_as_good_as_that_of_spark(points):
    train, test = points.where("id % 3 > 0"), points.where("id % 3 = 0")
    area = BinaryClassificationEvaluator(numBins=0)
    settings = {"numTrees": 60, "maxDepth": 30, "seed": 42}
    want, got = RandomForestClassifier(**settings).fit(train), trees.Forest(**settings).fit(train)
    assert area.evaluate(got.transform(test)) == pytest.approx(area.evaluate(want.transform(test)), abs=0.03)
    assert got.totalNumNodes == pytest.approx(want.totalNumNodes, rel=0.05)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.05)
    assert len({tree.numNodes for tree in got.trees}) > 10  # each drew its own rows


def test_cells_hold_every_row_once(points):
    held = F.col("id") % 5 == 0
    cells = trees.counted(points, "features", "label", 32, 42, held)
    want = {(r.label, r.h): r.n for r in points.groupBy("label", held.alias("h")).agg(F.count("*").alias("n")).collect()}
    assert [*cells.rows.sum(axis=1), *cells.held.sum(axis=1)] == [want[y, h] for h in (False, True) for y in (0, 1)]
    assert len(cells.cuts[3]) == 1 and all(len(c) <= 31 for c in cells.cuts)
    again = trees.counted(points.repartition(7), "features", "label", 32, 42, held)
    assert (cells.bins == again.bins).all() and (cells.rows == again.rows).all()


def test_samples_of_cells_are_those_of_their_rows():
    rows = np.array([[1, 7, 400, 0]])
    rng = np.random.default_rng(1)
    kept = np.stack([trees._drawn(rng, rows, 0.8, False)[0] for _ in range(4_000)])
    assert (kept <= rows).all() and np.allclose(kept.mean(axis=0), 0.8 * rows, atol=0.5)
    assert np.allclose(kept.var(axis=0), 0.16 * rows, rtol=0.1)
    again = np.stack([trees._drawn(rng, rows, 1.0, True)[0] for _ in range(4_000)])
    assert np.allclose(again.mean(axis=0), rows, rtol=0.05) and np.allclose(again.var(axis=0), rows, rtol=0.1)


def test_area_under_roc_of_tied_scores(spark):
    score, n0, n1 = np.array([0.1, 0.5, 0.5, 0.9]), np.array([3, 1, 0, 2]), np.array([1, 0, 4, 2])
    rows = [(s, y) for s, a, b in zip(score, n0, n1) for y, n in ((0, a), (1, b)) for _ in range(n)]
    df = spark.createDataFrame([(float(s), float(y)) for s, y in rows], ["rawPrediction", "label"])
    assert trees.area_under_roc(score, n0, n1) == pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(df))


def test_what_cells_cannot_hold_is_left_to_spark(spark, points, monkeypatch):
    weighted = points.withColumn("w", F.lit(1.0))
    assert trees.BoostedTrees(maxIter=2, weightCol="w").fit(weighted).getNumTrees == 2
    several = points.withColumn("label", F.col("id") % 3)
    assert trees.Forest(numTrees=2).fit(several).numClasses == 3
    estimator = modeling.boosted()
    grid = [{estimator.maxIter: n} for n in (2, 3)]
    by_task = modeling.tune_staged(estimator, grid, points, "label", "id", folds=2).collect()
    monkeypatch.setattr(trees, "MAX_ENTRIES", 100)
    assert trees.counted(points, "features", "label", 32, 42) is None
    by_spark = modeling.tune_staged(estimator, grid, points, "label", "id", folds=2).collect()
    for a, b in zip(by_task, by_spark):
        assert a.parameters == b.parameters and a.mean_score == pytest.approx(b.mean_score, abs=0.005)


def test_the_registered_search_and_refit_grow_all_rounds(spark, monkeypatch):
    """Rounds were counted in steps of twenty: 5 and 10 instead of 100 and 200."""
    monkeypatch.setattr(learning, "_SAVED", {})
    rows = learning.QUERIES["m11_grid_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 36 and {r.rounds for r in rows} == {"100", "200"}
    assert {r.max_depth for r in rows} == {"3", "5", "7"} and len({r.mean_score for r in rows}) > 18
    best = learning.QUERIES["t5_best_parameters"](spark, "/root/testdata/sf0.001").first()
    asked = []
    boosted = modeling.boosted
    monkeypatch.setattr(modeling, "boosted", lambda rounds=100: asked.append(rounds) or boosted(rounds))
    learning.QUERIES["m12_export_champion"](spark, "/root/testdata/sf0.001").collect()
    assert f'"maxIter":"{asked[0]}"' in best.parameters


def test_fits_that_share_an_input_run_side_by_side_and_make_it_once(spark, monkeypatch):
    monkeypatch.setattr(learning, "_SAVED", {})
    made, met = [], Barrier(2, timeout=60)

    def slow(path):
        made.append(path)

    def fit(name):
        met.wait()  # broken unless both run at the same time
        return learning._once(spark, "nowhere", "shared", slow)

    with ThreadPool(2) as pool:
        assert len(set(pool.map(fit, ["a", "b"]))) == 1 and len(made) == 1


def test_folds_and_kinds_are_fitted_side_by_side(spark, points):
    met = Barrier(2, timeout=60)

    class Met:
        def fit(self, rows):
            met.wait()  # broken unless another fit runs at the same time
            return modeling.logistic(1_500).fit(rows)

    scores = modeling.cross_validate(Met(), points, "label", "id", 2).collect()
    assert [r.fold for r in sorted(scores)] == [0, 1] and all(0.5 < r.score < 1 for r in scores)
    rows, fitted = modeling.compare_models({"a": Met(), "b": Met()}, points, points)
    assert sorted(r.model for r in rows.collect()) == ["a", "b"] == list(fitted)


def test_a_fit_makes_its_rows_once(spark, points):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def noted(label):
        made.add(1)
        return label

    costly = points.withColumn("label", noted("label"))
    assert trees.Forest(numTrees=3, seed=1).fit(costly).getNumTrees == 3
    assert made.value == points.count()
