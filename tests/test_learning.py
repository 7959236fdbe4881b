import hashlib
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import features, joins, modeling, neighbours
from tidewatch.plans import learning


def test_split_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = features.stratified_split(df, "y", "id").collect()
    for label in (0, 1):
        ids = [r.id for r in rows if r.y == label]
        want = set(sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[: int(0.8 * len(ids))])
        assert {r.id for r in rows if r.y == label and r.is_train} == want


def test_split_of_tiny_class(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, y int")
    rows = {r.id: r.is_train for r in features.stratified_split(df, "y", "id").collect()}
    assert rows[1] is False and sum(rows.values()) == 1


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") < 20).cast("int").alias("y"))
    sizes = features.stratified_folds(df, "y", "id", 4).groupBy("y", "fold").count().collect()
    for label, total in ((0, 83), (1, 20)):
        counts = [r["count"] for r in sizes if r.y == label]
        assert sum(counts) == total and max(counts) - min(counts) <= 1


def test_lookup_join_shuffled_equals_broadcast(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    small = spark.range(40).select(F.col("id").cast("string").alias("k"), "id").withColumnRenamed("id", "v").unionByName(
        spark.createDataFrame([("hot", 99)], "k string, v bigint")
    )
    plain = joins.lookup_join(big, small, ["k"]).orderBy("id").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        shuffled = joins.lookup_join(big, small, ["k"]).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plain) == 2000 and plain == shuffled


def test_target_encoding_learns_on_train_only(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1)], "c string, y int")
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    got = {r.c: r.m for r in features.target_encode(train, rows, "c", "y", "m").collect()}
    assert got == {"a": 0.5, "z": 0.75, None: 0.75}


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, c string")
    hot = {r.id: (r.c_b, r.c_c) for r in features.encode(df, ["c"]).collect()}
    assert hot == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    codes = {r.id: r.c for r in features.encode(df, ["c"], "label").collect()}
    assert codes == {1: 1, 2: 0, 3: None, 4: 2}
    with pytest.raises(ValueError):
        features.encode(df, ["c"], "hash")
    with pytest.raises(ValueError):
        features.one_hot(df, "c", max_levels=2)
    with pytest.raises(ValueError):
        features.features_and_target(df, ["c"], "missing")
    assert features.features_and_target(df, ["nothing"], "c").columns == ["id", "c"]


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(tuple(r) for r in features.standardize(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("cell_points", [10_000, 60])
def test_neighbours_match_brute_force(spark, cell_points):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(600, 3)), 1)
    x[:200] = x[0]  # a third of the points are the same point
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(600) * 3)
    got = neighbours.nearest_neighbours(spark.createDataFrame(pdf), "id", list("abc"), 5, cell_points).collect()
    assert len(got) == 600
    for row in got:
        i = row.id // 3
        square = (x - x[i]) ** 2
        d2 = square[:, 0] + square[:, 1] + square[:, 2]
        want = sorted((d2[j], j * 3) for j in range(600) if j != i)[:5]
        assert [n.id for n in row.neighbours] == [j for _, j in want]


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, a double")
    got = {r.id: [n.id for n in r.neighbours] for r in neighbours.nearest_neighbours(df, "id", ["a"], 5).collect()}
    assert got == {1: [2], 2: [1]}


def test_oversampling(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(120), "a": rng.normal(size=120), "b": rng.normal(size=120), "y": [1] * 25 + [0] * 95})
    df = spark.createDataFrame(pdf)
    rows = neighbours.oversample_minority(df, "y", "id", ["a", "b"]).toPandas()
    assert rows.groupby("y").size().to_dict() == {0: 95, 1: 95}
    made, minority = rows[rows.is_synthetic], pdf[pdf.y == 1][["a", "b"]].to_numpy()
    assert len(made) == 70 and (made.y == 1).all()
    for p in made[["a", "b"]].to_numpy():
        # on the segment between two minority points: |p-x| + |p-z| = |x-z| for some pair
        d = np.linalg.norm(minority - p, axis=1)
        gap = d[:, None] + d[None, :] - np.linalg.norm(minority[:, None] - minority[None, :], axis=2)
        assert gap[~np.eye(len(minority), dtype=bool)].min() < 1e-9
    again = neighbours.oversample_minority(df.repartition(5), "y", "id", ["a", "b"]).toPandas()
    assert np.allclose(np.sort(rows.a), np.sort(again.a))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "a": a, "c": rng.choice(["u", "v", "w"], 300)})
    pdf["label"] = ((a + (pdf.c == "w") + rng.normal(scale=0.5, size=300)) > 0.3).astype(int)
    return spark.createDataFrame(pdf)


def test_preprocessor(spark, labelled):
    pre = modeling.fit_preprocessor(labelled, ["a"], ["c"])
    assert modeling.feature_names(pre) == ["a", "c_w", "c_v"]
    unseen = spark.createDataFrame([(1, 0.0, "new"), (2, 0.0, "u"), (3, 0.0, "w")], "id int, a double, c string")
    flags = {r.id: r.f[1:] for r in pre.transform(unseen).select("id", vector_to_array("features").alias("f")).collect()}
    assert flags == {1: [0, 0], 2: [0, 0], 3: [1, 0]}
    scaled = pre.transform(labelled).select(vector_to_array("features")[0].alias("z"))
    assert scaled.agg(F.stddev_pop("z")).first()[0] == pytest.approx(1.0)


def test_models(spark, labelled, tmp_path):
    pre = modeling.fit_preprocessor(labelled, ["a"], ["c"])
    ready = pre.transform(labelled)
    rows, fitted = modeling.compare_models({"l": modeling.logistic(300), "f": modeling.forest(trees=5)}, ready, ready)
    assert all(r.roc_auc > 0.8 and r.recall > 0.5 for r in rows.collect())
    top = modeling.feature_importance(fitted["f"], modeling.feature_names(pre), spark, top=2).collect()
    assert top[0].feature == "a" and len(top) == 2
    model = modeling.assemble(pre, fitted["l"])
    loaded = modeling.load_pipeline(modeling.save_pipeline(model, str(tmp_path / "m")))
    plain = labelled.select("id", "a", "c")
    assert modeling.predict_churn(loaded, plain).columns == ["id", "a", "c", "Predicted_Churn", "Churn_Probability"]
    rich = modeling.rich_prediction(loaded, plain, ["a", "c"], "2026-01-01", "v1").first()
    assert rich.input_features.c in "uvw" and rich.model_version == "v1" and rich.label_matches_threshold
    assert rich.prediction_label == ("Churn" if rich.prediction else "Retain")
    folds = modeling.cross_validate(modeling.logistic(300), ready, "label", "id", 3).collect()
    assert len(folds) == 3 and folds[0].min_score <= folds[0].mean_score <= folds[0].max_score


def test_forest_keeps_node_ids_and_does_not_depend_on_the_given_tasks(spark, labelled):
    estimator = modeling.forest(trees=3)
    assert estimator.getCacheNodeIds()
    ready = modeling.fit_preprocessor(labelled, ["a"], ["c"]).transform(labelled)
    dealt = [modeling.spread(rows, "id", rows_per_task=50) for rows in (ready.coalesce(1), ready.repartition(7))]
    assert [rows.rdd.getNumPartitions() for rows in dealt] == [6, 6]
    one, other = (estimator.fit(rows).toDebugString.split("\n", 1)[1] for rows in dealt)
    assert one == other
    assert modeling.spread(ready, "id") is ready


def test_metrics_score_the_rows_once(spark, labelled):
    class Model:
        def transform(self, rows):
            return rows.withColumn("probability", array_to_vector(F.array(1 - noted("a"), noted("a")))).withColumn(
                "prediction", F.col("label").cast("double")
            )

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(a):
        calls.add(1)
        return 1 / (1 + 2.718281828 ** -a)

    assert modeling.test_metrics(Model(), labelled).first().recall == 1.0
    assert calls.value <= 2 * labelled.count()  # twice in the one expression


def test_a_category_of_very_many_levels_is_hashed(spark, tmp_path):
    rows = spark.range(120_000).select(
        (F.col("id") % 7).cast("double").alias("x"),
        F.concat(F.lit("level "), (F.col("id") % 100_000).cast("string")).alias("c"),
        F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.lit("b")).alias("d"),
        (F.col("id") % 2).cast("int").alias("label"),
    )
    pre = modeling.fit_preprocessor(rows, ["x"], ["c", "d"])
    size = modeling.HASH_WIDTH + 2
    assert len(modeling.feature_names(pre)) == size and modeling.feature_names(pre)[-1] == "d_b"
    fitted = modeling.assemble(pre, modeling.logistic(120_000).setMaxIter(3).fit(pre.transform(rows)))
    loaded = modeling.load_pipeline(modeling.save_pipeline(fitted, str(tmp_path / "model")))
    some = spark.createDataFrame([(1.0, "level 5", "a"), (1.0, "never seen", "b"), (1.0, None, "b")], "x double, c string, d string")
    vectors = [r.features for r in loaded.transform(some).select("features").collect()]
    assert all(v.size == size for v in vectors)
    hot = [[i for i in v.indices if 0 < i <= modeling.HASH_WIDTH and v[int(i)]] for v in vectors]
    assert [len(h) for h in hot] == [1, 1, 0]
    assert modeling.score(loaded, some).count() == 3


def test_first_trees_are_the_shorter_fit_and_stages_score_as_separate_fits(spark):
    rows = spark.range(400).select(
        "id", (F.hash("id") % 100 / 50.0).alias("a"), (F.hash(F.col("id") + 7) % 100 / 50.0).alias("b")
    )
    noisy = F.col("a") + F.col("b") + (F.hash(F.col("id") * 3) % 10) / 20.0 > 0
    rows = modeling.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.withColumn("label", noisy.cast("int")))
    rows = rows.coalesce(1).cache()
    trees = modeling.boosted()
    trees.setParams(subsamplingRate=0.8, maxDepth=2)
    long, short = trees.fit(rows, {trees.maxIter: 6}), trees.fit(rows, {trees.maxIter: 3})
    scores = lambda m: [r.p for r in m.transform(rows).orderBy("id").select(vector_to_array("probability").alias("p")).collect()]
    assert scores(modeling.first_trees(long, 3)) == scores(short) != scores(long)
    grid = [{trees.maxIter: n, trees.maxDepth: d} for n in (2, 4) for d in (1, 2)]
    staged = modeling.tune_staged(trees, grid, rows, "label", "id", folds=2)
    separate = modeling.grid_results(modeling.tune(trees, grid, rows, "label", "id", folds=2), spark)
    for a, b in zip(staged.collect(), separate.collect()):
        assert a.parameters == b.parameters and a.fit_seconds > 0
        assert (a.mean_score, a.std_score) == pytest.approx((b.mean_score, b.std_score))


def test_folds_of_a_search_have_tasks_by_their_rows(spark, labelled, monkeypatch):
    rows = modeling.fit_preprocessor(labelled, ["a"], ["c"]).transform(labelled.repartition(7))
    folded = modeling._folded(rows, "label", "id", 3)
    assert folded.persist().rdd.getNumPartitions() == 1 and folded.count() == 300
    folded.unpersist()
    monkeypatch.setattr(modeling, "ROWS_PER_TASK", 50)
    assert modeling._folded(rows, "label", "id", 3).rdd.getNumPartitions() == 6


def test_default_grid():
    assert len(modeling.default_grid(modeling.boosted())) == 36


def test_split_of_many_classes(spark):
    df = spark.range(21_000).select("id", (F.col("id") % 10_500).alias("y"))
    counts = features.stratified_split(df, "y", "id", 0.5).groupBy("is_train").count().collect()
    assert {r.is_train: r["count"] for r in counts} == {True: 10_500, False: 10_500}


def test_one_hot_entries(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, c string")
    assert {tuple(r) for r in features.one_hot_entries(df, "c", "id").collect()} == {(1, 0), (4, 1)}


def test_cells_divide_points_on_a_hot_plane():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 3))
    x[:16_000, 0] = 4.0  # four of five points share the largest value of the widest axis
    cells = neighbours.Cells(x, 6)
    sizes = np.bincount(cells.locate(x) - 64, minlength=64)
    assert sizes.sum() == 20_000 and sizes.max() <= 2 * 20_000 / 64
    same = neighbours.Cells(np.ones((100, 2)), 3)
    assert len(np.unique(same.locate(np.ones((5, 2))))) == 1


def test_models_of_several_kinds_share_one_preparation_and_fit_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(learning, "_SAVED", {})
    prepared, met, prepare = [], threading.Barrier(2, timeout=60), learning._prepared
    monkeypatch.setattr(learning, "_prepared", lambda *a: prepared.append(a) or prepare(*a))

    class Met:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, rows):
            met.wait()  # broken unless the other kind is being fitted at the same time
            return self.estimator.fit(rows)

    small = {"logistic": modeling.logistic, "forest": lambda rows: modeling.forest(2)}
    monkeypatch.setattr(learning, "_estimator", lambda kind, rows: Met(small[kind](rows)))
    models = dict(learning._pipelines(spark, "/root/testdata/sf0.001", list(small)))
    assert [type(models[kind].stages[-1]).__name__ for kind in small] == [
        "LogisticRegressionModel",
        "RandomForestClassificationModel",
    ]
    dict(learning._pipelines(spark, "/root/testdata/sf0.001", list(small)))
    assert len(prepared) == 1


def test_a_forest_of_few_rows_is_grown_in_a_few_tasks():
    tasks = [-(-rows // modeling.forest_rows_per_task(rows)) for rows in (0, 1, 1_200, 12_000, 72_000, 720_000)]
    assert tasks == [0, 1, 1, 4, 4, 36]


def test_the_first_champion_serves_while_the_second_is_fitted_and_models_are_loaded_once(spark, monkeypatch):
    monkeypatch.setattr(learning, "_SAVED", {})
    served, loads, serve, load = threading.Event(), [], learning.jobs.score_with_champion, modeling.load_pipeline

    def noted(*a):
        paths = serve(*a)
        served.set()
        return paths

    class Late:
        def fit(self, rows):
            assert served.wait(60)
            return modeling.forest(2).fit(rows)

    monkeypatch.setattr(learning.jobs, "score_with_champion", noted)
    monkeypatch.setattr(modeling, "load_pipeline", lambda path: loads.append(path) or load(path))
    monkeypatch.setattr(learning, "_estimator", lambda kind, rows: Late() if kind == "forest" else modeling.logistic(rows))
    rows = learning.QUERIES["s1b_champion_stream"](spark, "/root/testdata/sf0.01").collect()
    assert {r.route for r in rows} == {"v1", "v2", "rejected"} and sum(r.n for r in rows) == 1496
    assert [r.n_different for r in rows] == [0, 0, 0] and len(loads) == 2
