"""Training, tuning, evaluation and application of Spark ML classifiers."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    ElementwiseProduct,
    FeatureHasher,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import confidence_level, hard_label, label_text
from tidewatch.functions.schema import Field
from tidewatch.operators import trees
from tidewatch.operators.cleaning import sanitize
from tidewatch.operators.evaluation import ranking_metrics
from tidewatch.operators.features import stratified_folds
from tidewatch.operators.trees import BoostedTrees, Forest
from tidewatch.session import materialize

MAX_TREE_DEPTH = 30  # Spark's own limit
MAX_LEVELS = 10_000  # a category's levels become model metadata; beyond, they are hashed
HASH_WIDTH = 1 << 18  # slots of a hashed category
ROWS_PER_TASK = 20_000  # training rows of a task; Spark would join small files of many rows into one

FOREST_TASKS = 4  # that a forest of fewer rows is grown in, down to this many rows a task
FOREST_ROWS = 3_000

# The tuning grid of the boosted trees.
TREE_COUNTS = [100, 200]
TREE_DEPTHS = [3, 5, 7]
STEP_SIZES = [0.01, 0.1, 0.2]
ROW_SHARES = [0.8, 1.0]


def fit_preprocessor(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    max_levels: int = MAX_LEVELS,
    hash_width: int = HASH_WIDTH,
) -> PipelineModel:
    """Scaled numbers and one-hot categories in one ``features`` vector.

    Numbers are scaled by the population deviation. The first sorted level of
    each category is dropped and an unknown level becomes all zeros: levels are
    indexed in descending order, so the first one is last, next to the slot for
    unknown values, and both slots are sliced away.

    A category of more than ``max_levels`` levels needs no table of them: its values are hashed into
    ``hash_width`` slots of a sparse vector. Levels may then share a slot, an unknown one falls into
    the slot of its hash, and a null stays all zeros.
    """
    rows = train.count()
    # Spark divides by the sample deviation; this turns it into the population one.
    correction = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    stages = [
        VectorAssembler(inputCols=list(numeric), outputCol="_numbers", handleInvalid="error"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ElementwiseProduct(
            scalingVec=Vectors.dense([correction] * len(numeric)), inputCol="_scaled", outputCol="_standard"
        ),
    ]
    parts = ["_standard"]
    for c in categorical:
        if train.select(c).distinct().limit(max_levels + 1).count() > max_levels:
            stages.append(
                FeatureHasher(inputCols=[c], categoricalCols=[c], outputCol=f"_flags_{c}", numFeatures=hash_width)
            )
            parts.append(f"_flags_{c}")
            continue
        indexer = StringIndexer(
            inputCol=c, outputCol=f"_index_{c}", handleInvalid="keep", stringOrderType="alphabetDesc"
        ).fit(train)
        kept = list(range(len(indexer.labels) - 1))
        stages += [indexer, OneHotEncoder(inputCol=f"_index_{c}", outputCol=f"_hot_{c}", dropLast=True)]
        if kept:
            stages.append(VectorSlicer(inputCol=f"_hot_{c}", outputCol=f"_flags_{c}", indices=kept))
            parts.append(f"_flags_{c}")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error"))
    return Pipeline(stages=stages).fit(train)


def feature_names(preprocessor: PipelineModel) -> list[str]:
    """Names in the order of the ``features`` vector."""
    names: list[str] = []
    for stage in preprocessor.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "_numbers":
            names += stage.getInputCols()
        elif isinstance(stage, FeatureHasher):
            names += [f"{stage.getInputCols()[0]}#{i}" for i in range(stage.getNumFeatures())]
        elif hasattr(stage, "labels"):
            names += [f"{stage.getInputCol()}_{level}" for level in stage.labels[:-1]]
    return names


def spread(rows: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Training rows dealt by key to a number of tasks that follows from their count alone.

    Bootstrap samples are drawn by task, so the same rows give the same model on every cluster.
    """
    tasks = -(-rows.count() // rows_per_task)
    return rows if tasks <= 1 else rows.repartition(tasks, key).sortWithinPartitions(key)


def forest_rows_per_task(rows: int, tasks: int = FOREST_TASKS) -> int:
    """Rows of a task where all trees of a forest grow at once: a few tasks share even few rows.

    Not more: each task sends the bins of all nodes of a level, whatever its rows.
    """
    return min(ROWS_PER_TASK, max(FOREST_ROWS, -(-rows // tasks)))


def logistic(rows: int, label: str = "label") -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=1000, regParam=1.0 / max(1, rows), standardization=False
    )


def forest(trees: int = 100, label: str = "label", seed: int = 42, max_depth: int = MAX_TREE_DEPTH) -> Forest:
    """Trees as deep as Spark grows them; pass a smaller ``max_depth`` for very large tables.

    Where Spark's trainer grows them, the node that each row has reached is kept with the row; else every task of a
    level is sent all trees so far.
    """
    return Forest(featuresCol="features", labelCol=label, numTrees=trees, seed=seed, maxDepth=max_depth, cacheNodeIds=True)


def boosted(rounds: int = 100, label: str = "label", seed: int = 42) -> BoostedTrees:
    return BoostedTrees(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed)


def default_grid(estimator: GBTClassifier, rounds: Sequence[int] = TREE_COUNTS) -> list[Mapping[Param, object]]:
    return (
        ParamGridBuilder()
        .addGrid(estimator.maxIter, list(rounds))
        .addGrid(estimator.maxDepth, TREE_DEPTHS)
        .addGrid(estimator.stepSize, STEP_SIZES)
        .addGrid(estimator.subsamplingRate, ROW_SHARES)
        .build()
    )


def with_probability(scored: DataFrame, out: str = "churn_probability") -> DataFrame:
    """Positive-class probability (largest one for several classes) as a plain column."""
    probabilities = vector_to_array("probability")
    return scored.withColumn(
        out, F.when(F.size(probabilities) == 2, F.get(probabilities, F.lit(1))).otherwise(F.array_max(probabilities))
    )


def test_metrics(model, test: DataFrame, label: str = "label") -> DataFrame:
    """AUC and recall of a fitted model as one row."""
    # Scored once: the metrics read it several times, and each job that scores is sent the whole model.
    scored = materialize(with_probability(model.transform(test)).select(label, "prediction", "churn_probability"))
    recall = scored.agg(
        F.avg(F.when(F.col(label) == 1, (F.col("prediction") == 1).cast("double"))).alias("recall")
    )
    return ranking_metrics(scored, label, "churn_probability").select("roc_auc").join(F.broadcast(recall))  # one row


def compare_models(estimators: Mapping[str, object], train: DataFrame, test: DataFrame, label: str = "label"):
    """``(model, roc_auc, recall)``, one fit per estimator, side by side, and the fitted models."""

    def fit(name: str):
        model = estimators[name].fit(train)
        return model, test_metrics(model, test, label).withColumn("model", F.lit(name))

    with ThreadPool(len(estimators)) as pool:
        done = pool.map(inheritable_thread_target(train.sparkSession)(fit), list(estimators))
    rows = reduce(DataFrame.unionByName, [part for _, part in done])
    return rows, {name: model for name, (model, _) in zip(estimators, done)}


def _folded(train: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Folds in as many tasks as their rows need: a search runs thousands of jobs, each of so many tasks."""
    folded = stratified_folds(train, label, key, folds).withColumn("fold", F.col("fold").cast("int"))
    return folded.repartition(max(1, -(-train.count() // ROWS_PER_TASK)), key).sortWithinPartitions(key)


def tune(
    estimator, grid: Sequence[Mapping], train: DataFrame, label: str, key: str, folds: int = 3, parallelism: int = 4
) -> CrossValidatorModel:
    """Grid search by AUC over exact stratified folds."""
    folded = _folded(train, label, key, folds)
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=list(grid),
        evaluator=evaluator,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    ).fit(folded)


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The ensemble of the first rounds of a boosted fit.

    Rounds build on each other and take their seeds from their place, so this is the model that a fit
    of so many rounds gives.
    """
    whole = model._java_obj
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    first = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(whole.trees())[:rounds], list(whole.treeWeights())[:rounds])):
        first[i], weights[i] = tree, weight
    part = jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), first, weights)
    return GBTClassificationModel(whole.copyValues(part, whole.extractParamMap()))


def tune_staged(
    estimator: GBTClassifier,
    grid: Sequence[Mapping],
    train: DataFrame,
    label: str,
    key: str,
    folds: int = 3,
    parallelism: int = 8,
) -> DataFrame:
    """Grid search by AUC over exact stratified folds; one fit serves all numbers of rounds.

    Points that differ only in ``maxIter`` share the fit of their largest number: the smaller ones
    are its first trees. Each fit is one task over the counted cells of its fold (:mod:`trees`). Returns ``(parameters, mean_score, std_score, fit_seconds)``, one row a point.
    """
    spark = train.sparkSession
    folded = _folded(train, label, key, folds).persist()
    groups: dict[tuple, list[Mapping]] = {}
    for point in grid:
        rest = tuple(sorted((p.name, v) for p, v in point.items() if p.name != "maxIter"))
        groups.setdefault(rest, []).append(point)
    scored = _scored_in_tasks(estimator, grid, list(groups.values()), folded, label, folds)
    if scored is None:
        scored = _scored_by_spark(estimator, grid, list(groups.values()), folded, label, folds, parallelism)
    folded.unpersist()
    rows = []
    for i, point in enumerate(grid):
        mine = [(score, seconds) for part in scored for at, score, seconds in part if at == i]
        values = np.array([score for score, _ in mine])
        names = {p.name: str(v) for p, v in point.items()}
        rows.append((names, float(values.mean()), float(values.std()), sum(seconds for _, seconds in mine)))
    schema = "parameters map<string,string>, mean_score double, std_score double, fit_seconds double"
    return spark.createDataFrame(rows, schema)


def _scored_in_tasks(estimator, grid, groups, folded: DataFrame, label: str, folds: int) -> list | None:
    """``(point, AUC, seconds)`` of each group of points and fold, a task each; None if Spark has to train."""
    plans = [trees.boosting_plan(estimator, dict(max(g, key=lambda p: p[estimator.maxIter]))) for g in groups]
    if None in plans:
        return None
    spark, features = folded.sparkSession, estimator.getFeaturesCol()

    def count(fold: int) -> trees.Cells | None:
        return trees.counted(folded, features, label, estimator.getMaxBins(), estimator.getSeed(), F.col("fold") == fold)

    with ThreadPool(folds) as pool:
        cells = pool.map(inheritable_thread_target(spark)(count), range(folds))
    if None in cells:
        return None
    jobs = []
    for points, plan in zip(groups, plans):
        wanted = [(grid.index(p), p[estimator.maxIter]) for p in points]
        jobs += [(fold, plan, wanted) for fold in range(folds)]
    jobs.sort(key=lambda job: -job[1]["rounds"] * job[1]["depth"])  # the longest first
    sent = spark.sparkContext.broadcast(cells)

    def fit(job: tuple) -> list[tuple[int, float, float]]:
        fold, plan, wanted = job
        start = time.perf_counter()
        _, areas = trees.boost(sent.value[fold], plan, [n for _, n in wanted])
        seconds = time.perf_counter() - start
        return [(at, area, seconds) for (at, _), area in zip(wanted, areas)]

    scored = spark.sparkContext.parallelize(jobs, len(jobs)).map(fit).collect()
    sent.unpersist()
    return scored


def _scored_by_spark(estimator, grid, groups, folded: DataFrame, label: str, folds: int, parallelism: int) -> list:
    """The same by Spark's trainer, ``parallelism`` fits at a time."""
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)

    def fit(job: tuple[list[Mapping], int]) -> list[tuple[int, float, float]]:
        points, fold = job
        start = time.perf_counter()
        most = max(points, key=lambda point: point[estimator.maxIter])
        model = estimator.fit(folded.where(F.col("fold") != fold), dict(most))
        seconds = time.perf_counter() - start
        held = folded.where(F.col("fold") == fold)
        return [
            (grid.index(p), float(evaluator.evaluate(first_trees(model, p[estimator.maxIter]).transform(held))), seconds)
            for p in points
        ]

    run = inheritable_thread_target(folded.sparkSession)(fit)
    with ThreadPool(parallelism) as pool:
        return pool.map(run, [(points, fold) for points in groups for fold in range(folds)])


def grid_results(tuned: CrossValidatorModel, spark) -> DataFrame:
    """``(parameters, mean_score, std_score)``, one row per grid point."""
    rows = []
    for params, mean, std in zip(tuned.getEstimatorParamMaps(), tuned.avgMetrics, tuned.stdMetrics):
        rows.append(({p.name: str(v) for p, v in params.items()}, float(mean), float(std)))
    return spark.createDataFrame(rows, "parameters map<string,string>, mean_score double, std_score double")


def best_parameters(results: DataFrame) -> DataFrame:
    return results.agg(F.max_by("parameters", "mean_score").alias("parameters"), F.max("mean_score").alias("mean_score"))


def cross_validate(estimator, df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Accuracy per stratified fold, fitted side by side, with mean, population std, min and max."""
    folded = _folded(df, label, key, folds).persist()
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def fit(i: int) -> tuple[int, float]:
        model = estimator.fit(folded.where(F.col("fold") != i))
        return i, float(evaluator.evaluate(model.transform(folded.where(F.col("fold") == i))))

    with ThreadPool(folds) as pool:
        scores = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(folds))
    folded.unpersist()
    rows = df.sparkSession.createDataFrame(scores, "fold int, score double")
    summary = rows.agg(
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )
    return rows.join(F.broadcast(summary))  # one row


def assemble(preprocessor: PipelineModel, classifier) -> PipelineModel:
    """One pipeline from raw columns to prediction."""
    return PipelineModel(stages=[*preprocessor.stages, classifier])


def save_pipeline(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model, df: DataFrame, fields: Sequence[Field] | None = None) -> DataFrame:
    """Input columns, label and probability in one pass.

    With ``fields`` the input is sanitized on the way; that leaves cells within
    the rules alone, so no pass is spent on finding out whether it is needed.
    """
    if fields is not None:
        df = sanitize(df, fields)
    scored = with_probability(model.transform(df))
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), "churn_probability")


def predict_churn(model, df: DataFrame) -> DataFrame:
    """The input with ``Predicted_Churn`` and ``Churn_Probability``."""
    return score(model, df).withColumnsRenamed(
        {"prediction": "Predicted_Churn", "churn_probability": "Churn_Probability"}
    )


def rich_prediction(model, df: DataFrame, inputs: Sequence[str], asof: str, version: str) -> DataFrame:
    """One nested result per row: label text, confidence, echoed inputs, version and time."""
    scored = score(model, df)
    label = hard_label("churn_probability")
    return scored.select(
        *df.columns,
        "prediction",
        label_text("prediction").alias("prediction_label"),
        "churn_probability",
        confidence_level("churn_probability").alias("confidence_level"),
        F.struct(*inputs).alias("input_features"),
        F.lit(version).alias("model_version"),
        F.lit(asof).cast("timestamp_ntz").alias("prediction_timestamp"),
        (label == F.col("prediction")).alias("label_matches_threshold"),
    )


def feature_importance(model, names: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Importances of a tree model, largest first."""
    values = model.featureImportances.toArray()
    if len(values) != len(names):
        names = [f"feature_{i}" for i in range(len(values))]
    rows = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    ).orderBy(F.col("importance").desc(), "feature")
    return rows if top is None else rows.limit(top)
