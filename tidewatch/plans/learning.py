"""Queries over feature pipelines, splits, neighbours and trained models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.functions.schema import REQUEST_FIELDS
from tidewatch.operators import features, hashing, modeling, neighbours, validation
from tidewatch.operators.registry import ModelRegistry
from tidewatch.plans.catalog import QUERIES, SCORED, SUBS, query
from tidewatch.plans.cleaning import ROUTED
from tidewatch.plans.inputs import NUMBERS, scored_subscribers
from tidewatch.session import materialize, scratch_path
from tidewatch.sources.tables import ASOF, RAW_FIELDS, subscribers, table
from tidewatch.streaming import jobs

CATEGORIES = ["Contract"]
SPLIT = f"""{SUBS},
sp AS (SELECT *, row_number() OVER (PARTITION BY "Churn" ORDER BY md5(CAST(customer_id AS VARCHAR)))
  <= floor(0.8e0 * count(*) OVER (PARTITION BY "Churn") + 1e-9) AS is_train FROM subs)"""


def _split(spark, folder):
    def save(path):
        rows = subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES, F.col("Churn").alias("label"))
        features.stratified_split(rows, "label", "customer_id").write.parquet(path)

    split = spark.read.parquet(_once(spark, folder, "split", save))
    return split.where("is_train").drop("is_train"), split.where(~F.col("is_train")).drop("is_train")


def _prepared(spark, folder):
    """Preprocessor fitted on the training part, and both parts transformed."""
    train, test = _split(spark, folder)
    key = _key(spark, folder, "preprocessor")
    with _lock(key):
        if key not in _PREPROCESSORS:
            _PREPROCESSORS[key] = modeling.fit_preprocessor(train, NUMBERS, CATEGORIES)
    pre = _PREPROCESSORS[key]
    return pre, pre.transform(train), pre.transform(test)


@query(
    "m1_preprocessed",
    f"""WITH {SUBS}, s AS (SELECT avg(tenure) AS a, stddev_pop(tenure) AS b, avg("MonthlyCharges") AS c,
      stddev_pop("MonthlyCharges") AS d, avg("TotalCharges") AS e, stddev_pop("TotalCharges") AS f FROM subs)
    SELECT customer_id, round((tenure - a) / b, 6) AS f0, round(("MonthlyCharges" - c) / d, 6) AS f1,
      round(("TotalCharges" - e) / f, 6) AS f2, CAST("Contract" = 'MACHINERY' AS INT)::DOUBLE AS f3,
      CAST("Contract" = 'HOUSEHOLD' AS INT)::DOUBLE AS f4, CAST("Contract" = 'FURNITURE' AS INT)::DOUBLE AS f5,
      CAST("Contract" = 'BUILDING' AS INT)::DOUBLE AS f6 FROM subs, s""",
)
def _(spark, folder):
    rows = subscribers(spark, folder)
    pre = modeling.fit_preprocessor(rows, NUMBERS, CATEGORIES)
    vector = pre.transform(rows).select("customer_id", vector_to_array("features").alias("f"))
    return vector.select("customer_id", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(7)])


@query(
    "m2_standard_scaling",
    """WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c,
      stddev_pop(l_extendedprice) AS d FROM lineitem)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity - a) / b, 6) AS l_quantity,
      round((l_extendedprice - c) / d, 6) AS l_extendedprice FROM lineitem, s""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return features.standardize(rows, ["l_quantity", "l_extendedprice"])


@query(
    "m3_label_encoding",
    """WITH k AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part))
    SELECT p_partkey, CAST(code AS BIGINT) AS brand_code FROM part JOIN k USING (p_brand)""",
)
def _(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return features.label_encode(part, "p_brand", "brand_code").drop("p_brand")


@query(
    "m4_one_hot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS "o_orderstatus_O",
    CAST(o_orderstatus = 'P' AS BIGINT) AS "o_orderstatus_P" FROM orders""",
)
def _(spark, folder):
    return features.encode(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query(
    "m5_stratified_split",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)))
    <= floor(0.8e0 * count(*) OVER (PARTITION BY o_orderstatus) + 1e-9) AS is_train FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return features.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query(
    "m5b_stratified_folds",
    """WITH r AS (SELECT o_orderkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders
      WINDOW w AS (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))))
    SELECT o_orderkey, CAST((i > floor(0.2e0 * n + 1e-9))::INT + (i > floor(0.4e0 * n + 1e-9))::INT
      + (i > floor(0.6e0 * n + 1e-9))::INT + (i > floor(0.8e0 * n + 1e-9))::INT AS BIGINT) AS fold FROM r""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return features.stratified_folds(orders, "o_orderstatus", "o_orderkey", 5).drop("o_orderstatus")


@query(
    "c8_nearest_neighbours",
    f"""WITH {SUBS}, c AS (SELECT customer_id, tenure, "MonthlyCharges" AS m, "TotalCharges" AS t FROM subs WHERE "Churn" = 1),
    d AS (SELECT a.customer_id, b.customer_id AS neighbour,
      (a.tenure - b.tenure) * (a.tenure - b.tenure) + (a.m - b.m) * (a.m - b.m) + (a.t - b.t) * (a.t - b.t) AS d2
      FROM c a JOIN c b ON a.customer_id <> b.customer_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d2, neighbour) AS rank FROM d)
    SELECT customer_id, CAST(rank AS BIGINT) AS rank, neighbour, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 5""",
)
def _(spark, folder):
    churned = subscribers(spark, folder).where(F.col("Churn") == 1)
    near = neighbours.nearest_neighbours(churned, "customer_id", NUMBERS, 5)
    return near.select("customer_id", F.posexplode("neighbours").alias("rank", "n")).select(
        "customer_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.distance").alias("distance")
    )


@query(
    "c8b_hashed_neighbours",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
    d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
    SELECT vec_id, CAST(rank AS BIGINT) AS rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
)
def _(spark, folder):
    """Hash tables over wide vectors. Tables of a single bucket, as on small data, give the exact neighbours."""
    near = hashing.hashed_neighbours(table(spark, folder, "embeddings"), "vec_id", F.col("embedding"), 5, vectors=False)
    return near.select("vec_id", F.posexplode("neighbours").alias("rank", "n")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour"), F.col("n.distance").alias("distance")
    )


@query(
    "m6_oversampled",
    f"""WITH {SUBS}, n AS (SELECT count(*) FILTER ("Churn" = 0) AS a, count(*) FILTER ("Churn" = 1) AS b FROM subs)
    SELECT CAST(0 AS BIGINT) AS "Churn", greatest(a, b) AS n_rows, greatest(b - a, 0) AS n_synthetic, true AS inside FROM n
    UNION ALL SELECT 1, greatest(a, b), greatest(a - b, 0), true FROM n""",
)
def _(spark, folder):
    rows = subscribers(spark, folder)
    balanced = neighbours.oversample_minority(rows, "Churn", "customer_id", NUMBERS)
    limits = rows.groupBy("Churn").agg(
        *[F.min(c).alias(f"lo_{c}") for c in NUMBERS], *[F.max(c).alias(f"hi_{c}") for c in NUMBERS]
    )
    inside = F.lit(True)
    for c in NUMBERS:
        inside = inside & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return (
        balanced.join(F.broadcast(limits), "Churn")  # one row per class
        .groupBy("Churn")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("is_synthetic").alias("n_synthetic"),
            F.bool_and(inside).alias("inside"),
        )
    )


# Fitted once a session and data folder, saved, and loaded by every query that uses it.
_SAVED: dict[tuple, str] = {}
_PREPROCESSORS: dict[tuple, PipelineModel] = {}
_LOCKS: dict[tuple, Lock] = {}


def _lock(key: tuple) -> Lock:
    """Queries fit side by side; what two of them need is fitted by the first."""
    return _LOCKS.setdefault(key, Lock())


def _key(spark, folder, name: str) -> tuple:
    return spark.sparkContext.applicationId, folder, name


def _once(spark, folder, name: str, save) -> str:
    """Path of what ``save(path)`` wrote for this name."""
    key = _key(spark, folder, name)
    with _lock(key):
        if key not in _SAVED:
            path = scratch_path(spark, name)
            save(path)
            _SAVED[key] = path
        return _SAVED[key]


def _estimator(kind: str, rows: int):
    return {"logistic": lambda: modeling.logistic(rows), "forest": modeling.forest, "boosted": modeling.boosted}[kind]()


def _pipelines(spark, folder, kinds: Sequence[str]) -> Iterator[tuple[str, PipelineModel]]:
    """Preprocessor and classifier in one for each kind, fitted on the training part.

    The kinds share one preparation and are fitted side by side: boosting runs hundreds of short jobs one
    after the other and leaves most cores to the forest. Each is given out, in the order asked for, as soon as it is ready.
    """
    pre = train = rows = None
    if any(_key(spark, folder, f"model-{kind}") not in _SAVED for kind in kinds):
        pre, train, _ = _prepared(spark, folder)
        rows = train.count()

    def fit(kind: str) -> PipelineModel:
        def save(path):
            per_task = modeling.forest_rows_per_task(rows) if kind == "forest" else modeling.ROWS_PER_TASK
            classifier = _estimator(kind, rows).fit(modeling.spread(train, "customer_id", per_task))
            modeling.save_pipeline(modeling.assemble(pre, classifier), path)

        return modeling.load_pipeline(_once(spark, folder, f"model-{kind}", save))

    with ThreadPool(len(kinds)) as pool:
        yield from zip(kinds, pool.imap(inheritable_thread_target(spark)(fit), kinds))


def _pipeline(spark, folder, kind: str = "logistic") -> PipelineModel:
    return dict(_pipelines(spark, folder, [kind]))[kind]


def _metrics(spark, folder, kind: str):
    return modeling.test_metrics(_pipeline(spark, folder, kind), _split(spark, folder)[1])


@query("m7_logistic_regression")
def _(spark, folder):
    return _metrics(spark, folder, "logistic")


@query("m8_random_forest")
def _(spark, folder):
    return _metrics(spark, folder, "forest")


@query("m9_boosted_trees")
def _(spark, folder):
    return _metrics(spark, folder, "boosted")


def _balanced(spark, folder):
    """Training rows preprocessed first, then balanced by oversampling in that space; and the test rows."""

    def save(path):
        pre, train, _ = _prepared(spark, folder)
        size = len(modeling.feature_names(pre))
        flat = train.select("label", "customer_id", vector_to_array("features").alias("f"))
        columns = [f"f{i}" for i in range(size)]
        flat = flat.select("label", "customer_id", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])
        rows = neighbours.oversample_minority(materialize(flat), "label", "customer_id", columns)
        # Synthetic rows get keys of their own below all customers, for the folds.
        key = F.coalesce("customer_id", -1 - F.monotonically_increasing_id())
        rows.select("label", key.alias("customer_id"), F.array(*columns).alias("f")).write.parquet(path)

    rows = spark.read.parquet(_once(spark, folder, "balanced", save))
    _, _, test = _prepared(spark, folder)
    rows = rows.select("label", "customer_id", array_to_vector("f").alias("features"))
    return modeling.spread(rows, "customer_id"), test


@query("m10_model_comparison")
def _(spark, folder):
    """Logistic regression, 100 trees and 100 boosting rounds on the balanced training rows."""

    def save(path):
        balanced, test = _balanced(spark, folder)
        models = {"Logistic": "logistic", "RandomForest": "forest", "BoostedTrees": "boosted"}
        estimators = {name: _estimator(kind, balanced.count()) for name, kind in models.items()}
        modeling.compare_models(estimators, balanced, test)[0].write.parquet(path)

    return spark.read.parquet(_once(spark, folder, "comparison", save))


def _grid_rows(spark, folder):
    def save(path):
        balanced, _ = _balanced(spark, folder)
        trees = modeling.boosted()
        modeling.tune_staged(trees, modeling.default_grid(trees), balanced, "label", "customer_id", folds=3).write.parquet(path)

    return spark.read.parquet(_once(spark, folder, "grid", save))


@query("m11_grid_search")
def _(spark, folder):
    names = {"maxIter": "rounds", "maxDepth": "max_depth", "stepSize": "step_size", "subsamplingRate": "row_share"}
    return _grid_rows(spark, folder).select(
        *[F.element_at("parameters", k).alias(v) for k, v in names.items()], "mean_score", "std_score"
    )


@query("t5_best_parameters")
def _(spark, folder):
    best = modeling.best_parameters(_grid_rows(spark, folder))
    return best.select(F.to_json("parameters").alias("parameters"), "mean_score")


def _folds(spark, folder):
    def save(path):
        _, train, _ = _prepared(spark, folder)
        scores = modeling.cross_validate(modeling.logistic(train.count()), train, "label", "customer_id", folds=5)
        scores.write.parquet(path)

    return spark.read.parquet(_once(spark, folder, "folds", save))


@query("g9_cross_validation")
def _(spark, folder):
    return _folds(spark, folder)


@query(
    "a9_model_roundtrip",
    f"""WITH {SUBS} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM subs""",
)
def _(spark, folder):
    model = _pipeline(spark, folder)
    loaded = modeling.load_pipeline(modeling.save_pipeline(model, scratch_path(spark, "model")))
    rows = subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES)
    before = modeling.score(model, rows).select("customer_id", F.col("churn_probability").alias("before"))
    after = modeling.score(loaded, rows).select("customer_id", F.col("churn_probability").alias("after"))
    return before.join(after, "customer_id").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different")
    )


@query(
    "m12_export_champion",
    f"""WITH {SUBS} SELECT 'v2.0.0' AS version, 'boosted trees' AS model_type, CAST(count(*) AS BIGINT) AS n_scored,
    CAST(count(*) AS BIGINT) AS n_probable FROM subs""",
)
def _(spark, folder):
    """Refit the best grid point on the balanced rows, export it, and score with what the registry returns."""
    best = modeling.best_parameters(_grid_rows(spark, folder)).first().parameters
    balanced, _ = _balanced(spark, folder)
    trees = modeling.boosted(int(best["maxIter"]))
    trees.setParams(
        maxDepth=int(best["maxDepth"]), stepSize=float(best["stepSize"]), subsamplingRate=float(best["subsamplingRate"])
    )
    pre = _prepared(spark, folder)[0]
    store = ModelRegistry(spark, scratch_path(spark, "registry"))
    row = balanced.agg(F.count("*").alias("training_rows")).select(
        "training_rows", F.lit(ASOF).cast("timestamp_ntz").alias("created"), F.lit("boosted trees").alias("model_type")
    )
    store.register_model(modeling.assemble(pre, trees.fit(balanced)), row, "v2.0.0", ASOF)
    champion = modeling.load_pipeline(store.champion_path())
    scored = modeling.score(champion, subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES))
    p = F.col("churn_probability")
    counted = scored.agg(F.count(p).alias("n_scored"), F.count_if(p.between(0, 1)).alias("n_probable"))
    return store.champion().select("version", "model_type").join(F.broadcast(counted))  # one row


@query("m13_scored_table")
def _(spark, folder):
    rows = subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES)
    return modeling.score(_pipeline(spark, folder), rows, REQUEST_FIELDS)


@query("m14_predicted_churn")
def _(spark, folder):
    rows = subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES)
    return modeling.predict_churn(_pipeline(spark, folder), rows)


@query("m15_rich_predictions")
def _(spark, folder):
    rows = subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES)
    rich = modeling.rich_prediction(_pipeline(spark, folder), rows, [*NUMBERS, *CATEGORIES], ASOF, "v1.0")
    return rich.drop(*NUMBERS, *CATEGORIES).withColumn("input_features", F.to_json("input_features"))


@query("m16_fixed_weight_score", f"""WITH {SCORED} SELECT customer_id, churn_probability FROM scored""")
def _(spark, folder):
    return scored_subscribers(spark, folder).select("customer_id", "churn_probability")


@query(
    "s1b_champion_stream",
    f"""WITH {ROUTED}
    SELECT CASE WHEN len(reasons) > 0 THEN 'rejected' WHEN customer_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS route,
      CAST(count(*) AS BIGINT) AS n, CAST(sum(len(reasons)) AS BIGINT) AS n_reasons, CAST(0 AS BIGINT) AS n_different
    FROM r GROUP BY 1""",
)
def _(spark, folder):
    """Requests in text form, served by the champion; the champion changes between two runs of one job.

    ``n_different`` counts scores that differ from those of the same model in batch.
    """
    numbers = [F.expr(RAW_FIELDS[c]).alias(c) for c in NUMBERS]
    requests = materialize(subscribers(spark, folder).select("customer_id", *numbers, *CATEGORIES))
    source, home = scratch_path(spark, "requests"), scratch_path(spark, "served")
    store = ModelRegistry(spark, scratch_path(spark, "registry"))
    row = spark.range(1).select(F.lit(ASOF).cast("timestamp_ntz").alias("created"))
    models = {}
    # The first champion serves while the second is still being fitted.
    for i, (_, model) in enumerate(_pipelines(spark, folder, ["logistic", "forest"])):
        version = f"v{i + 1}"
        models[version] = model
        requests.where(F.col("customer_id") % 2 == i).write.mode("append").parquet(source)
        store.register_model(model, row, version, f"2000-08-0{i + 1} 00:00:00")
        stream = spark.readStream.schema(requests.schema).parquet(source)
        scored_path, rejected_path = jobs.score_with_champion(stream, spark, store, REQUEST_FIELDS, "MonthlyCharges", home)
    served = spark.read.parquet(scored_path).select("customer_id", "model_version", "churn_probability")
    valid, _ = validation.split_requests(requests, REQUEST_FIELDS)
    batch = None
    for version, model in models.items():
        scored = modeling.score(model, valid, REQUEST_FIELDS)
        part = scored.select("customer_id", F.lit(version).alias("model_version"), F.col("churn_probability").alias("p"))
        batch = part if batch is None else batch.unionByName(part)
    differs = ~F.col("churn_probability").eqNullSafe(F.col("p"))
    good = served.join(batch, ["customer_id", "model_version"], "left").groupBy(F.col("model_version").alias("route")).agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("n_reasons"), F.count_if(differs).alias("n_different")
    )
    bad = spark.read.parquet(rejected_path).groupBy(F.lit("rejected").alias("route")).agg(
        F.count("*").alias("n"), F.sum(F.size("reasons")).alias("n_reasons"), F.lit(0).cast("long").alias("n_different")
    )
    return good.unionByName(bad)


def _importance(spark, folder, top):
    model = _pipeline(spark, folder, "forest")
    return modeling.feature_importance(model.stages[-1], modeling.feature_names(model), spark, top)


@query("t2_feature_importance")
def _(spark, folder):
    return _importance(spark, folder, 10)


def _built_comparison(spark, folder):
    """The three kinds of model on a label built from the scaled numbers."""

    def save(path):
        _, train, test = _prepared(spark, folder)
        numbers = vector_to_array("features")
        label = (numbers[0] + numbers[1] + numbers[2] > 0.5).cast("int")
        train, test = train.withColumn("label", label), test.withColumn("label", label)
        estimators = {"Logistic": _estimator("logistic", train.count()), "RandomForest": modeling.forest(10)}
        estimators["BoostedTrees"] = modeling.boosted(10)
        modeling.compare_models(estimators, train, test)[0].write.parquet(path)

    return spark.read.parquet(_once(spark, folder, "built", save))


# Properties that every fit must have, for the fits that SQL cannot repeat.


@query(
    "m13b_scoring_properties",
    f"""WITH {SUBS}, k(source) AS (VALUES ('logistic'), ('forest'), ('boosted'))
    SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT customer_id) AS BIGINT) AS n_customers,
      CAST(0 AS BIGINT) AS n_improbable, CAST(0 AS BIGINT) AS n_label_differs, true AS varied FROM k, subs GROUP BY source""",
)
def _(spark, folder):
    """Every customer once, probabilities within [0, 1], and the label says whether it reaches one half."""
    rows = materialize(subscribers(spark, folder).select("customer_id", *NUMBERS, *CATEGORIES))
    rows = modeling.spread(rows, "customer_id")  # a few megabytes would be scored by one task
    parts = None
    for kind, model in _pipelines(spark, folder, ["logistic", "forest", "boosted"]):
        scored = modeling.rich_prediction(model, rows, [*NUMBERS, *CATEGORIES], ASOF, "v1.0")
        p = F.col("churn_probability")
        part = scored.agg(
            F.lit(kind).alias("source"),
            F.count("*").alias("n_rows"),
            F.countDistinct("customer_id").alias("n_customers"),
            F.count_if(~p.between(0, 1) | p.isNull()).alias("n_improbable"),
            F.count_if((p > 0.5 + 1e-9) & (F.col("prediction") != 1) | (p < 0.5 - 1e-9) & (F.col("prediction") != 0)).alias(
                "n_label_differs"
            ),
            (F.countDistinct(p) > 10).alias("varied"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query(
    "m11b_search_properties",
    """SELECT CAST(36 AS BIGINT) AS n_points, CAST(36 AS BIGINT) AS n_different, true AS within, true AS best_is_largest,
    CAST(5 AS BIGINT) AS n_folds, true AS mean_fits, CAST(3 AS BIGINT) AS n_models, true AS scores_within,
    true AS finds_built_label,
    true AS importances_sum_to_one FROM (SELECT count(*) FROM orders)""",
)
def _(spark, folder):
    """The whole grid was scored, the best point is its largest, folds, comparison and importances add up.

    Whether a customer comes back is nearly random in these tables, so skill is asked for on a label that depends on
    the features: each kind of model has to order the test rows by it almost without fault.
    """
    fits = (
        _grid_rows,
        _folds,
        QUERIES["m10_model_comparison"],
        _built_comparison,
        lambda spark, folder: _importance(spark, folder, None),
    )
    # Fitted side by side: most of them run many short jobs.
    with ThreadPool(len(fits)) as pool:
        run = inheritable_thread_target(spark)(lambda fit: fit(spark, folder))
        grid, folds, comparison, built, importance = pool.map(run, fits)
    best = modeling.best_parameters(grid).select(F.col("mean_score").alias("best"))
    points = grid.agg(
        F.count("*").alias("n_points"),
        F.countDistinct(F.to_json("parameters")).alias("n_different"),
        F.bool_and(F.col("mean_score").between(0, 1)).alias("within"),
        F.max("mean_score").alias("largest"),
    )
    folds = folds.agg(
        F.count("*").alias("n_folds"),
        (F.abs(F.avg("score") - F.max("mean_score")) < 1e-9).alias("mean_fits"),
    )
    within = F.col("roc_auc").between(0, 1) & F.col("recall").between(0, 1)
    models = comparison.agg(
        F.count("*").alias("n_models"), F.bool_and(within).alias("scores_within")
    )
    skill = built.agg((F.min("roc_auc") > 0.9).alias("finds_built_label"))
    shares = importance.agg(
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("importances_sum_to_one")
    )
    joined = points
    for one in (best, folds, models, skill, shares):
        joined = joined.join(F.broadcast(one))
    return joined.select(  # one row each
        "n_points", "n_different", "within", (F.col("best") == F.col("largest")).alias("best_is_largest"), "n_folds",
        "mean_fits", "n_models", "scores_within", "finds_built_label", "importances_sum_to_one",
    )
