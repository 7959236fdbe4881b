"""Classifier evaluation from counts; nothing is collected.

Labels and predictions are counted per class pair, scores per distinct value,
so each metric works on aggregates. Curves use range-wise running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import divide_or_zero, metric_text
from tidewatch.operators.ordered import nan_to_null, running_totals


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``(label, prediction, n)`` on the full grid of classes seen on either side.

    The grid pairs classes (few), not rows.
    """
    counts = df.groupBy(F.col(label).cast("bigint").alias("label"), F.col(pred).cast("bigint").alias("prediction")).agg(
        F.count("*").alias("n")
    )
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    sets = counts.agg(
        F.array_union(F.collect_set("label"), F.collect_set("prediction")).alias("classes")
    )
    grid = classes.join(F.broadcast(sets)).select(  # one row holding the class list
        F.col("c").alias("label"), F.explode("classes").alias("prediction")
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    counts = df.groupBy(F.col(label).cast("bigint").alias("y"), F.col(pred).cast("bigint").alias("p")).agg(
        F.count("*").alias("n")
    )
    sides = counts.select(
        "n",
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("predicted")),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("predicted")),
            )
        ),
        (F.col("y") == F.col("p")).cast("int").alias("hit"),
    )
    per_class = sides.groupBy("class").agg(
        F.sum(F.col("n") * F.col("actual") * F.col("hit")).alias("tp"),
        F.sum(F.col("n") * F.col("actual")).alias("support"),
        F.sum(F.col("n") * F.col("predicted")).alias("predicted"),
    )
    precision = divide_or_zero(F.col("tp"), F.col("predicted"))
    recall = divide_or_zero(F.col("tp"), F.col("support"))
    return per_class.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        divide_or_zero(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "tp",
    )


def report_with_averages(df: DataFrame, label: str, pred: str) -> DataFrame:
    """The class report plus ``macro avg`` and ``weighted avg`` rows."""
    rows = class_report(df, label, pred)
    metrics = ["precision", "recall", "f1"]
    averages = rows.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[divide_or_zero(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in metrics],
        F.sum("support").alias("support"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{kind} avg").alias("class"),
                        *[F.col(f"{kind}_{m}").alias(m) for m in metrics],
                        F.col("support").alias("support"),
                    )
                    for kind in ("macro", "weighted")
                ]
            )
        )
    )
    return rows.select(F.col("class").cast("string").alias("class"), *metrics, "support").unionByName(averages)


def label_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, weighted and macro precision / recall / F1 as one row."""
    w = F.col("support")
    return class_report(df, label, pred).agg(
        divide_or_zero(F.sum("tp"), F.sum("support")).alias("accuracy"),
        divide_or_zero(F.sum(F.col("precision") * w), F.sum(w)).alias("precision"),
        divide_or_zero(F.sum(F.col("recall") * w), F.sum(w)).alias("recall"),
        divide_or_zero(F.sum(F.col("f1") * w), F.sum(w)).alias("f1_score"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_score_macro"),
    )


def _score_counts(df: DataFrame, label: Column, score: Column, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score; the order column runs from the highest score down."""
    return (
        df.select(*by, label.cast("int").alias("_y"), nan_to_null(score.cast("double")).alias("score"))
        .where(F.col("score").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*by, (-F.col("score")).alias("neg_score"))
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))
    )


def _ranked(df: DataFrame, label: Column, score: Column, by: list[str]) -> DataFrame:
    return running_totals(_score_counts(df, label, score, by), "neg_score", ["pos", "neg"], by)


def ranking_metrics(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum); null when only one class is present."""
    by = by or []
    ranked = _ranked(df, F.col(label), F.col(score), by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = pos * (F.col("all_neg") - F.col("run_neg") + 0.5 * neg)
    steps = pos * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    return (
        ranked.groupBy(*by)
        .agg(
            F.sum(wins).alias("wins"),
            F.sum(steps).alias("steps"),
            F.max("all_pos").cast("double").alias("p"),
            F.max("all_neg").cast("double").alias("n"),
        )
        .select(
            *by,
            F.try_divide(F.col("wins"), F.col("p") * F.col("n")).alias("roc_auc"),
            F.try_divide(F.col("steps"), F.col("p")).alias("average_precision"),
        )
    )


def one_vs_rest_auc(df: DataFrame, label: str, scores: str) -> DataFrame:
    """AUC of each class against the rest from an array of class scores; the mean is the macro AUC."""
    exploded = df.select(F.col(label).alias("_label"), F.posexplode(scores).alias("class", "_score"))
    binary = exploded.withColumn("_is", (F.col("_label") == F.col("class")).cast("int"))
    return ranking_metrics(binary, "_is", "_score", by=["class"]).select("class", "roc_auc")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, fpr, tpr)`` at every distinct score, starting at (0, 0)."""
    points = _ranked(df, F.col(label), F.col(score), []).select(
        (-F.col("neg_score")).alias("threshold"),
        F.try_divide(F.col("run_neg").cast("double"), F.col("all_neg").cast("double")).alias("fpr"),
        F.try_divide(F.col("run_pos").cast("double"), F.col("all_pos").cast("double")).alias("tpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, precision, recall, base_rate)`` plus the end point (1, 0)."""
    ranked = _ranked(df, F.col(label), F.col(score), [])
    points = ranked.select(
        (-F.col("neg_score")).alias("threshold"),
        (F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))).alias("precision"),
        F.try_divide(F.col("run_pos").cast("double"), F.col("all_pos").cast("double")).alias("recall"),
        (F.col("all_pos") / (F.col("all_pos") + F.col("all_neg"))).alias("base_rate"),
    )
    usable = F.col(label).isNotNull() & nan_to_null(F.col(score).cast("double")).isNotNull()
    end = df.where(usable).agg(F.avg((F.col(label) == 1).cast("double")).alias("base_rate")).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        "base_rate",
    )
    return points.unionByName(end)


def _melt(row: DataFrame) -> DataFrame:
    return row.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
        )
    )


def model_report(df: DataFrame, label: str, pred: str, score: str) -> DataFrame:
    """All metrics as ``(metric, value, text)`` rows."""
    metrics = label_metrics(df, label, pred)
    ranks = ranking_metrics(df, label, score).withColumnRenamed("average_precision", "pr_auc")
    classes = report_with_averages(df, label, pred).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.concat_ws("_", "class", F.lit(m)).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in ("precision", "recall", "f1", "support")
                ]
            )
        )
    )
    rows = _melt(metrics).unionByName(_melt(ranks)).unionByName(classes)
    return rows.withColumn("text", metric_text("metric", "value"))


def threshold_performance(p: Column, actual: Column, threshold: float = 0.5) -> list[Column]:
    """Aggregates accuracy, precision and recall of a thresholded score (0 when undefined)."""
    known = p.isNotNull() & actual.isNotNull()
    flagged, churned = p >= threshold, actual == 1
    tp = F.count_if(known & flagged & churned)
    return [
        divide_or_zero(F.count_if(known & (flagged == churned)), F.count_if(known)).alias("accuracy"),
        divide_or_zero(tp, F.count_if(known & flagged)).alias("precision"),
        divide_or_zero(tp, F.count_if(known & churned)).alias("recall"),
    ]
