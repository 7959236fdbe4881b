"""Queries over classifier evaluation. Labels and scores come from the orders and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import evaluation
from tidewatch.plans.catalog import ORDER_SCORES, query
from tidewatch.plans.inputs import class_scores, scored_orders
from tidewatch.sources.tables import table

# Binary: was the order fulfilled (status F), scored by its price.
BINARY = f"{ORDER_SCORES}, b AS (SELECT actual AS y, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS h, p AS s FROM order_scores)"
# Multi-class: the label of a vector against the largest of ten sums over its coordinates.
MULTI = """
m0 AS (SELECT vec_id, CAST(label AS BIGINT) AS y, list_transform(range(10), lambda c: round(list_sum(
  list_transform(range(c + 1, len(embedding) + 1, 10), lambda i: CAST(embedding[i] AS DOUBLE))), 6)) AS sc FROM embeddings),
b AS (SELECT *, CAST(list_position(sc, list_max(sc)) - 1 AS BIGINT) AS h FROM m0)"""
CLASSES = """
k AS (SELECT y AS class FROM b UNION SELECT h FROM b),
pc0 AS (SELECT class, (SELECT count(*) FROM b WHERE y = class AND h = class) AS tp,
  (SELECT count(*) FROM b WHERE y = class) AS support, (SELECT count(*) FROM b WHERE h = class) AS predicted FROM k),
pc1 AS (SELECT *, coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0e0) AS pr,
  coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0e0) AS rc FROM pc0),
pc AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0e0) AS f1 FROM pc1)"""
LABEL_METRICS = """
lm AS (SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, sum(pr * support) / sum(support) AS wp,
  sum(rc * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf FROM pc)"""
RANKS = """
g AS (SELECT s, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y <> 1) AS DOUBLE) AS neg FROM b GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS np,
  sum(neg) OVER () AS nn FROM g),
rk AS (SELECT sum(pos * (nn - fp + 0.5e0 * neg)) / (max(np) * max(nn)) AS auc, sum(pos * tp / (tp + fp)) / max(np) AS ap FROM cum)"""


def _binary(spark, folder):
    return scored_orders(spark, folder).select("actual", C.hard_label("p").alias("pred"), "p")


@query(
    "g1_label_metrics",
    f"""WITH {MULTI}, {CLASSES}, {LABEL_METRICS} SELECT round(accuracy, 6) AS accuracy, round(wp, 6) AS "precision",
    round(wr, 6) AS recall, round(wf, 6) AS f1_score, round(mp, 6) AS precision_macro, round(mr, 6) AS recall_macro,
    round(mf, 6) AS f1_score_macro FROM lm""",
)
def _(spark, folder):
    return evaluation.label_metrics(class_scores(spark, folder), "label", "pred")


@query("g2_roc_auc", f"""WITH {BINARY}, {RANKS} SELECT round(auc, 6) AS roc_auc FROM rk""")
def _(spark, folder):
    return evaluation.ranking_metrics(_binary(spark, folder), "actual", "p").select("roc_auc")


@query(
    "g2b_quality_by_length",
    f"""WITH b AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), {RANKS}
    SELECT round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM rk""",
)
def _(spark, folder):
    labelled = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return evaluation.ranking_metrics(labelled, "quality", "n_chars")


@query("g3_average_precision", f"""WITH {BINARY}, {RANKS} SELECT round(ap, 6) AS average_precision FROM rk""")
def _(spark, folder):
    return evaluation.ranking_metrics(_binary(spark, folder), "actual", "p").select("average_precision")


@query(
    "g4_one_vs_rest_auc",
    f"""WITH {MULTI}, e AS (SELECT c AS class, CASE WHEN y = c THEN 1 ELSE 0 END AS y, sc[c + 1] AS s FROM b, range(10) r(c)),
    g AS (SELECT class, s, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg
      FROM e GROUP BY 1, 2),
    cum AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY s) AS below, sum(pos) OVER (PARTITION BY class) AS np,
      sum(neg) OVER (PARTITION BY class) AS nn FROM g)
    SELECT CAST(class AS BIGINT) AS class, round(sum(pos * (below - 0.5e0 * neg)) / (max(np) * max(nn)), 6) AS roc_auc
    FROM cum GROUP BY 1""",
)
def _(spark, folder):
    return evaluation.one_vs_rest_auc(class_scores(spark, folder), "label", "scores")


@query(
    "g5_class_report",
    f"""WITH {MULTI}, {CLASSES}, {LABEL_METRICS} SELECT CAST(class AS VARCHAR) AS class, round(pr, 6) AS "precision",
    round(rc, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pc
    UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), (SELECT count(*) FROM b) FROM lm
    UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), (SELECT count(*) FROM b) FROM lm""",
)
def _(spark, folder):
    return evaluation.report_with_averages(class_scores(spark, folder), "label", "pred")


@query(
    "g6_confusion_matrix",
    f"""WITH {MULTI}, k AS (SELECT y AS c FROM b UNION SELECT h FROM b)
    SELECT a.c AS label, p.c AS prediction, CAST(count(b.vec_id) AS BIGINT) AS n
    FROM k a CROSS JOIN k p LEFT JOIN b ON b.y = a.c AND b.h = p.c GROUP BY 1, 2""",
)
def _(spark, folder):
    return evaluation.confusion(class_scores(spark, folder), "label", "pred")


@query(
    "g7_roc_curve",
    f"""WITH {BINARY}, {RANKS} SELECT round(s, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM cum
    UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0""",
)
def _(spark, folder):
    return evaluation.roc_curve(_binary(spark, folder), "actual", "p")


@query(
    "g8_precision_recall_curve",
    f"""WITH {BINARY}, {RANKS} SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision",
    round(tp / np, 6) AS recall, round(np / (np + nn), 6) AS base_rate FROM cum
    UNION ALL SELECT NULL, 1e0, 0e0, round(avg(y), 6) FROM b""",
)
def _(spark, folder):
    return evaluation.precision_recall_curve(_binary(spark, folder), "actual", "p")


REPORT_ROWS = f"""{BINARY}, {CLASSES}, {LABEL_METRICS}, {RANKS},
rep AS (
  SELECT unnest([{{'metric': 'accuracy', 'value': accuracy}}, {{'metric': 'precision', 'value': wp}},
    {{'metric': 'recall', 'value': wr}}, {{'metric': 'f1_score', 'value': wf}}, {{'metric': 'precision_macro', 'value': mp}},
    {{'metric': 'recall_macro', 'value': mr}}, {{'metric': 'f1_score_macro', 'value': mf}}], recursive := true) FROM lm
  UNION ALL SELECT unnest([{{'metric': 'roc_auc', 'value': auc}}, {{'metric': 'pr_auc', 'value': ap}}], recursive := true) FROM rk
  UNION ALL SELECT unnest([{{'metric': class || '_precision', 'value': pr}}, {{'metric': class || '_recall', 'value': rc}},
    {{'metric': class || '_f1', 'value': f1}}, {{'metric': class || '_support', 'value': CAST(support AS DOUBLE)}}],
    recursive := true) FROM pc
  UNION ALL SELECT unnest([{{'metric': 'macro avg_precision', 'value': mp}}, {{'metric': 'macro avg_recall', 'value': mr}},
    {{'metric': 'macro avg_f1', 'value': mf}}, {{'metric': 'macro avg_support', 'value': CAST((SELECT count(*) FROM b) AS DOUBLE)}},
    {{'metric': 'weighted avg_precision', 'value': wp}}, {{'metric': 'weighted avg_recall', 'value': wr}},
    {{'metric': 'weighted avg_f1', 'value': wf}}, {{'metric': 'weighted avg_support', 'value': CAST((SELECT count(*) FROM b) AS DOUBLE)}}],
    recursive := true) FROM lm
)"""


@query("g10_model_report", f"""WITH {REPORT_ROWS} SELECT metric, round(value, 6) AS value FROM rep""")
def _(spark, folder):
    return evaluation.model_report(_binary(spark, folder), "actual", "pred", "p").select("metric", "value")


@query(
    "g11_metric_text",
    f"""WITH {BINARY}, {RANKS} SELECT printf('Roc Auc: %.4f', auc) AS text FROM rk
    UNION ALL SELECT printf('Average Precision: %.4f', ap) FROM rk""",
)
def _(spark, folder):
    ranks = evaluation.ranking_metrics(_binary(spark, folder), "actual", "p")
    rows = ranks.select(F.explode(F.map_from_arrays(
        F.array(F.lit("roc_auc"), F.lit("average_precision")), F.array("roc_auc", "average_precision")
    )).alias("metric", "value"))
    return rows.select(C.metric_text("metric", "value").alias("text"))
