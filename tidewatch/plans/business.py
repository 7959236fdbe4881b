"""Queries over business reports and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import columns as C
from tidewatch.operators import impact, registry
from tidewatch.operators.evaluation import ranking_metrics, threshold_performance
from tidewatch.operators.scoring import WEIGHTS, add_business_columns, score_with_errors
from tidewatch.plans.catalog import BUSINESS, PARSED, SCORED, SUBS, query
from tidewatch.plans.inputs import business_subscribers, parsed_subscribers, scored_subscribers
from tidewatch.session import scratch_path
from tidewatch.sources.tables import subscribers

SUMMARY = """CAST(count(*) AS BIGINT) AS total_records,
    CAST(count(*) FILTER (risk_level <> 'ERROR') AS BIGINT) AS successful_predictions,
    CAST(count(*) FILTER (risk_level = 'ERROR') AS BIGINT) AS errors,
    CAST(count(*) FILTER (risk_level = 'HIGH') AS BIGINT) AS high_risk_count,
    CAST(count(*) FILTER (risk_level = 'MEDIUM') AS BIGINT) AS medium_risk_count,
    CAST(count(*) FILTER (risk_level = 'LOW') AS BIGINT) AS low_risk_count,
    round(count(*) FILTER (risk_level = 'HIGH') / CAST(count(*) AS DOUBLE) * 100, 6) AS high_risk_pct,
    round(count(*) FILTER (risk_level = 'MEDIUM') / CAST(count(*) AS DOUBLE) * 100, 6) AS medium_risk_pct,
    round(count(*) FILTER (risk_level = 'LOW') / CAST(count(*) AS DOUBLE) * 100, 6) AS low_risk_pct,
    round(avg(churn_probability), 6) AS avg_churn_probability,
    round(coalesce(sum(monthly_revenue_at_risk), 0e0), 6) AS monthly_revenue_at_risk,
    round(coalesce(sum(monthly_revenue_at_risk), 0e0) * 12, 6) AS annual_revenue_at_risk,
    CAST(count(*) FILTER (risk_level IN ('HIGH', 'MEDIUM')) AS BIGINT) AS customers_requiring_intervention"""


@query(
    "h1_batch_summary",
    f"""WITH {PARSED}, v AS (SELECT *, coalesce(tenure BETWEEN 0 AND 100 AND "MonthlyCharges" BETWEEN 0 AND 500
      AND "TotalCharges" BETWEEN 0 AND 10000, false) AS ok FROM parsed),
    s AS (SELECT *, CASE WHEN ok THEN round(1 / (1 + exp(-(1.6e0 + tenure * -0.05e0 + "MonthlyCharges" * 0.008e0
      + "TotalCharges" * -0.0008e0))), 6) ELSE 0e0 END AS churn_probability FROM v),
    l AS (SELECT *, CASE WHEN NOT ok THEN 'ERROR' WHEN churn_probability >= 0.7e0 THEN 'HIGH'
      WHEN churn_probability >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s),
    r AS (SELECT *, CASE WHEN risk_level = 'HIGH' THEN "MonthlyCharges" ELSE 0e0 END AS monthly_revenue_at_risk FROM l)
    SELECT {SUMMARY} FROM r""",
)
def _(spark, folder):
    return impact.batch_summary(add_business_columns(score_with_errors(parsed_subscribers(spark, folder))))


@query(
    "h1b_summary_by_segment",
    f"""WITH {BUSINESS} SELECT "Contract", risk_level, CAST(count(*) AS BIGINT) AS n,
    round(avg(churn_probability), 6) AS avg_churn_probability, round(sum(monthly_revenue_at_risk), 6)
    AS monthly_revenue_at_risk FROM business GROUP BY ROLLUP ("Contract", risk_level)""",
)
def _(spark, folder):
    return business_subscribers(spark, folder).rollup("Contract", "risk_level").agg(
        F.count("*").alias("n"),
        F.avg("churn_probability").alias("avg_churn_probability"),
        F.sum("monthly_revenue_at_risk").alias("monthly_revenue_at_risk"),
    )


REPORT = f"""{SCORED},
t AS (SELECT count(*) AS n, count(*) FILTER (risk_level = 'HIGH') AS h, count(*) FILTER (risk_level = 'MEDIUM') AS m,
  count(*) FILTER (risk_level = 'LOW') AS l, sum("MonthlyCharges") AS rev,
  coalesce(sum("MonthlyCharges") FILTER (risk_level = 'HIGH'), 0e0) AS risk, avg("MonthlyCharges") AS a,
  avg(churn_probability) AS p FROM scored),
r AS (SELECT *, h * 15e0 AS cost, h * 0.35e0 AS kept, h * 0.35e0 * a * 24 AS saved, h * 0.35e0 * a * 24 - h * 15e0 AS net FROM t)"""


@query(
    "h2_business_report",
    f"""WITH {REPORT} SELECT CAST(n AS BIGINT) AS total_customers, CAST(h AS BIGINT) AS high_risk_customers,
    CAST(m AS BIGINT) AS medium_risk_customers, round(rev, 6) AS total_monthly_revenue,
    round(risk, 6) AS monthly_revenue_at_risk, round(a, 6) AS avg_monthly_revenue,
    round(h / CAST(n AS DOUBLE) * 100, 6) AS churn_risk_rate, round(risk * 12, 6) AS annual_revenue_at_risk,
    round(h * a * 24, 6) AS lifetime_value_at_risk, CAST(h + m AS BIGINT) AS recommended_interventions,
    round(cost, 6) AS intervention_cost, round(kept, 6) AS customers_retained, round(saved, 6) AS revenue_saved,
    round(net, 6) AS net_benefit, round(CASE WHEN cost > 0 THEN net / cost * 100 ELSE 0 END, 6) AS roi_percentage FROM r""",
)
def _(spark, folder):
    return impact.business_report(scored_subscribers(spark, folder))


@query(
    "h2b_action_items",
    f"""WITH {REPORT} SELECT CAST(0 AS BIGINT) AS line, printf('Immediately contact %d high-risk customers', h) AS text FROM r
    UNION ALL SELECT 1, printf('Deploy retention campaigns for %d medium-risk customers', m) FROM r
    UNION ALL SELECT 2, 'Allocate $' || format('{{:,}}', CAST(round(cost) AS BIGINT)) || ' for intervention programs' FROM r
    UNION ALL SELECT 3, 'Expected ROI: ' || printf('%.0f', net / cost * 100) || '% ($' || format('{{:,}}', CAST(round(net) AS BIGINT))
      || ' net benefit)' FROM r""",
)
def _(spark, folder):
    return impact.action_items(impact.business_report(scored_subscribers(spark, folder)))


@query(
    "h3_portfolio_report",
    f"""WITH {REPORT} SELECT CAST(n * 1000 AS BIGINT) AS total_customers, CAST(h * 1000 AS BIGINT) AS high_risk,
    CAST(m * 1000 AS BIGINT) AS medium_risk, CAST(l * 1000 AS BIGINT) AS low_risk, round(p, 6) AS predicted_churn_rate,
    h * 65000e0 AS monthly_revenue_at_risk, h * 780000e0 AS annual_revenue_at_risk, h * 1560000e0 AS clv_at_risk,
    h * 15000e0 AS intervention_cost, round(h * 350e0, 6) AS customers_retained, round(h * 546000e0, 6) AS revenue_saved,
    round(h * 531000e0, 6) AS net_benefit, CASE WHEN h > 0 THEN 3540e0 ELSE 0e0 END AS roi_percentage,
    round((0.27e0 - p) / 0.27e0 * 100, 6) AS improvement_pct FROM r""",
)
def _(spark, folder):
    return impact.portfolio_report(scored_subscribers(spark, folder))


MEASURED = f"""{SCORED},
q AS (SELECT count(*) AS base, count(*) FILTER (churn_probability >= 0.5e0 AND "Churn" = 1) / CAST(count(*) FILTER ("Churn" = 1) AS DOUBLE) AS recall,
  coalesce(count(*) FILTER (churn_probability >= 0.5e0 AND "Churn" = 1) / CAST(nullif(count(*) FILTER (churn_probability >= 0.5e0), 0) AS DOUBLE), 0e0)
  AS pr FROM scored)"""


def _sql_campaign(base: str) -> str:
    return f"""c AS (SELECT *, {base} * 0.17e0 AS ch FROM q),
    d AS (SELECT *, ch * recall AS caught, ch * recall * 0.6e0 AS saved, CASE WHEN pr > 0 THEN ch * recall / pr ELSE 0e0 END AS contacted FROM c),
    e AS (SELECT *, contacted * 75e0 AS cost, saved * 1200e0 - contacted * 75e0 AS net FROM d)"""


CAMPAIGN = """round(recall, 6) AS recall, round(pr, 6) AS "precision", round(ch * 1200e0, 6) AS baseline_loss,
    round(saved * 1200e0, 6) AS revenue_saved, round(cost, 6) AS intervention_cost, round(net, 6) AS net_benefit,
    round(CASE WHEN cost > 0 THEN net / cost ELSE 0e0 END, 6) AS roi_ratio, CAST(trunc(saved) AS BIGINT) AS customers_saved,
    CAST(trunc(contacted - caught) AS BIGINT) AS false_positives, CAST(trunc(contacted) AS BIGINT) AS total_interventions,
    round(saved / ch * 100, 6) AS churn_reduction_pct"""


def _measured(spark, folder):
    scored = scored_subscribers(spark, folder)
    return scored.agg(
        F.count("*").alias("base"), *threshold_performance(F.col("churn_probability"), F.col("Churn"))
    ).drop("accuracy")


@query("h4_campaign_impact", f"""WITH {MEASURED}, {_sql_campaign("base")} SELECT CAST(base AS BIGINT) AS base, {CAMPAIGN} FROM e""")
def _(spark, folder):
    return impact.campaign_impact(_measured(spark, folder), F.col("base"))


@query(
    "h5_extrapolated_impact",
    f"""WITH {MEASURED}, {_sql_campaign("base / 0.2e0")} SELECT CAST(base AS BIGINT) AS base, {CAMPAIGN},
    printf('%.1f:1', CASE WHEN cost > 0 THEN net / cost ELSE 0e0 END) AS roi_text FROM e""",
)
def _(spark, folder):
    return impact.extrapolated_impact(_measured(spark, folder), F.col("base"))


@query(
    "h6_response_summary",
    f"""WITH {SCORED} SELECT CAST(count(*) AS BIGINT) AS total_predictions,
    CAST(count(*) FILTER (risk_level = 'HIGH') AS BIGINT) AS high_risk_count,
    CAST(count(*) FILTER (risk_level = 'MEDIUM') AS BIGINT) AS medium_risk_count,
    CAST(count(*) FILTER (risk_level = 'LOW') AS BIGINT) AS low_risk_count,
    round(coalesce(avg(churn_probability), 0), 6) AS avg_churn_probability FROM scored""",
)
def _(spark, folder):
    return impact.response_summary(scored_subscribers(spark, folder))


@query(
    "h7_inference_summary",
    f"""WITH {SCORED} SELECT CAST(count(*) AS BIGINT) AS total_customers,
    CAST(count(*) FILTER (churn_probability >= 0.5e0) AS BIGINT) AS predicted_churners,
    round(count(*) FILTER (churn_probability >= 0.5e0) / CAST(count(*) AS DOUBLE) * 100, 6) AS churn_rate_pct FROM scored""",
)
def _(spark, folder):
    labelled = scored_subscribers(spark, folder).withColumn("Predicted_Churn", C.hard_label("churn_probability"))
    return impact.inference_summary(labelled, "Predicted_Churn")


@query(
    "h8_retention_roi",
    f"""WITH {REPORT} SELECT CAST(h AS BIGINT) AS high_risk, h * 65e0 AS monthly_revenue_at_risk,
    h * 780e0 AS annual_revenue_at_risk, h * 15e0 AS intervention_cost, round(h * 0.35e0, 6) AS customers_retained,
    round(h * 546e0, 6) AS revenue_saved, round(h * 531e0, 6) AS net_benefit,
    CASE WHEN h > 0 THEN 3540e0 ELSE 0e0 END AS roi_percentage FROM r""",
)
def _(spark, folder):
    return impact.retention_roi(scored_subscribers(spark, folder))


# Registry: variants of the fixed-weight model, measured on the subscriber table.

VARIANTS = [("v1.0.0", 1.6), ("v1.1.0", 2.4), ("v1.2.0", 0.8)]
CHAMPION = "v1.1.0"
VERSIONS = f"""{SUBS},
vs(version, b0) AS (VALUES {", ".join(f"('{v}', {b}e0)" for v, b in VARIANTS)}),
sv AS (SELECT version, "Churn" AS y, round(1 / (1 + exp(-(b0 + tenure * -0.05e0 + "MonthlyCharges" * 0.008e0
  + "TotalCharges" * -0.0008e0))), 6) AS p FROM subs, vs),
pv AS (SELECT version, count(*) AS n, avg(CASE WHEN (p >= 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END) AS accuracy,
  coalesce(count(*) FILTER (p >= 0.5e0 AND y = 1) / CAST(nullif(count(*) FILTER (p >= 0.5e0), 0) AS DOUBLE), 0e0) AS pr,
  count(*) FILTER (p >= 0.5e0 AND y = 1) / CAST(count(*) FILTER (y = 1) AS DOUBLE) AS recall FROM sv GROUP BY 1),
gv AS (SELECT version, p, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg
  FROM sv GROUP BY 1, 2),
av AS (SELECT version, sum(pos * (below - 0.5e0 * neg)) / (max(np) * max(nn)) AS auc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY version ORDER BY p) AS below, sum(pos) OVER (PARTITION BY version) AS np,
    sum(neg) OVER (PARTITION BY version) AS nn FROM gv) GROUP BY 1),
mv AS (SELECT * FROM pv JOIN av USING (version))"""


def _version_rows(spark, folder):
    """Measured metrics of every variant, in registry form."""
    rows = subscribers(spark, folder)
    scored = None
    for version, intercept in VARIANTS:
        part = rows.select(
            F.lit(version).alias("version"), "Churn", C.logistic_score(intercept, WEIGHTS).alias("p")
        )
        scored = part if scored is None else scored.unionByName(part)
    measured = (
        scored.groupBy("version")
        .agg(F.count("*").alias("training_rows"), *threshold_performance(F.col("p"), F.col("Churn")))
        .join(ranking_metrics(scored, "Churn", "p", by=["version"]), "version")
    )
    gains = impact.campaign_impact(measured, F.col("training_rows"))
    named = ["accuracy", "precision", "recall", "roc_auc"]
    value = ["revenue_saved", "roi_ratio", "customers_saved", "churn_reduction_pct"]
    return gains.select(
        "version",
        F.lit("2000-08-01 00:00:00").cast("timestamp_ntz").alias("created"),
        F.lit("fixed-weight logistic").alias("model_type"),
        F.array(*[F.lit(c) for c in WEIGHTS]).alias("features"),
        "training_rows",
        F.map_from_arrays(F.array(*[F.lit(f"test_{m}") for m in named]), F.array(*named)).alias("performance"),
        F.map_from_arrays(
            F.array(*[F.lit(v) for v in value]), F.array(*[F.col(v).cast("double") for v in value])
        ).alias("business_impact"),
    )


def _registry(spark, folder):
    store = registry.ModelRegistry(spark, scratch_path(spark, "registry"))
    store.register(_version_rows(spark, folder))
    store.set_champion(VARIANTS[0][0], "2000-08-01 00:00:00")
    store.set_champion(CHAMPION, "2000-08-02 00:00:00")
    return store


@query(
    "r1_registered_versions",
    f"""WITH {VERSIONS} SELECT version, '2000-08-01 00:00:00' AS created, CAST(n AS BIGINT) AS training_rows,
    round(accuracy, 6) AS accuracy, round(pr, 6) AS "precision", round(recall, 6) AS recall, round(auc, 6) AS roc_auc FROM mv""",
)
def _(spark, folder):
    rows = _registry(spark, folder).versions()
    return rows.select(
        "version",
        "created",
        "training_rows",
        *[
            F.element_at("performance", f"test_{m}").alias(m)
            for m in ("accuracy", "precision", "recall", "roc_auc")
        ],
    )


@query("r2_set_champion", f"""WITH {VERSIONS} SELECT version, version = '{CHAMPION}' AS is_champion FROM mv""")
def _(spark, folder):
    return _registry(spark, folder).flagged().select("version", "is_champion")


@query(
    "r3_champion",
    f"""WITH {VERSIONS} SELECT version, CAST(n AS BIGINT) AS training_rows, round(recall, 6) AS recall FROM mv
    WHERE version = '{CHAMPION}'""",
)
def _(spark, folder):
    return _registry(spark, folder).champion().select(
        "version", "training_rows", F.element_at("performance", "test_recall").alias("recall")
    )


@query(
    "c7_champion_lookup",
    f"""WITH {VERSIONS} SELECT version, 'fixed-weight logistic' AS model_type FROM mv WHERE version = '{CHAMPION}'""",
)
def _(spark, folder):
    return _registry(spark, folder).champion().select("version", "model_type")


@query(
    "t1_compare_versions",
    f"""WITH {VERSIONS} SELECT version, 'fixed-weight logistic' AS model_type, '2000-08-01 00:00:00' AS created,
    round(recall, 6) AS test_recall, version = '{CHAMPION}' AS is_champion,
    row_number() OVER (ORDER BY recall DESC, version) AS place FROM mv""",
)
def _(spark, folder):
    place = F.row_number().over(Window.orderBy(F.col("test_recall").desc(), "version"))  # one row a version
    return _registry(spark, folder).compare("test_recall").withColumn("place", place)


@query(
    "r5_model_cards",
    f"""WITH {VERSIONS}, q AS (SELECT *, n AS base FROM mv), {_sql_campaign("base")}
    SELECT version, 'fixed-weight logistic' AS model_type, round(accuracy, 6) AS accuracy, round(pr, 6) AS "precision",
    round(recall, 6) AS recall, round(auc, 6) AS roc_auc, round(saved * 1200e0, 6) AS revenue_saved,
    round(CASE WHEN cost > 0 THEN net / cost ELSE 0e0 END, 6) AS roi_ratio, trunc(saved) AS customers_saved,
    round(saved / ch * 100, 6) AS churn_reduction_pct, CAST(3 AS BIGINT) AS n_features FROM e""",
)
def _(spark, folder):
    return registry.model_card(_registry(spark, folder).versions()).drop("card")
