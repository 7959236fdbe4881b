"""Queries over joins, drift tests, prediction monitoring and ordered statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import columns as C
from tidewatch.functions.schema import SUBSCRIBER_FIELDS
from tidewatch.operators import drift, features, monitoring, scoring
from tidewatch.plans.catalog import BUSINESS, GAPPY, ORDER_SCORES, PARSED, RAW, SCORED, SUBS, query
from tidewatch.plans.inputs import (
    NUMBERS,
    business_subscribers,
    events_halves,
    gappy_lineitem,
    parsed_subscribers,
    scored_orders,
    scored_subscribers,
    shipped_before_after,
)
from tidewatch.session import materialize, scratch_path
from tidewatch.sources import prediction_log
from tidewatch.sources.tables import raw_subscribers, subscribers, table

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHIPPED = f"""{GAPPY},
tagged AS (SELECT *, l_shipdate >= TIMESTAMP '1998-07-01' AS cur FROM gappy)"""
EVENTS = """
ev AS (
  SELECT ts >= TIMESTAMP '2024-01-16' AS cur, event_type || ' ' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS event_type,
    value FROM events
)"""
CATEGORY_COUNTS = f"""{EVENTS},
cc AS (SELECT event_type AS value, count(*) FILTER (NOT cur) AS ref, count(*) FILTER (cur) AS now FROM ev GROUP BY 1),
ct AS (SELECT sum(ref) AS all_ref, sum(now) AS all_now FROM cc)"""

# Joins


@query(
    "c1_target_encoding",
    f"""WITH {SUBS}, t AS (SELECT * FROM subs WHERE c_nationkey < 20),
    m AS (SELECT "Contract", c_nationkey, avg("Churn") AS mean FROM t GROUP BY 1, 2),
    k AS (SELECT c_nationkey, avg("Churn") AS mean FROM t GROUP BY 1)
    SELECT customer_id, round(coalesce(k.mean, (SELECT avg("Churn") FROM t)), 6) AS nation_risk
    FROM subs LEFT JOIN k USING (c_nationkey)""",
)
def _(spark, folder):
    rows = subscribers(spark, folder)
    train = rows.where(F.col("c_nationkey") < 20)
    return features.target_encode(train, rows, "c_nationkey", "Churn", "nation_risk").select(
        "customer_id", "nation_risk"
    )


@query(
    "c2_category_alignment",
    f"""WITH {CATEGORY_COUNTS} SELECT 'event_type' AS "column", value, CAST(ref AS BIGINT) AS ref,
    CAST(now AS BIGINT) AS cur FROM cc""",
)
def _(spark, folder):
    return drift.category_counts(*events_halves(spark, folder), ["event_type"])


@query(
    "c3_unlisted_values",
    f"""WITH {RAW} SELECT DISTINCT "PaymentMethod" AS value FROM raw WHERE "PaymentMethod" NOT IN
    ('Electronic check', 'Mailed check', 'Bank transfer (automatic)', 'Credit card (automatic)')""",
)
def _(spark, folder):
    allowed = next(f.allowed for f in SUBSCRIBER_FIELDS if f.name == "PaymentMethod")
    listed = spark.createDataFrame([(v,) for v in allowed], "value string")
    seen = raw_subscribers(spark, folder).select(F.col("PaymentMethod").alias("value")).distinct()
    return seen.where(F.col("value").isNotNull()).join(F.broadcast(listed), "value", "left_anti")  # the declared list


@query(
    "c4_new_categories",
    f"""WITH {CATEGORY_COUNTS} SELECT 'event_type' AS "column", value, CAST(now AS BIGINT) AS n FROM cc
    WHERE ref = 0 AND now > 0""",
)
def _(spark, folder):
    return drift.new_categories(*events_halves(spark, folder), ["event_type"])


@query(
    "c5_flagged_semi_join",
    f"""WITH {SCORED} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
    (SELECT customer_id FROM scored WHERE risk_level IN ('HIGH', 'MEDIUM'))""",
)
def _(spark, folder):
    flagged = scored_subscribers(spark, folder).where(F.col("risk_level").isin("HIGH", "MEDIUM"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(flagged.select(F.col("customer_id").alias("o_custkey")), "o_custkey", "left_semi")


@query(
    "c6_outcome_join",
    f"""WITH {ORDER_SCORES}, outcome AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
      FROM lineitem GROUP BY 1)
    SELECT model_version, CAST(count(*) AS BIGINT) AS n, CAST(sum(returned) AS BIGINT) AS n_returned,
      round(avg(CASE WHEN (p >= 0.5e0) = (returned = 1) THEN 1e0 ELSE 0e0 END), 6) AS accuracy
    FROM order_scores JOIN outcome ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, folder):
    outcomes = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    )
    joined = scored_orders(spark, folder).join(outcomes, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("model_version").agg(
        F.count("*").alias("n"),
        F.sum("returned").alias("n_returned"),
        F.avg((C.hard_label("p") == F.col("returned")).cast("double")).alias("accuracy"),
    )


# Prediction log

LOG = f"""{ORDER_SCORES},
log AS (
  SELECT model_version, CAST(o_orderdate AS TIMESTAMP) AS ts, count(*) AS batch_size,
         avg(CASE WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS positive_rate, avg(p) AS mean_probability
  FROM order_scores GROUP BY 1, 2
),
kept AS (SELECT * FROM log ORDER BY ts DESC, model_version DESC LIMIT 1000)"""
LAST = "TIMESTAMP '2001-08-01'"


def _log(spark, folder):
    rows = scored_orders(spark, folder).withColumn("timestamp", F.col("o_orderdate"))
    stats = monitoring.batch_stats(rows, ["model_version", "timestamp"], "p", ["o_totalprice"])
    return prediction_log.append(stats, scratch_path(spark, "prediction-log"))


@query(
    "a5_log_retention",
    f"""WITH {LOG} SELECT model_version, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
    CAST(batch_size AS BIGINT) AS batch_size FROM kept""",
)
def _(spark, folder):
    log = prediction_log.read(spark, _log(spark, folder))
    return monitoring.newest(log, "timestamp", monitoring.LOG_ENTRIES, "model_version").select(
        "model_version", "timestamp", "batch_size"
    )


@query(
    "a6_nested_log_scan",
    f"""WITH {LOG} SELECT model_version, CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(batch_size) AS BIGINT) AS n,
    round(avg(positive_rate), 6) AS positive_rate, round(avg(mean_probability), 6) AS mean_probability
    FROM log GROUP BY 1""",
)
def _(spark, folder):
    log = prediction_log.read(spark, _log(spark, folder))
    return log.groupBy("model_version").agg(
        F.count("*").alias("n_batches"),
        F.sum("batch_size").alias("n"),
        F.avg("prediction_stats.positive_rate").alias("positive_rate"),
        F.avg("probability_stats.mean_probability").alias("mean_probability"),
    )


# Drift


@query(
    "e1_reference_stats",
    f"""WITH {SHIPPED}, r AS (SELECT * FROM tagged WHERE NOT cur) """
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'numeric' AS "type", stat, round(value, 6) AS value FROM (SELECT unnest([
        {{'stat': 'mean', 'value': avg({c})}}, {{'stat': 'std', 'value': stddev_samp({c})}},
        {{'stat': 'q25', 'value': quantile_cont({c}, 0.25)}}, {{'stat': 'q50', 'value': quantile_cont({c}, 0.5)}},
        {{'stat': 'q75', 'value': quantile_cont({c}, 0.75)}}], recursive := true) FROM r)"""
        for c in MEASURES
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT '{c}', 'categorical', 'share:' || {c}, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6)
        FROM r WHERE {c} IS NOT NULL GROUP BY {c}
        UNION ALL SELECT '{c}', 'categorical', 'unique_count', CAST(count(DISTINCT {c}) AS DOUBLE) FROM r"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def _(spark, folder):
    reference, _ = shipped_before_after(spark, folder)
    return drift.reference_stats(reference, MEASURES, ["l_returnflag", "l_linestatus"])


@query(
    "e2_baseline_stats",
    f"WITH {SUBS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS std,
        round(min("{c}"), 6) AS "min", round(max("{c}"), 6) AS "max",
        {", ".join(f'round(quantile_cont("{c}", {q}), 6) AS {n}' for n, q in drift.BASELINE_PROBS.items())} FROM subs"""
        for c in NUMBERS
    ),
)
def _(spark, folder):
    return drift.baseline_stats(subscribers(spark, folder), NUMBERS)


def _sql_ks(c: str) -> str:
    return f"""SELECT '{c}' AS "column", d, n1, n2, m1, m2, s1, gap FROM (
      SELECT max(abs(f1 / n1 - f2 / n2)) AS d FROM (
        SELECT {c}, sum(count(*) FILTER (NOT cur)) OVER (ORDER BY {c}) AS f1,
               sum(count(*) FILTER (cur)) OVER (ORDER BY {c}) AS f2,
               CAST(sum(count(*) FILTER (NOT cur)) OVER () AS DOUBLE) AS n1,
               CAST(sum(count(*) FILTER (cur)) OVER () AS DOUBLE) AS n2
        FROM tagged WHERE {c} IS NOT NULL GROUP BY {c}) x) y,
      (SELECT count({c}) FILTER (NOT cur) AS n1, count({c}) FILTER (cur) AS n2, avg({c}) FILTER (NOT cur) AS m1,
              avg({c}) FILTER (cur) AS m2, stddev_samp({c}) FILTER (NOT cur) AS s1,
              (1 - count({c}) FILTER (cur) / CAST(count(*) FILTER (cur) AS DOUBLE))
              - (1 - count({c}) FILTER (NOT cur) / CAST(count(*) FILTER (NOT cur) AS DOUBLE)) AS gap FROM tagged) z"""


KS = f"""ks AS ({" UNION ALL ".join(_sql_ks(c) for c in MEASURES)}),
ksp AS (SELECT *, CASE WHEN sqrt(n1 * CAST(n2 AS DOUBLE) / (n1 + n2)) * d < 0.2e0 THEN 1e0 ELSE
  least(1e0, greatest(0e0, 2 * list_sum(list_transform(range(1, 101), lambda k:
    (CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * k * k * n1 * CAST(n2 AS DOUBLE) / (n1 + n2) * d * d))))) END
  AS p FROM ks)"""


@query(
    "e3_ks_drift",
    f"""WITH {SHIPPED}, {KS} SELECT "column", round(d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05e0 AS drift_detected,
    round(abs(m2 - m1) / s1, 6) AS mean_shift, round(m1, 6) AS reference_mean, round(m2, 6) AS current_mean,
    round(gap, 6) AS missing_rate_change FROM ksp""",
)
def _(spark, folder):
    return drift.ks_test(*shipped_before_after(spark, folder), MEASURES)


# Upper chi-square tail by the regularized lower gamma series, with DuckDB's own lgamma.
CHI_P = """CASE WHEN df <= 0 OR x <= 0 THEN 1e0 WHEN x > 400 THEN 0e0 ELSE 1 - list_sum(list_transform(range(0, 400),
  lambda i: exp(-x / 2 + (df / 2e0 + i) * ln(x / 2) - lgamma(df / 2e0 + i + 1)))) END"""
CHI = f"""chi AS (
  SELECT sum(pow(now - e, 2) / e) AS x, count(*) - 1 AS df, 0.5e0 * sum(abs(ref / all_ref - now / all_now)) AS tv,
         count(*) FILTER (ref = 0 AND now > 0) AS n_new,
         coalesce(max(CASE WHEN value IS NULL THEN now / all_now - ref / all_ref END), 0e0) AS gap
  FROM (SELECT value, CAST(ref AS DOUBLE) AS ref, CAST(now AS DOUBLE) AS now, CAST(all_ref AS DOUBLE) AS all_ref,
               CAST(all_now AS DOUBLE) AS all_now,
               CASE WHEN ref = 0 THEN 1e-10 ELSE ref * CAST(all_now AS DOUBLE) / CAST(all_ref AS DOUBLE) END AS e
        FROM cc, ct) t),
chip AS (SELECT *, {CHI_P} AS p FROM chi)"""


@query(
    "e4_chi_square_drift",
    f"""WITH {SHIPPED}, cc AS (SELECT l_returnflag AS value, count(*) FILTER (NOT cur) AS ref,
      count(*) FILTER (cur) AS now FROM tagged GROUP BY 1),
    ct AS (SELECT sum(ref) AS all_ref, sum(now) AS all_now FROM cc), {CHI}
    SELECT 'l_returnflag' AS "column", round(x, 6) AS statistic, CAST(df AS BIGINT) AS degrees,
      round(tv, 6) AS tv_distance, CAST(n_new AS BIGINT) AS n_new_categories, round(gap, 6) AS missing_rate_change,
      round(p, 6) AS p_value, p < 0.05e0 AS drift_detected FROM chip""",
)
def _(spark, folder):
    return drift.chi_square_test(*shipped_before_after(spark, folder), ["l_returnflag"])


@query(
    "e4b_chi_square_shifted",
    f"""WITH {CATEGORY_COUNTS}, {CHI}
    SELECT 'event_type' AS "column", CAST(df AS BIGINT) AS degrees, round(tv, 6) AS tv_distance,
      CAST(n_new AS BIGINT) AS n_new_categories, round(gap, 6) AS missing_rate_change,
      round(p, 6) AS p_value, p < 0.05e0 AS drift_detected, round(ln(x), 6) AS log_statistic FROM chip""",
)
def _(spark, folder):
    # The statistic is about 1e16 here (categories the reference lacks), so its logarithm is compared.
    result = drift.chi_square_test(*events_halves(spark, folder), ["event_type"])
    return result.withColumn("log_statistic", F.ln("statistic")).drop("statistic")


@query(
    "e5_drift_report",
    f"""WITH {SHIPPED}, {KS},
    cc AS (SELECT l_returnflag AS value, count(*) FILTER (NOT cur) AS ref, count(*) FILTER (cur) AS now
      FROM tagged GROUP BY 1),
    ct AS (SELECT sum(ref) AS all_ref, sum(now) AS all_now FROM cc), {CHI},
    tests AS (SELECT "column" AS c, p < 0.05e0 AS hit FROM ksp UNION ALL SELECT 'l_returnflag', p < 0.05e0 FROM chip)
    SELECT CAST(count(*) AS BIGINT) AS columns_analyzed, CAST(count(*) FILTER (hit) AS BIGINT) AS n_drifted,
      coalesce(string_agg(CASE WHEN hit THEN c END, ', ' ORDER BY c), '') AS drifted_columns,
      bool_or(hit) AS drift_detected, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS drift_score
    FROM tests""",
)
def _(spark, folder):
    tests = drift.drift_tests(*shipped_before_after(spark, folder), MEASURES, ["l_returnflag"])
    return drift.drift_report(tests)


BASE_VALUES = ", ".join(f"('{r[0]}', {', '.join(repr(v) + 'e0' for v in r[3:])})" for r in drift.DEFAULT_BASELINES)


def _sql_psi(source: str, expected: str, by: str = "") -> str:
    """PSI of the three subscriber columns against the default baselines."""
    key = f"{by}, " if by else ""
    parts = " UNION ALL ".join(f"""SELECT {key}'{c}' AS c, "{c}" AS v FROM {source}""" for c in NUMBERS)
    share = "1e0 / (n_bins + 1)" if expected == "uniform" else "(CASE WHEN bins.b = n_bins THEN 1e0 ELSE hi_p END) - lo_p"
    return f"""
base(c, mn, mx, p10, p25, p50, p75, p90) AS (VALUES {BASE_VALUES}),
pts AS (SELECT c, unnest([mn, p10, p25, p50, p75, p90, mx]) AS e, unnest([0e0, 0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 1e0]) AS q
        FROM base),
edges AS (SELECT c, e, min(q) AS q FROM pts GROUP BY 1, 2),
bins AS (SELECT * FROM (SELECT c, e AS lo, lead(e) OVER w AS hi, q AS lo_p, lead(q) OVER w AS hi_p,
           row_number() OVER w AS b, count(*) OVER (PARTITION BY c) - 1 AS n_bins FROM edges WINDOW w AS (PARTITION BY c ORDER BY e))
         WHERE hi IS NOT NULL),
vals AS ({parts}),
hits AS (SELECT {key.replace(by, 'v.' + by) if by else ''}v.c, b, count(*) AS n FROM vals v JOIN bins ON v.c = bins.c AND v >= lo
           AND (v < hi OR (b = n_bins AND v = hi)) GROUP BY ALL),
tot AS (SELECT {key}c, CAST(sum(n) AS DOUBLE) AS total FROM hits GROUP BY ALL),
psi AS (SELECT {('tot.' + by + ', ') if by else ''}tot.c AS "column", abs(sum((a - x) * ln(a / x))) AS psi FROM (
    SELECT {('tot.' + by + ', ') if by else ''}tot.c, CASE WHEN coalesce(n, 0) = 0 THEN 0.001e0 ELSE n / total END AS a, {share} AS x
    FROM tot JOIN bins ON tot.c = bins.c LEFT JOIN hits ON hits.c = bins.c AND hits.b = bins.b {f'AND hits.{by} = tot.{by}' if by else ''}) tot
  GROUP BY ALL)"""


@query(
    "e6_psi_uniform",
    f"""WITH {SUBS}, {_sql_psi("subs", "uniform")} SELECT "column", round(psi, 6) AS psi FROM psi""",
)
def _(spark, folder):
    return drift.psi(subscribers(spark, folder), drift.default_baselines(spark), NUMBERS)


@query(
    "e6b_psi_baseline",
    f"""WITH {SUBS}, {_sql_psi("subs", "baseline")} SELECT "column", round(psi, 6) AS psi FROM psi""",
)
def _(spark, folder):
    return drift.psi(subscribers(spark, folder), drift.default_baselines(spark), NUMBERS, expected="baseline")


@query(
    "e7_psi_report",
    f"""WITH {SUBS}, {_sql_psi("subs", "uniform")}
    SELECT coalesce(string_agg(CASE WHEN psi > 0.1e0 THEN "column" END, ', ' ORDER BY "column"), '') AS drifted_features,
    round(max(psi), 6) AS max_psi, max(psi) > 0.1e0 AS drift_detected FROM psi""",
)
def _(spark, folder):
    scores = drift.psi(subscribers(spark, folder), drift.default_baselines(spark), NUMBERS)
    return drift.psi_report(scores).withColumn("drifted_features", F.array_join("drifted_features", ", "))


# Prediction monitoring


@query(
    "e8_batch_stats",
    f"""WITH {ORDER_SCORES}, l AS (SELECT *, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS y FROM order_scores)
    SELECT model_version, strftime(batch_month, '%Y-%m-%d') AS batch_month, CAST(count(*) AS BIGINT) AS batch_size,
      round(avg(y), 6) AS positive_rate, round(1 - avg(y), 6) AS negative_rate,
      CAST(count(DISTINCT y) AS BIGINT) AS unique_predictions, round(avg(p), 6) AS mean_probability,
      round(stddev_pop(p), 6) AS std_probability, round(min(p), 6) AS min_probability, round(max(p), 6) AS max_probability,
      round(avg(CASE WHEN p > 0.8e0 THEN 1e0 ELSE 0e0 END), 6) AS high_confidence_rate,
      round(avg(CASE WHEN p < 0.2e0 THEN 1e0 ELSE 0e0 END), 6) AS low_confidence_rate,
      CAST(2 AS BIGINT) AS feature_count, round((count(*) - count(known_status)) / (count(*) * 2e0), 6) AS missing_rate,
      round(ln(avg(o_totalprice)), 6) AS log_mean_price
    FROM l GROUP BY 1, 2""",
)
def _(spark, folder):
    rows = scored_orders(spark, folder).withColumn("known_status", (F.col("known_status") == "F").cast("double"))
    stats = monitoring.batch_stats(rows, ["model_version", "batch_month"], "p", ["o_totalprice", "known_status"])
    return stats.select(
        "model_version",
        "batch_month",
        "batch_size",
        "prediction_stats.*",
        "probability_stats.*",
        "input_stats.feature_count",
        "input_stats.missing_rate",
        F.ln(F.element_at("input_stats.numeric_feature_means", "o_totalprice")).alias("log_mean_price"),
    )


@query(
    "e9_prediction_distribution",
    f"""WITH {ORDER_SCORES} SELECT CAST(count(*) AS BIGINT) AS total_predictions,
      round(avg(CASE WHEN p >= 0.7e0 THEN 1e0 ELSE 0e0 END), 6) AS high_risk_rate,
      round(avg(CASE WHEN p >= 0.3e0 AND p < 0.7e0 THEN 1e0 ELSE 0e0 END), 6) AS medium_risk_rate,
      round(avg(CASE WHEN p < 0.3e0 THEN 1e0 ELSE 0e0 END), 6) AS low_risk_rate, round(avg(p), 6) AS avg_prediction,
      round(stddev_pop(p), 6) AS prediction_std, round(quantile_cont(p, 0.1), 6) AS p10,
      round(quantile_cont(p, 0.25), 6) AS p25, round(quantile_cont(p, 0.5), 6) AS p50,
      round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.9), 6) AS p90 FROM order_scores""",
)
def _(spark, folder):
    return monitoring.prediction_distribution(scored_orders(spark, folder), "p")


PERFORMANCE = """
perf AS (
  SELECT model_version, batch_month, count(*) AS n, avg(CASE WHEN (p >= 0.5e0) = (actual = 1) THEN 1e0 ELSE 0e0 END) AS accuracy,
         coalesce(count(*) FILTER (p >= 0.5e0 AND actual = 1) / CAST(nullif(count(*) FILTER (p >= 0.5e0), 0) AS DOUBLE), 0e0) AS "precision",
         coalesce(count(*) FILTER (p >= 0.5e0 AND actual = 1) / CAST(nullif(count(*) FILTER (actual = 1), 0) AS DOUBLE), 0e0) AS recall
  FROM order_scores GROUP BY 1, 2
),
hist AS (
  SELECT *, avg(accuracy) OVER (PARTITION BY model_version ORDER BY batch_month ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent
  FROM perf
),
degr AS (SELECT *, coalesce(accuracy < recent - 0.05e0, false) AS degraded FROM hist)"""


def _performance(spark, folder):
    return monitoring.batch_performance(scored_orders(spark, folder), ["model_version", "batch_month"], "p", "actual")


@query(
    "e10_batch_performance",
    f"""WITH {ORDER_SCORES}, {PERFORMANCE} SELECT model_version, strftime(batch_month, '%Y-%m-%d') AS batch_month,
    CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
    round(recall, 6) AS recall FROM perf""",
)
def _(spark, folder):
    return _performance(spark, folder)


# Percentages in messages are rounded half up, as Spark's format_string does.
CHECKS = f"""
quality AS (
  SELECT (SELECT avg(r) FROM (SELECT (count(*) - count(l_discount)) / CAST(count(*) AS DOUBLE) AS r FROM gappy
      UNION ALL SELECT (count(*) - count(l_tax)) / CAST(count(*) AS DOUBLE) FROM gappy
      UNION ALL SELECT (count(*) - count(l_returnflag)) / CAST(count(*) AS DOUBLE) FROM gappy)) AS missing,
    (SELECT sum(c - 1) / CAST(sum(c) AS DOUBLE) FROM (SELECT count(*) AS c FROM gappy
      GROUP BY l_discount, l_tax, l_returnflag)) AS dup
),
q AS (SELECT 'data_quality' AS "check", CASE WHEN missing > 0.5e0 THEN printf('High missing data rate: %.1f%%', round(missing * 100, 1))
  WHEN dup > 0.1e0 THEN printf('High duplicate rate: %.1f%%', round(dup * 100, 1)) END AS problem,
  'Data quality within acceptable bounds' AS fine FROM quality),
r AS (SELECT 'prediction_distribution' AS "check", CASE WHEN rate < 0.05e0 OR rate > 0.5e0 THEN
  printf('Unusual prediction distribution: %.1f%% positive rate', round(rate * 100, 1)) END AS problem,
  'Prediction distribution normal' AS fine FROM (SELECT avg(CASE WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END) AS rate FROM order_scores)),
g AS (SELECT 'performance_degradation' AS "check", CASE WHEN max(CASE WHEN degraded THEN recent - accuracy END) IS NOT NULL
  THEN printf('Accuracy dropped by %.3f', max(CASE WHEN degraded THEN recent - accuracy END)) END AS problem,
  'No degradation' AS fine FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY batch_month DESC) AS rn
    FROM degr) WHERE rn = 1),
checks AS (SELECT "check", problem IS NULL AS passed, coalesce(problem, fine) AS message,
  CASE WHEN problem IS NOT NULL THEN 'warning' END AS severity FROM (SELECT * FROM q UNION ALL SELECT * FROM r
  UNION ALL SELECT * FROM g))"""


def _quality_check(spark, folder):
    return monitoring.data_quality_check(gappy_lineitem(spark, folder).select("l_discount", "l_tax", "l_returnflag"))


@query(
    "e11_data_quality_check",
    f"""WITH {GAPPY}, {ORDER_SCORES}, {PERFORMANCE}, {CHECKS} SELECT * FROM checks WHERE "check" = 'data_quality'""",
)
def _(spark, folder):
    return _quality_check(spark, folder)


@query(
    "e12_prediction_rate_check",
    f"""WITH {GAPPY}, {ORDER_SCORES}, {PERFORMANCE}, {CHECKS} SELECT * FROM checks
    WHERE "check" = 'prediction_distribution'""",
)
def _(spark, folder):
    return monitoring.prediction_rate_check(scored_orders(spark, folder), "p")


@query(
    "e13_overall_status",
    f"""WITH {GAPPY}, {ORDER_SCORES}, {PERFORMANCE}, {CHECKS} SELECT CAST(count(*) AS BIGINT) AS n_checks,
    CAST(count(*) FILTER (NOT passed) AS BIGINT) AS n_alerts,
    CASE WHEN bool_or(NOT passed AND severity = 'error') THEN 'unhealthy' WHEN bool_or(NOT passed) THEN 'degraded'
    ELSE 'healthy' END AS overall_status FROM checks""",
)
def _(spark, folder):
    return monitoring.overall_status(monitoring.health_check(spark, _checks(spark, folder)))


def _checks(spark, folder):
    return {
        "data_quality": lambda: _quality_check(spark, folder),
        "prediction_distribution": lambda: monitoring.prediction_rate_check(scored_orders(spark, folder), "p"),
        "performance_degradation": lambda: monitoring.degradation_check(
            _performance(spark, folder), ["model_version"], "batch_month"
        ),
    }


@query(
    "e13b_status_with_failing_check",
    f"""WITH {GAPPY}, {ORDER_SCORES}, {PERFORMANCE}, {CHECKS} SELECT CAST(count(*) + 1 AS BIGINT) AS n_checks,
    CAST(count(*) FILTER (NOT passed) + 1 AS BIGINT) AS n_alerts, 'unhealthy' AS overall_status FROM checks""",
)
def _(spark, folder):
    """A check over a table that isn't there is reported, and the others still run."""
    checks = _checks(spark, folder) | {"archive": lambda: monitoring.data_quality_check(table(spark, folder, "no_such_table"))}
    return monitoring.overall_status(monitoring.health_check(spark, checks))


# Batch monitor over numbered chunks of the subscriber table.

BATCH = 100
NUMBERED = f"""{SCORED},
numbered AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY customer_id) - 1) / {BATCH}) + 1 AS BIGINT) AS batch_number
  FROM scored)"""
MONITOR = f"""{NUMBERED}, {_sql_psi("numbered", "uniform", "batch_number")},
pr AS (SELECT batch_number, list_sort(list("column") FILTER (psi > 0.1e0)) AS drifted, max(psi) AS max_psi FROM psi GROUP BY 1),
rt AS (SELECT batch_number, count(*) AS n, avg(CASE WHEN risk_level = 'HIGH' THEN 1e0 ELSE 0e0 END) AS high_risk_rate,
    avg(churn_probability) AS avg_prediction, stddev_pop(churn_probability) AS prediction_std,
    avg(CASE WHEN (churn_probability >= 0.5e0) = ("Churn" = 1) THEN 1e0 ELSE 0e0 END) AS accuracy
  FROM numbered GROUP BY 1),
rh AS (SELECT *, avg(accuracy) OVER (ORDER BY batch_number ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent FROM rt),
mon AS (SELECT rh.*, coalesce(accuracy < recent - 0.05e0, false) AS degraded,
    CASE WHEN accuracy < recent - 0.05e0 THEN recent - accuracy ELSE 0e0 END AS amount,
    coalesce(drifted, []) AS drifted, coalesce(max_psi, 0) AS max_psi,
    TIMESTAMP '2000-08-01' + to_hours(batch_number) AS ts
  FROM rh LEFT JOIN pr USING (batch_number)),
alerts AS (
  SELECT batch_number, ts, 'DATA_DRIFT' AS "type", CASE WHEN len(drifted) > 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    'Data drift detected in features: ' || array_to_string(drifted, ', ') AS message, 'Consider model retraining' AS action_required
  FROM mon WHERE len(drifted) > 0
  UNION ALL SELECT batch_number, ts, 'PERFORMANCE_DEGRADATION', CASE WHEN amount > 0.1e0 THEN 'HIGH' ELSE 'MEDIUM' END,
    printf('Model performance degraded by %.3f', round(amount, 3)), 'Investigate and potentially retrain model' FROM mon WHERE degraded
  UNION ALL SELECT batch_number, ts, 'HIGH_RISK_SPIKE', 'HIGH',
    printf('Unusually high churn risk detected: %.1f%% high risk customers', round(high_risk_rate * 100, 1)),
    'Investigate business conditions and customer behavior' FROM mon WHERE high_risk_rate > 0.2e0
),
lastb AS (SELECT max(ts) AS last_ts FROM mon)"""


def _monitored(spark, folder):
    scored = scored_subscribers(spark, folder).select("customer_id", *NUMBERS, "churn_probability", "Churn")
    # Read by the drift, distribution and performance branches, so computed once.
    rows = materialize(scoring.batch_numbers(scored, "customer_id", BATCH))
    result = monitoring.monitor_batches(
        rows, "batch_number", drift.default_baselines(spark), NUMBERS, "churn_probability", "Churn"
    )
    # One batch per hour from the cut-off date on.
    start = F.lit("2000-08-01 00:00:00").cast("timestamp_ntz")
    return result.withColumn("ts", start + F.make_dt_interval(hours=F.col("batch_number").cast("int")))


def _alerts(spark, folder):
    return monitoring.alerts(_monitored(spark, folder), ["batch_number"], "ts")


@query(
    "e14_alerts",
    f"""WITH {MONITOR} SELECT batch_number, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", "type", severity, message,
    action_required FROM alerts""",
)
def _(spark, folder):
    return _alerts(spark, folder)


@query(
    "e15_alert_routing",
    f"""WITH {MONITOR} SELECT batch_number, "type", CASE WHEN "type" = 'DATA_DRIFT' THEN 'schedule_retraining'
    WHEN "type" = 'PERFORMANCE_DEGRADATION' THEN 'flag_for_review' END AS response FROM alerts WHERE severity = 'HIGH'""",
)
def _(spark, folder):
    return monitoring.route_alerts(_alerts(spark, folder)).select("batch_number", "type", "response")


def _asof(metrics):
    return metrics.agg(F.max("ts").alias("asof"))


@query(
    "e16_dashboard",
    f"""WITH {MONITOR}, recent AS (SELECT * FROM mon ORDER BY ts DESC LIMIT 100)
    SELECT (SELECT count(*) FROM mon) AS total_monitored_batches,
      (SELECT count(*) FROM alerts, lastb WHERE severity = 'HIGH' AND ts > last_ts - INTERVAL 24 HOUR AND ts <= last_ts) AS active_alerts,
      (SELECT count(*) FROM recent WHERE len(drifted) > 0) AS drift_detected_batches,
      (SELECT count(*) FROM recent WHERE degraded) AS performance_issues""",
)
def _(spark, folder):
    metrics = _monitored(spark, folder)
    stored = monitoring.route_alerts(monitoring.alerts(metrics, ["batch_number"], "ts"))
    return monitoring.dashboard(metrics, stored, "ts", _asof(metrics).scalar())


@query(
    "e17_system_health",
    f"""WITH {MONITOR}, act AS (SELECT * FROM alerts, lastb WHERE severity = 'HIGH' AND ts > last_ts - INTERVAL 24 HOUR AND ts <= last_ts),
    s AS (SELECT count(*) AS n_active, CASE WHEN bool_or(severity = 'HIGH') THEN 'CRITICAL' WHEN count(*) > 0 THEN 'WARNING'
      ELSE 'HEALTHY' END AS status FROM act)
    SELECT n_active, status, CASE status WHEN 'CRITICAL' THEN
      'Immediate action required - investigate alerts and consider model rollback'
      WHEN 'WARNING' THEN 'Monitor closely and prepare for potential intervention' ELSE 'System operating normally' END
      AS recommendation FROM s""",
)
def _(spark, folder):
    metrics = _monitored(spark, folder)
    stored = monitoring.route_alerts(monitoring.alerts(metrics, ["batch_number"], "ts"))
    return monitoring.system_health(monitoring.active_alerts(stored, _asof(metrics).scalar()))


@query(
    "e18_batch_monitor",
    f"""WITH {MONITOR} SELECT batch_number, CAST(n AS BIGINT) AS total_predictions, round(high_risk_rate, 6) AS high_risk_rate,
    round(avg_prediction, 6) AS avg_prediction, round(prediction_std, 6) AS prediction_std, round(accuracy, 6) AS accuracy,
    degraded, round(amount, 6) AS degradation_amount, array_to_string(drifted, ', ') AS drifted_features,
    len(drifted) > 0 AS drift_detected, round(max_psi, 6) AS max_psi FROM mon""",
)
def _(spark, folder):
    return _monitored(spark, folder).select(
        "batch_number",
        "total_predictions",
        "high_risk_rate",
        "avg_prediction",
        "prediction_std",
        "accuracy",
        "degraded",
        "degradation_amount",
        F.array_join("drifted_features", ", ").alias("drifted_features"),
        "drift_detected",
        F.coalesce("max_psi", F.lit(0.0)).alias("max_psi"),
    )


@query(
    "e19_throughput",
    """WITH l AS (SELECT event_type, count(*) AS batch_size, sum(value) / 1000 AS seconds FROM events GROUP BY 1)
    SELECT CAST(sum(batch_size) AS BIGINT) AS total_predictions, round(sum(seconds), 4) AS total_inference_time,
    round(sum(seconds) / sum(batch_size) * 1000, 4) AS average_time_per_prediction_ms FROM l""",
)
def _(spark, folder):
    # The event value stands for the milliseconds a request took.
    log = (
        table(spark, folder, "events")
        .groupBy("event_type")
        .agg(F.count("*").alias("batch_size"), (F.sum("value") / 1000).alias("seconds"))
    )
    result = monitoring.throughput(log)
    return result.select(
        "total_predictions",
        *[F.round(c, 4).alias(c) for c in ("total_inference_time", "average_time_per_prediction_ms")],
    )


# Windows


@query(
    "w1_degradation",
    f"""WITH {ORDER_SCORES}, {PERFORMANCE} SELECT model_version, strftime(batch_month, '%Y-%m-%d') AS batch_month,
    round(accuracy, 6) AS accuracy, round(recent, 6) AS recent_accuracy, degraded,
    round(CASE WHEN degraded THEN recent - accuracy ELSE 0e0 END, 6) AS degradation_amount FROM degr""",
)
def _(spark, folder):
    return monitoring.degradation(_performance(spark, folder), ["model_version"], "batch_month").select(
        "model_version", "batch_month", "accuracy", "recent_accuracy", "degraded", "degradation_amount"
    )


RECENT = f"""{LOG},
recent AS (SELECT *, row_number() OVER (ORDER BY ts, model_version) AS i, count(*) OVER () AS c FROM log
  WHERE ts > {LAST} - INTERVAL 720 HOUR AND ts <= {LAST}),
halves AS (SELECT count(*) AS c, avg(CASE WHEN i <= floor(c / 2) THEN batch_size END) AS a,
  avg(CASE WHEN i > floor(c / 2) THEN batch_size END) AS b FROM recent)"""
TREND = """CASE WHEN c < 2 THEN 'insufficient_data' WHEN b > a * 1.1e0 THEN 'increasing' WHEN b < a * 0.9e0
  THEN 'decreasing' ELSE 'stable' END"""


@query(
    "w1b_degradation_long",
    f"""WITH {ORDER_SCORES}, {PERFORMANCE} SELECT model_version, strftime(batch_month, '%Y-%m-%d') AS batch_month,
    round(accuracy, 6) AS accuracy, round(recent, 6) AS recent_accuracy, degraded,
    round(CASE WHEN degraded THEN recent - accuracy ELSE 0e0 END, 6) AS degradation_amount FROM degr""",
)
def _(spark, folder):
    return monitoring.degradation(_performance(spark, folder), ["model_version"], "batch_month", long=True).select(
        "model_version", "batch_month", "accuracy", "recent_accuracy", "degraded", "degradation_amount"
    )


RECENT = f"""{LOG},
recent AS (SELECT *, row_number() OVER (ORDER BY ts, model_version) AS i, count(*) OVER () AS c FROM log
  WHERE ts > {LAST} - INTERVAL 720 HOUR AND ts <= {LAST}),
halves AS (SELECT count(*) AS c, avg(CASE WHEN i <= floor(c / 2) THEN batch_size END) AS a,
  avg(CASE WHEN i > floor(c / 2) THEN batch_size END) AS b FROM recent)"""
TREND = """CASE WHEN c < 2 THEN 'insufficient_data' WHEN b > a * 1.1e0 THEN 'increasing' WHEN b < a * 0.9e0
  THEN 'decreasing' ELSE 'stable' END"""


@query(
    "w2_recent_stats",
    f"""WITH {RECENT} SELECT CAST(720 AS BIGINT) AS time_window_hours,
    CAST((SELECT sum(batch_size) FROM recent) AS BIGINT) AS total_predictions, CAST(c AS BIGINT) AS batch_count,
    round((SELECT avg(positive_rate) FROM recent), 6) AS average_positive_rate,
    {TREND} AS prediction_volume_trend FROM halves""",
)
def _(spark, folder):
    log = prediction_log.read(spark, _log(spark, folder))
    return monitoring.recent_stats(log, F.lit("2001-08-01 00:00:00").cast("timestamp_ntz"), hours=720)


@query(
    "w2b_rolling_stats",
    f"""WITH {LOG} SELECT model_version, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
    CAST(sum(batch_size) OVER w AS BIGINT) AS total_predictions, CAST(count(*) OVER w AS BIGINT) AS batch_count,
    round(avg(positive_rate) OVER w, 6) AS average_positive_rate FROM log
    WINDOW w AS (PARTITION BY model_version ORDER BY ts RANGE BETWEEN INTERVAL 604799 SECOND PRECEDING AND CURRENT ROW)""",
)
def _(spark, folder):
    log = prediction_log.read(spark, _log(spark, folder))
    return monitoring.rolling_stats(log, ["model_version"], "timestamp", hours=168)


@query(
    "w3_volume_trend",
    f"""WITH {LOG}, k AS (SELECT *, row_number() OVER (ORDER BY ts, model_version) AS i, count(*) OVER () AS c FROM log),
    h AS (SELECT count(*) AS c, avg(CASE WHEN i <= floor(c / 2) THEN batch_size END) AS a,
      avg(CASE WHEN i > floor(c / 2) THEN batch_size END) AS b FROM k)
    SELECT CAST(c AS BIGINT) AS batch_count, round(a, 6) AS first_half, round(b, 6) AS second_half,
    {TREND} AS prediction_volume_trend FROM h""",
)
def _(spark, folder):
    log = prediction_log.read(spark, _log(spark, folder))
    return monitoring.volume_trend(log, "timestamp", "model_version")


@query(
    "w4_newest_per_model",
    f"""WITH {ORDER_SCORES}, {PERFORMANCE} SELECT model_version, strftime(batch_month, '%Y-%m-%d') AS batch_month,
    round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY batch_month DESC)
    AS rn FROM perf) WHERE rn <= 10""",
)
def _(spark, folder):
    recent = monitoring.newest_per_group(_performance(spark, folder), ["model_version"], "batch_month", 10)
    return recent.select("model_version", "batch_month", "accuracy")


@query(
    "w5_active_alerts",
    f"""WITH {MONITOR} SELECT batch_number, "type", severity FROM alerts, lastb
    WHERE ts > last_ts - INTERVAL 24 HOUR AND ts <= last_ts""",
)
def _(spark, folder):
    metrics = _monitored(spark, folder)
    found = monitoring.alerts(metrics, ["batch_number"], "ts")
    return monitoring.active_alerts(found, _asof(metrics).scalar()).select("batch_number", "type", "severity")


@query("w6_batch_numbers", """SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) + 1
    AS BIGINT) AS batch_number FROM orders""")
def _(spark, folder):
    return scoring.batch_numbers(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query(
    "w7_running_distribution",
    """SELECT 'l_quantity' AS "column", l_quantity AS value, CAST(count(*) AS BIGINT) AS n,
    CAST(sum(count(*)) OVER (ORDER BY l_quantity) AS BIGINT) AS run_n, CAST(sum(count(*)) OVER () AS BIGINT) AS all_n
    FROM lineitem GROUP BY l_quantity
    UNION ALL SELECT 'l_discount', l_discount, CAST(count(*) AS BIGINT),
    CAST(sum(count(*)) OVER (ORDER BY l_discount) AS BIGINT), CAST(sum(count(*)) OVER () AS BIGINT)
    FROM lineitem GROUP BY l_discount""",
)
def _(spark, folder):
    from tidewatch.operators.ordered import running_totals, unpivot_numeric

    counts = (
        unpivot_numeric(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"])
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    return running_totals(counts, "value", ["n"], by=["column"])


# Sorts, limits, set operations


@query("t3_preview", """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
    row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def _(spark, folder):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey")
        .limit(50)
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")))  # 50 rows
    )


@query(
    "t4_outreach_list",
    f"""WITH {BUSINESS} SELECT customer_id, CAST(priority_score AS BIGINT) AS priority_score,
    round("MonthlyCharges", 6) AS "MonthlyCharges",
    row_number() OVER (ORDER BY priority_score DESC, "MonthlyCharges" DESC, customer_id) AS place
    FROM business WHERE intervention_recommended""",
)
def _(spark, folder):
    return scoring.outreach_list(business_subscribers(spark, folder), "customer_id").select(
        "customer_id", "priority_score", "MonthlyCharges", "place"
    )


@query(
    "u1_union_batches",
    f"""WITH {PARSED} SELECT customer_id, 'first' AS batch, tenure FROM parsed WHERE tenure <= 60
    UNION ALL SELECT customer_id, 'second', tenure FROM parsed WHERE tenure > 60 OR tenure IS NULL""",
)
def _(spark, folder):
    rows = parsed_subscribers(spark, folder).select("customer_id", "tenure")
    first = rows.where(F.col("tenure") <= 60).withColumn("batch", F.lit("first"))
    rest = rows.where((F.col("tenure") > 60) | F.col("tenure").isNull()).withColumn("batch", F.lit("second"))
    return first.unionByName(rest)


@query("u2_category_union", f"""WITH {EVENTS} SELECT DISTINCT event_type AS value FROM ev""")
def _(spark, folder):
    first, last = events_halves(spark, folder)
    return first.select(F.col("event_type").alias("value")).union(last.select("event_type")).distinct()


@query(
    "u3_category_difference",
    f"""WITH {EVENTS} SELECT event_type AS value FROM ev WHERE cur EXCEPT SELECT event_type FROM ev WHERE NOT cur""",
)
def _(spark, folder):
    first, last = events_halves(spark, folder)
    return last.select(F.col("event_type").alias("value")).subtract(first.select("event_type"))


@query("u4_distinct_values", """SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def _(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(
    "u5_category_intersection",
    f"""WITH {EVENTS} SELECT event_type AS value FROM ev WHERE cur INTERSECT SELECT event_type FROM ev WHERE NOT cur""",
)
def _(spark, folder):
    first, last = events_halves(spark, folder)
    return last.select(F.col("event_type").alias("value")).intersect(first.select("event_type"))
