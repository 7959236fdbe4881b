"""Queries over sources, projections, cleaning and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.schema import REQUEST_FIELDS, SUBSCRIBER_FIELDS
from tidewatch.operators import cleaning, features, impact, profiles, quality, scoring, validation
from tidewatch.plans.catalog import BUSINESS, GAPPY, PARSED, RAW, SCORED, SUBS, query, sql_number
from tidewatch.plans.inputs import (
    NUMBERS,
    business_subscribers,
    gappy_lineitem,
    parsed_subscribers,
    scored_subscribers,
)
from tidewatch.session import scratch_path
from tidewatch.sources import files
from tidewatch.sources.tables import ASOF, raw_subscribers, subscribers, table

# Sources and sinks


@query(
    "a1_csv_scan",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total,
    CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(0 AS BIGINT) AS n_corrupt
    FROM orders GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    path = files.write_csv(orders, files.scratch_path(spark, "orders-csv"))
    rows = files.read_csv(spark, path, orders.schema)
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("o_custkey").alias("customers"),
        F.count("_corrupt").alias("n_corrupt"),
    )


@query(
    "a2_csv_sink",
    f"""WITH {SCORED} SELECT customer_id, round(churn_probability, 6) AS churn_probability, risk_level,
    round("MonthlyCharges", 6) AS "MonthlyCharges" FROM scored""",
)
def _(spark, folder):
    rows = scored_subscribers(spark, folder).select(
        "customer_id", "churn_probability", "risk_level", "MonthlyCharges"
    )
    path = files.write_csv(rows, files.scratch_path(spark, "scored-csv"))
    return files.read_csv(spark, path, rows.schema).drop("_corrupt")


@query(
    "a3_reload_processed",
    f"""WITH {SUBS} SELECT "Contract", CAST(count(*) AS BIGINT) AS n, round(avg(tenure), 6) AS mean_tenure
    FROM subs GROUP BY 1""",
)
def _(spark, folder):
    path = files.save_processed(subscribers(spark, folder), files.scratch_path(spark, "processed"))
    return (
        files.load_processed(spark, path)
        .groupBy("Contract")
        .agg(F.count("*").alias("n"), F.avg("tenure").alias("mean_tenure"))
    )


@query(
    "a4_json_documents",
    f"""WITH {BUSINESS} SELECT "Contract", CAST(count(*) AS BIGINT) AS total_records,
    CAST(count(*) FILTER (risk_level = 'HIGH') AS BIGINT) AS high_risk_count,
    round(sum(monthly_revenue_at_risk), 6) AS monthly_revenue_at_risk FROM business GROUP BY 1""",
)
def _(spark, folder):
    summary = impact.batch_summary(business_subscribers(spark, folder), ["Contract"])
    nested = summary.select(
        "Contract",
        F.struct("total_records", "errors").alias("processing_summary"),
        F.struct("high_risk_count", "high_risk_pct").alias("risk_distribution"),
        F.struct("monthly_revenue_at_risk").alias("business_metrics"),
    )
    path = files.write_json(nested, files.scratch_path(spark, "summary-json"))
    return files.read_json(spark, path, nested.schema).select(
        "Contract",
        "processing_summary.total_records",
        "risk_distribution.high_risk_count",
        "business_metrics.monthly_revenue_at_risk",
    )


@query(
    "a7_records_to_table",
    f"""WITH {SUBS} SELECT 'subscriber' AS source, CAST(count(*) AS BIGINT) AS n,
    round(sum("MonthlyCharges"), 4) AS total FROM subs
    UNION ALL SELECT event_type, CAST(count(*) AS BIGINT),
    CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) FROM events GROUP BY 1""",
)
def _(spark, folder):
    body = subscribers(spark, folder).select(files.to_record(*NUMBERS).alias("body"))
    records = files.from_records(body, "body", "tenure double, MonthlyCharges double, TotalCharges double")
    events = table(spark, folder, "events")
    parsed = files.from_records(events, "props", "k bigint", keep=["event_type"])
    return records.select(F.lit("subscriber").alias("source"), F.col("MonthlyCharges").alias("v")).unionByName(
        parsed.select(F.col("event_type").alias("source"), F.col("k").cast("double").alias("v"))
    ).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(
    "a10_template_rows",
    f"""WITH {SUBS}, t(template, tenure, "MonthlyCharges", "TotalCharges") AS (
      VALUES (1, 12e0, 50e0, 600e0), (2, 24e0, 65e0, 1560e0), (3, 36e0, 80e0, 2880e0), (4, 48e0, 45e0, 2160e0),
             (5, 6e0, 95e0, 570e0)),
    s AS (SELECT avg(tenure) AS mt, stddev_pop(tenure) AS st, avg("MonthlyCharges") AS mm,
      stddev_pop("MonthlyCharges") AS sm, avg("TotalCharges") AS ma, stddev_pop("TotalCharges") AS sa FROM subs)
    SELECT CAST(template AS BIGINT) AS template, round((tenure - mt) / st, 6) AS tenure,
      round(("MonthlyCharges" - mm) / sm, 6) AS "MonthlyCharges",
      round(("TotalCharges" - ma) / sa, 6) AS "TotalCharges" FROM t, s""",
)
def _(spark, folder):
    return features.standardize(files.template_rows(spark), NUMBERS, fitted_on=subscribers(spark, folder))


# Projections, filters, conditional columns


@query(
    "b1_features_target",
    f"""WITH {SUBS} SELECT round(tenure, 6) AS tenure, round("MonthlyCharges", 6) AS "MonthlyCharges",
    round("TotalCharges", 6) AS "TotalCharges", CAST("Churn" AS BIGINT) AS "Churn" FROM subs""",
)
def _(spark, folder):
    configured = [*NUMBERS, "Contract_length", "PaymentMethod", "InternetService"]
    return features.features_and_target(subscribers(spark, folder), configured, "Churn")


@query(
    "b2_drop_columns",
    f"""WITH {SUBS} SELECT tenure, round("MonthlyCharges", 6) AS "MonthlyCharges",
    round("TotalCharges", 6) AS "TotalCharges", "Contract", CAST("Churn" AS BIGINT) AS "Churn",
    CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM subs""",
)
def _(spark, folder):
    return subscribers(spark, folder).drop("customer_id", "c_name", "Names", "Company")


@query("b3_parse_numbers", f"""WITH {PARSED} SELECT * FROM parsed""")
def _(spark, folder):
    return parsed_subscribers(spark, folder)


@query("b4_high_risk_filter", f"""WITH {SCORED} SELECT customer_id, churn_probability, risk_level FROM scored
    WHERE risk_level = 'HIGH'""")
def _(spark, folder):
    return (
        scored_subscribers(spark, folder)
        .where(F.col("risk_level") == "HIGH")
        .select("customer_id", "churn_probability", "risk_level")
    )


@query(
    "b5_risk_bands",
    f"""WITH {SCORED} SELECT customer_id, risk_level,
    CASE WHEN churn_probability >= 0.7e0 THEN 'HIGH' WHEN churn_probability >= 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END
    AS request_band FROM scored""",
)
def _(spark, folder):
    return scored_subscribers(spark, folder).select(
        "customer_id", "risk_level", C.risk_band("churn_probability", medium=0.4).alias("request_band")
    )


CONFIDENCE = """CASE WHEN churn_probability > 0.8e0 OR churn_probability < 0.2e0 THEN 'High'
    WHEN churn_probability > 0.6e0 OR churn_probability < 0.4e0 THEN 'Medium' ELSE 'Low' END"""


@query("b6_confidence_level", f"""WITH {SCORED} SELECT customer_id, {CONFIDENCE} AS confidence_level FROM scored""")
def _(spark, folder):
    return scored_subscribers(spark, folder).select(
        "customer_id", C.confidence_level("churn_probability").alias("confidence_level")
    )


@query(
    "b7_confidence_score",
    f"""WITH {SCORED} SELECT customer_id, CASE WHEN churn_probability > 0.8e0 OR churn_probability < 0.2e0
    THEN 0.9e0 ELSE 0.7e0 END AS confidence_score FROM scored""",
)
def _(spark, folder):
    return scored_subscribers(spark, folder).select(
        "customer_id", C.confidence_score("churn_probability").alias("confidence_score")
    )


@query(
    "b8_hard_label",
    f"""WITH {SCORED} SELECT customer_id, CAST(churn_probability >= 0.5e0 AS BIGINT) AS prediction,
    CASE WHEN churn_probability >= 0.5e0 THEN 'Churn' ELSE 'Retain' END AS prediction_label FROM scored""",
)
def _(spark, folder):
    label = C.hard_label("churn_probability")
    return scored_subscribers(spark, folder).select(
        "customer_id", label.alias("prediction"), C.label_text(label).alias("prediction_label")
    )


@query(
    "b9_batch_rules",
    f"""WITH {PARSED}, m AS (SELECT bool_or(tenure < 0) AS a, bool_or("MonthlyCharges" < 0) AS b,
      bool_or("TotalCharges" < 0) AS c, bool_or(tenure > 100) AS d, bool_or("MonthlyCharges" > 1000) AS e,
      (count(*) * 3 - count(tenure) - count("MonthlyCharges") - count("TotalCharges")) / (count(*) * 3e0) AS r
      FROM parsed),
    i AS (SELECT r, list_filter([CASE WHEN a THEN 'Negative values found in tenure' END,
      CASE WHEN b THEN 'Negative values found in MonthlyCharges' END,
      CASE WHEN c THEN 'Negative values found in TotalCharges' END,
      CASE WHEN d THEN 'Tenure values > 100 months found' END,
      CASE WHEN e THEN 'Monthly charges > $1000 found' END,
      CASE WHEN r > 0.1e0 THEN printf('High missing value ratio: %.1f%%', round(r * 100, 1)) END], lambda x: x IS NOT NULL) AS l FROM m)
    SELECT len(l) = 0 AS valid, array_to_string(l, '; ') AS issues, round(1 - r, 6) AS quality_score FROM i""",
)
def _(spark, folder):
    return validation.batch_rules(parsed_subscribers(spark, folder))


ROUTED = f"""{PARSED}, r AS (SELECT *, list_filter([
      CASE WHEN tenure IS NULL THEN 'tenure: null' END, CASE WHEN tenure < 0 THEN 'tenure: below minimum' END,
      CASE WHEN tenure > 100 THEN 'tenure: above maximum' END,
      CASE WHEN "MonthlyCharges" IS NULL THEN 'MonthlyCharges: null' END,
      CASE WHEN "MonthlyCharges" < 0 THEN 'MonthlyCharges: below minimum' END,
      CASE WHEN "MonthlyCharges" > 500 THEN 'MonthlyCharges: above maximum' END,
      CASE WHEN "TotalCharges" IS NULL THEN 'TotalCharges: null' END,
      CASE WHEN "TotalCharges" < 0 THEN 'TotalCharges: below minimum' END,
      CASE WHEN "TotalCharges" > 10000 THEN 'TotalCharges: above maximum' END], lambda x: x IS NOT NULL) AS reasons
      FROM parsed)"""


@query(
    "b10_valid_rejected",
    f"""WITH {ROUTED}
    SELECT customer_id, CASE WHEN len(reasons) = 0 THEN 'valid' ELSE 'rejected' END AS route,
      array_to_string(reasons, '; ') AS reasons FROM r""",
)
def _(spark, folder):
    valid, rejected = validation.split_requests(parsed_subscribers(spark, folder), REQUEST_FIELDS)
    return valid.select("customer_id", F.lit("valid").alias("route"), F.lit("").alias("reasons")).unionByName(
        rejected.select(
            "customer_id", F.lit("rejected").alias("route"), F.array_join("reasons", "; ").alias("reasons")
        )
    )


def _sql_clip(c: str, hi: int) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, 0e0), {hi}e0) END"


@query(
    "b11_clip",
    f"""WITH {PARSED} SELECT customer_id, {_sql_clip("tenure", 100)} AS tenure,
    {_sql_clip('"MonthlyCharges"', 1000)} AS "MonthlyCharges", {_sql_clip('"TotalCharges"', 10000)} AS "TotalCharges"
    FROM parsed""",
)
def _(spark, folder):
    limits = {f.name: (f.low, f.high) for f in SUBSCRIBER_FIELDS if f.high is not None}
    return parsed_subscribers(spark, folder).select(
        "customer_id", *[C.clip(c, *limits[c]).alias(c) for c in NUMBERS]
    )


@query(
    "b12_keep_allowed",
    f"""WITH {RAW} SELECT customer_id, CASE WHEN gender IN ('Male', 'Female') THEN gender END AS gender,
    CASE WHEN "InternetService" IN ('DSL', 'Fiber optic', 'No') THEN "InternetService" END AS "InternetService"
    FROM raw""",
)
def _(spark, folder):
    return raw_subscribers(spark, folder).select(
        "customer_id",
        C.keep_allowed("gender", ["Male", "Female"]).alias("gender"),
        C.keep_allowed("InternetService", ["DSL", "Fiber optic", "No"]).alias("InternetService"),
    )


SQL_BOOLEAN = """CASE WHEN {c} IN ('true', 'True', 'yes', 'Yes', 'y', 'Y', '1') THEN true
    WHEN {c} IN ('false', 'False', 'no', 'No', 'n', 'N', '0') THEN false END"""


@query(
    "b13_booleans",
    f"""WITH {RAW} SELECT customer_id, {SQL_BOOLEAN.format(c='"SeniorCitizen"')} AS senior,
    {SQL_BOOLEAN.format(c='"Partner"')} AS partner FROM raw""",
)
def _(spark, folder):
    return raw_subscribers(spark, folder).select(
        "customer_id", C.to_boolean("SeniorCitizen").alias("senior"), C.to_boolean("Partner").alias("partner")
    )


def _sql_sanitized(f) -> str:
    c = f'"{f.name}"'
    if f.kind == "numeric":
        return f"CASE WHEN ({sql_number(c)}) IS NOT NULL THEN least(greatest({sql_number(c)}, {f.low}e0), {f.high}e0) END AS {c}"
    if f.kind == "categorical":
        values = ", ".join(f"'{v}'" for v in f.allowed)
        return f"CASE WHEN {c} IN ({values}) THEN {c} END AS {c}"
    if f.kind == "boolean":
        return SQL_BOOLEAN.format(c=c) + f" AS {c}"
    return c


@query(
    "b14_sanitize",
    f"""WITH {RAW} SELECT customer_id, {", ".join(_sql_sanitized(f) for f in SUBSCRIBER_FIELDS)},
    CAST("Churn" AS BIGINT) AS "Churn" FROM raw""",
)
def _(spark, folder):
    return cleaning.sanitize(raw_subscribers(spark, folder), SUBSCRIBER_FIELDS)


@query(
    "b15_business_columns",
    f"""WITH {BUSINESS} SELECT customer_id, round(monthly_revenue_at_risk, 6) AS monthly_revenue_at_risk,
    intervention_recommended, round(estimated_ltv, 6) AS estimated_ltv,
    CAST(priority_score AS BIGINT) AS priority_score FROM business""",
)
def _(spark, folder):
    return business_subscribers(spark, folder).select(
        "customer_id", "monthly_revenue_at_risk", "intervention_recommended", "estimated_ltv", "priority_score"
    )


@query(
    "b16_business_record",
    f"""WITH {BUSINESS} SELECT customer_id, round(monthly_revenue_at_risk, 6) AS monthly_revenue_at_risk,
    intervention_recommended, round(estimated_ltv, 6) AS estimated_lifetime_value,
    risk_level AS retention_priority FROM business""",
)
def _(spark, folder):
    rows = scored_subscribers(spark, folder).select(
        "customer_id", C.business_record("risk_level", "MonthlyCharges").alias("business_impact")
    )
    return rows.select("customer_id", "business_impact.*")


@query(
    "b17_constant_fill",
    f"""WITH {PARSED} SELECT customer_id, coalesce(tenure, 0) AS tenure,
    coalesce("MonthlyCharges", 0) AS "MonthlyCharges", coalesce("TotalCharges", 0) AS "TotalCharges" FROM parsed""",
)
def _(spark, folder):
    return cleaning.fill_constant(parsed_subscribers(spark, folder), NUMBERS)


@query(
    "b18_columns_by_type",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    return part.select(*quality.numeric_columns(part))


@query(
    "b19_rule_score",
    f"""WITH {SUBS}, r AS (SELECT customer_id, round(least(CASE WHEN tenure < 12 THEN 0.3e0 ELSE 0.3e0 END
      + CASE WHEN tenure < 6 THEN 0.5e0 ELSE 0e0 END + CASE WHEN "MonthlyCharges" > 70 THEN 0.1e0 ELSE 0e0 END,
      0.95e0), 2) AS score FROM subs)
    SELECT customer_id, score, CASE WHEN score > 0.7e0 THEN 'HIGH' WHEN score > 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END
    AS band FROM r""",
)
def _(spark, folder):
    rows = subscribers(spark, folder).select("customer_id", C.rule_score("tenure", "MonthlyCharges").alias("score"))
    return rows.withColumn("band", C.rule_band("score"))


@query(
    "b20_engineered_columns",
    f"""WITH {PARSED} SELECT customer_id,
    round((coalesce("MonthlyCharges", 0) + coalesce("TotalCharges", 0)) / (tenure + 1), 6) AS avg_monthly_spend,
    CASE WHEN tenure <= 0 THEN NULL WHEN tenure <= 12 THEN 'New' WHEN tenure <= 36 THEN 'Mid' WHEN tenure <= 60
    THEN 'Long' WHEN tenure IS NOT NULL THEN 'Loyal' END AS tenure_bucket FROM parsed""",
)
def _(spark, folder):
    return features.engineer(parsed_subscribers(spark, folder)).select(
        "customer_id", "avg_monthly_spend", "tenure_bucket"
    )


@query(
    "b21_error_rows",
    f"""WITH {PARSED}, v AS (SELECT *, coalesce(tenure BETWEEN 0 AND 100 AND "MonthlyCharges" BETWEEN 0 AND 500
      AND "TotalCharges" BETWEEN 0 AND 10000, false) AS ok FROM parsed),
    s AS (SELECT *, CASE WHEN ok THEN round(1 / (1 + exp(-(1.6e0 + tenure * -0.05e0 + "MonthlyCharges" * 0.008e0
      + "TotalCharges" * -0.0008e0))), 6) ELSE 0e0 END AS churn_probability FROM v)
    SELECT customer_id, churn_probability, CASE WHEN NOT ok THEN 'ERROR' WHEN churn_probability >= 0.7e0 THEN 'HIGH'
      WHEN churn_probability >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, NOT ok AS has_message FROM s""",
)
def _(spark, folder):
    return scoring.score_with_errors(parsed_subscribers(spark, folder)).select(
        "customer_id", "churn_probability", "risk_level", F.col("error_message").isNotNull().alias("has_message")
    )


@query(
    "b22_stamp",
    f"""WITH {SCORED} SELECT customer_id, churn_probability, '2000-08-01 00:00:00' AS prediction_timestamp,
    'v1.0' AS model_version FROM scored""",
)
def _(spark, folder):
    return scoring.stamp(
        scored_subscribers(spark, folder).select("customer_id", "churn_probability"), ASOF, "v1.0"
    )


# Data quality and validation


@query("d1_shape", """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem""")
def _(spark, folder):
    return quality.shape(table(spark, folder, "lineitem"))


GAPPY_COLUMNS = [
    "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
]


@query(
    "d2_null_profile",
    f"WITH {GAPPY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
        round((count(*) - count({c})) * 100e0 / count(*), 6) AS pct_missing FROM gappy"""
        for c in GAPPY_COLUMNS
    ),
)
def _(spark, folder):
    return quality.null_profile(gappy_lineitem(spark, folder))


@query(
    "d3_duplicate_rows",
    f"""WITH {GAPPY}, twice AS (SELECT * FROM gappy UNION ALL SELECT * FROM gappy WHERE l_quantity > 40),
    g AS (SELECT twice.*, count(*) AS c FROM twice GROUP BY ALL)
    SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM g""",
)
def _(spark, folder):
    rows = gappy_lineitem(spark, folder)
    # Whole rows; those of large quantity are delivered a second time.
    return quality.duplicate_rows(rows.unionByName(rows.where(F.col("l_quantity") > 40)))


@query(
    "d4_distinct_counts",
    f"WITH {GAPPY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM gappy"""
        for c in GAPPY_COLUMNS
    ),
)
def _(spark, folder):
    return quality.distinct_counts(gappy_lineitem(spark, folder), GAPPY_COLUMNS)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "d5_describe",
    f"WITH {GAPPY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count", round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.25), 6) AS q25,
        round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS "max"
        FROM gappy"""
        for c in MEASURES
    ),
)
def _(spark, folder):
    return quality.describe_numeric(gappy_lineitem(spark, folder), MEASURES)


@query(
    "d6_top_values",
    " UNION ALL ".join(
        f"""(SELECT "column", value, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank,
        CAST(n_distinct AS BIGINT) AS n_distinct FROM (
          SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, count(*) OVER () AS n_distinct
          FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) t WHERE rank <= 5)"""
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")
    ),
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return quality.top_values(orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


ORDER_COLUMNS = ("o_orderstatus", "o_orderpriority", "o_custkey")


def stored_order_profiles(spark, folder):
    """Monthly profiles of the orders, written and read back, and the orders with their month."""
    orders = table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    path = scratch_path(spark, "profiles")
    profiles.save_profile(profiles.profile(orders, "month", ORDER_COLUMNS), path)
    return profiles.load_profile(spark, path), orders


@query(
    "d4b_distinct_from_profiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_missing,
        CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, true AS within_bound FROM orders"""
        for c in ORDER_COLUMNS
    ),
)
def _(spark, folder):
    """The merged sketches against exact counts: within five standard errors."""
    stored, orders = stored_order_profiles(spark, folder)
    merged = profiles.merged_profile(stored).select("column", "n_rows", "n_missing", F.col("n_distinct").alias("estimate"))
    exact = quality.distinct_counts(orders, ORDER_COLUMNS)
    return merged.join(exact, "column").select(
        "column", "n_rows", "n_missing", "n_distinct",
        (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.04 * F.col("n_distinct")).alias("within_bound"),
    )


@query(
    "d6b_top_from_profiles",
    " UNION ALL ".join(
        f"""(SELECT "column", value, CAST(n AS BIGINT) AS n, CAST(rank AS BIGINT) AS rank FROM (
          SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank
          FROM orders WHERE {c} IS NOT NULL AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY {c}) t WHERE rank <= 5)"""
        for c in ORDER_COLUMNS
    ),
)
def _(spark, folder):
    stored, orders = stored_order_profiles(spark, folder)
    return profiles.top_values(stored.where("part >= 199801"), orders.where("month >= 199801"), ORDER_COLUMNS)


@query(
    "d7_completeness",
    f"""WITH {GAPPY}, m AS (SELECT count(*) AS n, 4 * count(*) - count(l_discount) - count(l_tax) - count(l_returnflag)
    - count(l_quantity) AS missing FROM gappy)
    SELECT CAST(n AS BIGINT) AS n_rows, CAST(missing AS BIGINT) AS n_missing,
    round(1 - missing / (n * 4e0), 6) AS completeness FROM m""",
)
def _(spark, folder):
    return quality.completeness(
        gappy_lineitem(spark, folder), ["l_discount", "l_tax", "l_returnflag", "l_quantity"]
    )


# Schema findings over the raw export. Each rule has a count query; d8 gives the whole verdict.
_NUMERIC = [f for f in SUBSCRIBER_FIELDS if f.kind == "numeric"]
_LISTED = [f for f in SUBSCRIBER_FIELDS if f.kind == "categorical"]
_REQUIRED = SUBSCRIBER_FIELDS


def _sql_values(f) -> str:
    return ", ".join(f"'{v}'" for v in f.allowed)


_SQL_NULLS = " UNION ALL ".join(
    f"""SELECT '{f.name}' AS field, 'null' AS rule, 'error' AS severity,
    CAST(count(*) - count("{f.name}") AS BIGINT) AS n FROM raw"""
    for f in _REQUIRED
)
_SQL_BAD = " UNION ALL ".join(
    f"""SELECT '{f.name}' AS field, 'not_numeric' AS rule, 'error' AS severity,
    CAST(count(*) FILTER ("{f.name}" IS NOT NULL AND ({sql_number(f'"{f.name}"')}) IS NULL) AS BIGINT) AS n FROM raw"""
    for f in _NUMERIC
)
_SQL_RANGE = " UNION ALL ".join(
    f"""SELECT '{f.name}' AS field, '{rule}' AS rule, 'error' AS severity,
    CAST(CASE WHEN count("{f.name}") = count({sql_number(f'"{f.name}"')}) THEN
      count(*) FILTER ({sql_number(f'"{f.name}"')} {op} {limit}) ELSE 0 END AS BIGINT) AS n FROM raw"""
    for f in _NUMERIC
    for rule, op, limit in (("below_minimum", "<", f.low), ("above_maximum", ">", f.high))
)
_SQL_LISTED = " UNION ALL ".join(
    f"""SELECT '{f.name}' AS field, 'invalid_value' AS rule, 'error' AS severity,
    CAST(count(*) FILTER ("{f.name}" NOT IN ({_sql_values(f)})) AS BIGINT) AS n FROM raw"""
    for f in _LISTED
)
BOOL_LIKE = "'0', '1', 'true', 'false', 'True', 'False', 'yes', 'no', 'Yes', 'No'"
_SQL_BOOL = f"""SELECT 'SeniorCitizen' AS field, 'not_boolean' AS rule, 'error' AS severity,
    CAST(count(*) FILTER ("SeniorCitizen" NOT IN ({BOOL_LIKE})) AS BIGINT) AS n FROM raw"""
_SQL_EMPTY = """SELECT 'customerID' AS field, 'empty_text' AS rule, 'warning' AS severity,
    CAST(count(*) FILTER ("customerID" = '') AS BIGINT) AS n FROM raw"""


def _findings(spark, folder, *rules):
    found = validation.cell_findings(raw_subscribers(spark, folder), SUBSCRIBER_FIELDS)
    return found.where(F.col("rule").isin(*rules))


@query("d9_null_violations", f"WITH {RAW} SELECT * FROM ({_SQL_NULLS}) t WHERE n > 0")
def _(spark, folder):
    return _findings(spark, folder, "null")


@query("d10_non_numeric", f"WITH {RAW} SELECT * FROM ({_SQL_BAD}) t WHERE n > 0")
def _(spark, folder):
    return _findings(spark, folder, "not_numeric")


_CHARGES_SQL = [
    f"""SELECT '{c}' AS field, '{rule}' AS rule, 'error' AS severity, CAST(count(*) FILTER ("{c}" {op} {limit}) AS BIGINT) AS n
    FROM parsed"""
    for c, high in (("tenure", 100), ("MonthlyCharges", 1000), ("TotalCharges", 10000))
    for rule, op, limit in (("below_minimum", "<", 0), ("above_maximum", ">", high))
]


@query("d11_range_violations", f"WITH {PARSED} SELECT * FROM ({' UNION ALL '.join(_CHARGES_SQL)}) t WHERE n > 0")
def _(spark, folder):
    found = validation.cell_findings(parsed_subscribers(spark, folder), _NUMERIC)
    return found.where(F.col("rule").isin("below_minimum", "above_maximum"))


@query(
    "d12_outlier_warnings",
    "WITH e AS (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), "
    "b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e) "
    """SELECT 'value' AS field, 'outliers' AS rule, 'warning' AS severity, CAST(count(*) AS BIGINT) AS n
    FROM e, b WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)
    HAVING count(*) > 0.001e0 * (SELECT count(*) FROM e)""",
)
def _(spark, folder):
    from tidewatch.functions.schema import NUMERIC, Field

    events = table(spark, folder, "events").select("value", F.get_json_object("props", "$.k").alias("k"))
    return validation.outlier_warnings(events, [Field("value", NUMERIC), Field("k", NUMERIC)], share=0.001)


@query(
    "d13_invalid_values",
    f"WITH {RAW} "
    + " UNION ALL ".join(
        f"""SELECT '{f.name}' AS field, "{f.name}" AS value, CAST(count(*) AS BIGINT) AS n FROM raw
        WHERE "{f.name}" NOT IN ({_sql_values(f)}) GROUP BY 2"""
        for f in _LISTED
    ),
)
def _(spark, folder):
    return validation.invalid_values(raw_subscribers(spark, folder), _LISTED)


@query(
    "d14_high_cardinality",
    f"""WITH {RAW} SELECT 'customerID' AS field, 'high_cardinality' AS rule, 'warning' AS severity,
    CAST(count(DISTINCT "customerID") AS BIGINT) AS n FROM raw HAVING count(DISTINCT "customerID") > 50""",
)
def _(spark, folder):
    from tidewatch.functions.schema import CATEGORICAL, Field

    fields = [Field("customerID", CATEGORICAL), Field("Contract", CATEGORICAL), Field("PaymentMethod", CATEGORICAL)]
    return validation.cardinality_warnings(raw_subscribers(spark, folder), fields)


@query(
    "d15_non_boolean_values",
    f"""WITH {RAW} SELECT 'SeniorCitizen' AS field, "SeniorCitizen" AS value, CAST(count(*) AS BIGINT) AS n FROM raw
    WHERE "SeniorCitizen" NOT IN ({BOOL_LIKE}) GROUP BY 2""",
)
def _(spark, folder):
    fields = [f for f in SUBSCRIBER_FIELDS if f.kind == "boolean"]
    return validation.invalid_values(raw_subscribers(spark, folder), fields)


@query(
    "d16_text_checks",
    """SELECT * FROM (SELECT 'text' AS field, 'empty_text' AS rule, 'warning' AS severity,
      CAST(count(*) FILTER (text = '') AS BIGINT) AS n FROM documents
    UNION ALL SELECT 'text', 'long_text', 'warning', CAST(CASE WHEN max(length(text)) > 1000 THEN max(length(text))
      ELSE 0 END AS BIGINT) FROM documents) t WHERE n > 0""",
)
def _(spark, folder):
    from tidewatch.functions.schema import STRING, Field

    return validation.cell_findings(table(spark, folder, "documents"), [Field("text", STRING)])


@query(
    "d8_schema_verdict",
    f"""WITH {RAW}, f AS ({" UNION ALL ".join([_SQL_NULLS, _SQL_BAD, _SQL_RANGE, _SQL_LISTED, _SQL_BOOL, _SQL_EMPTY])}
      UNION ALL SELECT c, 'extra_field', 'warning', 1 FROM (VALUES ('customer_id'), ('Churn')) x(c))
    SELECT field, rule, severity, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""",
)
def _(spark, folder):
    return validation.validate(raw_subscribers(spark, folder), SUBSCRIBER_FIELDS)


_ISSUE_SQL = []
for _f in SUBSCRIBER_FIELDS:
    _c = f'"{_f.name}"'
    _ISSUE_SQL.append(f"CASE WHEN {_c} IS NULL THEN '{_f.name}: null' END")
    if _f.kind == "numeric":
        _n = f"({sql_number(_c)})"
        _ISSUE_SQL += [
            f"CASE WHEN {_c} IS NOT NULL AND {_n} IS NULL THEN '{_f.name}: not numeric' END",
            f"CASE WHEN {_n} < {_f.low} THEN '{_f.name}: below minimum' END",
            f"CASE WHEN {_n} > {_f.high} THEN '{_f.name}: above maximum' END",
        ]
    elif _f.kind == "categorical":
        _ISSUE_SQL.append(f"CASE WHEN {_c} NOT IN ({_sql_values(_f)}) THEN '{_f.name}: invalid value' END")
    elif _f.kind == "boolean":
        _ISSUE_SQL.append(f"CASE WHEN {_c} NOT IN ({BOOL_LIKE}) THEN '{_f.name}: not boolean' END")
    else:
        _ISSUE_SQL.append(f"CASE WHEN {_c} = '' THEN '{_f.name}: empty text' END")


@query(
    "d17_record_verdicts",
    f"""WITH {RAW}, i AS (SELECT customer_id, list_filter([{", ".join(_ISSUE_SQL)}], lambda x: x IS NOT NULL) AS l FROM raw)
    SELECT customer_id, len(list_filter(l, lambda x: NOT ends_with(x, ': empty text'))) = 0 AS valid,
    array_to_string(l, '; ') AS issues FROM i""",
)
def _(spark, folder):
    rows = validation.record_verdicts(raw_subscribers(spark, folder), SUBSCRIBER_FIELDS, "customer_id")
    return rows.withColumn("issues", F.array_join("issues", "; "))


@query(
    "d18_outlier_rows",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT 'value' AS "column", event_id, value FROM events, b
    WHERE value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1)""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value", F.hour("ts").alias("hour"))
    return quality.outlier_rows(events, "event_id", ["value", "hour"])


@query(
    "d19_model_input_gate",
    f"""WITH {PARSED} SELECT 'empty_table' AS "check", '*' AS "column", CAST(count(*) = 0 AS BIGINT) AS n,
      count(*) > 0 AS passed FROM parsed
    UNION ALL SELECT 'missing_values', 'tenure', count(*) - count(tenure), count(*) = count(tenure) FROM parsed
    UNION ALL SELECT 'missing_values', 'MonthlyCharges', count(*) - count("MonthlyCharges"),
      count(*) = count("MonthlyCharges") FROM parsed
    UNION ALL SELECT 'missing_values', 'TotalCharges', count(*) - count("TotalCharges"),
      count(*) = count("TotalCharges") FROM parsed
    UNION ALL SELECT 'absent_column', 'Contract', 1, false
    UNION ALL SELECT 'extra_column', 'customer_id', 1, true""",
)
def _(spark, folder):
    return quality.model_input_gate(parsed_subscribers(spark, folder), [*NUMBERS, "Contract"])


@query(
    "d20_median_fill",
    f"""WITH {PARSED}, m AS (SELECT median(tenure) AS a, median("MonthlyCharges") AS b, median("TotalCharges") AS c
      FROM parsed)
    SELECT customer_id, round(coalesce(tenure, a), 6) AS tenure, round(coalesce("MonthlyCharges", b), 6)
      AS "MonthlyCharges", round(coalesce("TotalCharges", c), 6) AS "TotalCharges" FROM parsed, m""",
)
def _(spark, folder):
    return cleaning.fill_median(parsed_subscribers(spark, folder), NUMBERS)


@query(
    "d21_mode_fill",
    f"""WITH {RAW}, g AS (SELECT gender FROM raw WHERE gender IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    d AS (SELECT "Dependents" FROM raw WHERE "Dependents" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT customer_id, coalesce(raw.gender, g.gender, 'Unknown') AS gender,
    coalesce(raw."Dependents", d."Dependents", 'Unknown') AS "Dependents" FROM raw, g, d""",
)
def _(spark, folder):
    raw = raw_subscribers(spark, folder).select("customer_id", "gender", "Dependents")
    return cleaning.fill_mode(raw, ["gender", "Dependents"])


@query(
    "d22_narrowest_types",
    """SELECT * FROM (
    SELECT 'o_orderkey' AS "column", 'bigint' AS from_type, CASE WHEN max(o_orderkey) <= 127 THEN 'tinyint'
      WHEN max(o_orderkey) <= 32767 THEN 'smallint' WHEN max(o_orderkey) <= 2147483647 THEN 'int' ELSE 'bigint' END
      AS to_type FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', CASE WHEN max(o_custkey) <= 127 THEN 'tinyint'
      WHEN max(o_custkey) <= 32767 THEN 'smallint' WHEN max(o_custkey) <= 2147483647 THEN 'int' ELSE 'bigint' END
      FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', 'float' FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', CASE WHEN count(DISTINCT o_orderstatus) < 0.5 * count(*)
      THEN 'dictionary' ELSE 'string' END FROM orders
    UNION ALL SELECT 'o_orderpriority', 'string', CASE WHEN count(DISTINCT o_orderpriority) < 0.5 * count(*)
      THEN 'dictionary' ELSE 'string' END FROM orders) t GROUP BY ALL""",
)
def _(spark, folder):
    return quality.narrowest_types(table(spark, folder, "orders"))


@query(
    "d23_correlation",
    f"WITH {GAPPY} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS "column", round(corr({a}, {b}), 6) AS correlation FROM gappy"""
        for a in MEASURES
        for b in MEASURES
    ),
)
def _(spark, folder):
    return quality.correlation(gappy_lineitem(spark, folder), MEASURES)


WIDTH = 64


@query(
    "d23b_wide_correlation",
    f"""WITH v AS (SELECT vec_id, unnest(range({WIDTH})) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
      WHERE len(embedding) = {WIDTH})
    SELECT 'c' || a.i AS "row", 'c' || b.i AS "column", round(corr(a.x, b.x), 6) AS correlation
    FROM v a JOIN v b USING (vec_id) GROUP BY a.i, b.i""",
)
def _(spark, folder):
    wide = table(spark, folder, "embeddings").where(F.size("embedding") == WIDTH)
    wide = wide.select(*[F.get("embedding", F.lit(i)).alias(f"c{i}") for i in range(WIDTH)])
    return quality.correlation(wide, wide.columns)


@query(
    "d24_histogram",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w,
      count(*) AS total FROM lineitem),
    c AS (SELECT least(floor((l_extendedprice - lo) / w), 29) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
    SELECT 'l_extendedprice' AS "column", CAST(g.i AS BIGINT) AS bin, round(lo + g.i * w, 6) AS left_edge,
      CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / (total * w), 6) AS density
    FROM range(30) g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i""",
)
def _(spark, folder):
    return quality.histogram(table(spark, folder, "lineitem"), ["l_extendedprice"])


@query(
    "d25_kernel_density",
    f"""WITH {SUBS}, b AS (SELECT min(tenure) - 0.5e0 * (max(tenure) - min(tenure)) AS start,
      2 * (max(tenure) - min(tenure)) / 999 AS step, stddev_samp(tenure) * pow(count(*), -0.2e0) AS h,
      count(*) AS total FROM subs),
    v AS (SELECT tenure AS x, count(*) AS n FROM subs GROUP BY 1)
    SELECT CAST(g.i AS BIGINT) AS point, round(start + g.i * step, 6) AS x,
      round(sum(n * exp(-0.5e0 * pow((start + g.i * step - v.x) / h, 2))) / (total * h * sqrt(2 * pi())), 6) AS density
    FROM range(1000) g(i), b, v GROUP BY g.i, start, step, h, total""",
)
def _(spark, folder):
    return quality.kernel_density(subscribers(spark, folder), "tenure")


@query(
    "d26_target_share",
    f"""WITH {SUBS} SELECT CAST("Churn" AS BIGINT) AS target, CAST(count(*) AS BIGINT) AS n,
    round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM subs GROUP BY 1""",
)
def _(spark, folder):
    return quality.target_share(subscribers(spark, folder), "Churn")


@query(
    "d27_target_mean_by_category",
    f"""WITH {SUBS} SELECT "Contract", round(avg("Churn"), 6) AS mean_target FROM subs GROUP BY 1""",
)
def _(spark, folder):
    return features.target_means(subscribers(spark, folder), "Contract", "Churn", "mean_target")
