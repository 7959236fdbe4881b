"""Named queries over a data folder, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources.tables import RAW_FIELDS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; its result is brought to plain comparable types."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, integers to bigint, times to text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


# Shared table expressions for the SQL twins.

SUBS = """
subs AS (
  SELECT c_custkey AS customer_id,
         CAST(floor(date_diff('day', CAST(first_order AS DATE), DATE '2000-08-01') / 30.4375) AS DOUBLE) AS tenure,
         (cents // n_orders) / 100000e0 AS "MonthlyCharges",
         cents / 100000e0 AS "TotalCharges",
         c_mktsegment AS "Contract",
         1 - came_back AS "Churn",
         c_name, c_nationkey, c_acctbal
  FROM (
    SELECT o_custkey,
           min(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN o_orderdate END) AS first_order,
           count(*) FILTER (o_orderdate < TIMESTAMP '2000-08-01') AS n_orders,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderdate < TIMESTAMP '2000-08-01') AS BIGINT)
             AS cents,
           max(CASE WHEN o_orderdate >= TIMESTAMP '2000-08-01' THEN 1 ELSE 0 END) AS came_back
    FROM orders
    WHERE o_orderdate < TIMESTAMP '2000-08-01' + INTERVAL 365 DAY
    GROUP BY o_custkey
  ) a JOIN customer ON o_custkey = c_custkey
  WHERE first_order IS NOT NULL
)"""

SCORED = f"""{SUBS},
scored0 AS (
  SELECT *, round(1 / (1 + exp(-(1.6e0 + tenure * -0.05e0 + "MonthlyCharges" * 0.008e0
                                 + "TotalCharges" * -0.0008e0))), 6) AS churn_probability
  FROM subs
),
scored AS (
  SELECT *, CASE WHEN churn_probability >= 0.7e0 THEN 'HIGH' WHEN churn_probability >= 0.3e0 THEN 'MEDIUM'
                 ELSE 'LOW' END AS risk_level
  FROM scored0
)"""

BUSINESS = f"""{SCORED},
business AS (
  SELECT *, CASE WHEN risk_level = 'HIGH' THEN "MonthlyCharges" ELSE 0e0 END AS monthly_revenue_at_risk,
         risk_level IN ('HIGH', 'MEDIUM') AS intervention_recommended,
         "MonthlyCharges" * 24 AS estimated_ltv,
         CASE risk_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS priority_score
  FROM scored
)"""

RAW = f"""{SUBS},
raw AS (
  SELECT customer_id, {", ".join(f'{sql} AS "{name}"' for name, sql in RAW_FIELDS.items())}, "Churn"
  FROM subs
)"""

NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def sql_number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


PARSED = f"""{RAW},
parsed AS (
  SELECT customer_id, {", ".join(f'{sql_number(chr(34) + c + chr(34))} AS "{c}"' for c in ("tenure", "MonthlyCharges", "TotalCharges"))}
  FROM raw
)"""

ORDER_SCORES = """
order_scores AS (
  SELECT o_orderkey, o_orderpriority AS model_version, o_orderdate, date_trunc('month', o_orderdate) AS batch_month,
         o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS actual,
         nullif(o_orderstatus, 'P') AS known_status,
         round(1 / (1 + exp(-(-1.5e0 + o_totalprice * 0.000006e0))), 6) AS p
  FROM orders
)"""

GAPPY = """
gappy AS (
  SELECT l_orderkey, l_quantity, l_extendedprice, nullif(l_discount, 0e0) AS l_discount, nullif(l_tax, 0e0) AS l_tax,
         nullif(l_returnflag, 'N') AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem
)"""
