"""Distribution drift between a reference table and a current one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.columns import divide_or_zero
from tidewatch.functions.probability import chi_square_p_value, ks_p_value
from tidewatch.operators.ordered import Selection, running_totals, unpivot_numeric
from tidewatch.operators.quality import describe_numeric, spread_quantiles, value_counts

P_VALUE_LIMIT = 0.05
PSI_LIMIT = 0.1
EMPTY_SHARE = 0.001
NO_EXPECTATION = 1e-10

BASELINE_PROBS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}

# Baselines used when no reference table is at hand.
DEFAULT_BASELINES = [
    ("tenure", 32.0, 24.0, 0.0, 72.0, 1.0, 9.0, 29.0, 55.0, 70.0),
    ("MonthlyCharges", 64.8, 30.1, 18.3, 118.7, 20.0, 35.0, 70.0, 89.0, 105.0),
    ("TotalCharges", 2283.3, 2266.8, 18.8, 8684.8, 20.0, 400.0, 1400.0, 3800.0, 6000.0),
]
BASELINE_SCHEMA = (
    "column string, mean double, std double, min double, max double, "
    "p10 double, p25 double, p50 double, p75 double, p90 double"
)


def _tagged(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    cur = F.lit(True).alias("is_current")
    ref = F.lit(False).alias("is_current")
    return reference.select(ref, *columns).unionByName(current.select(cur, *columns))


def _shared(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in reference.columns and c in current.columns]


def reference_stats(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``(column, type, stat, value)``: moments and quartiles, or shares and the number of values."""
    numbers = describe_numeric(df, numeric).select(
        "column",
        F.lit("numeric").alias("type"),
        F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in ("mean", "std", "q25", "q50", "q75")])),
    )
    counts = value_counts(df, categorical).where(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").cast("double").alias("unique"))
    shares = counts.join(F.broadcast(totals), "column").select(  # one row per column
        "column",
        F.lit("categorical").alias("type"),
        F.concat(F.lit("share:"), "value").alias("stat"),
        (F.col("n") / F.col("total")).alias("value"),
    )
    unique = totals.select(
        "column", F.lit("categorical").alias("type"), F.lit("unique_count").alias("stat"), F.col("unique").alias("value")
    )
    return numbers.unionByName(shares).unionByName(unique)


def baseline_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample std, min, max and five quantiles per column."""
    chosen = Selection(df, columns, list(BASELINE_PROBS.values()))
    return chosen.moments().drop("count").join(spread_quantiles(chosen.quantiles(), BASELINE_PROBS), "column")


def default_baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_BASELINES, BASELINE_SCHEMA)


def ks_test(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], limit: float = P_VALUE_LIMIT
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test for all columns at once."""
    columns = _shared(reference, current, columns)
    longform = unpivot_numeric(_tagged(reference, current, columns), columns, keep=["is_current"])
    cur, value = F.col("is_current"), F.col("value")
    # Missing values stay in as one row per column. Ranks, means and missing
    # rates all read this one shuffle, so each table is scanned once.
    counts = longform.groupBy("column", "value").agg(
        F.count_if(~cur).alias("rows_ref"), F.count_if(cur).alias("rows_cur")
    ).withColumns(
        {
            "ref": F.when(value.isNotNull(), F.col("rows_ref")).otherwise(F.lit(0)),
            "cur": F.when(value.isNotNull(), F.col("rows_cur")).otherwise(F.lit(0)),
        }
    )
    gap = F.abs(F.col("run_ref") / F.col("all_ref") - F.try_divide(F.col("run_cur"), F.col("all_cur")))
    distance = (
        running_totals(counts.select("column", "value", "ref", "cur"), "value", ["ref", "cur"], by=["column"])
        .where(F.col("all_ref") > 0)
        .groupBy("column")
        .agg(F.max(gap).alias("d"))
    )
    sides = counts.groupBy("column").agg(
        F.sum("ref").alias("n_ref"),
        F.sum("cur").alias("n_cur"),
        F.sum("rows_ref").alias("rows_ref"),
        F.sum("rows_cur").alias("rows_cur"),
        F.try_divide(F.sum(value * F.col("ref")), F.sum("ref").cast("double")).alias("reference_mean"),
        F.try_divide(F.sum(value * F.col("cur")), F.sum("cur").cast("double")).alias("current_mean"),
    )
    spread = (
        # Naming both counts keeps them in these branches, so that they reuse the shuffle.
        counts.where((F.col("rows_ref") > 0) | (F.col("rows_cur") > 0))
        .join(
            F.broadcast(  # one row per column
                sides.where((F.col("n_ref") > 0) | (F.col("n_cur") > 0)).select("column", "reference_mean")
            ),
            "column",
        )
        .groupBy("column")
        .agg(F.sum(F.col("ref") * F.pow(value - F.col("reference_mean"), F.lit(2.0))).alias("squares"))
    )
    sides = sides.join(F.broadcast(spread), "column", "left").withColumn(
        "std_ref", F.when(F.col("n_ref") > 1, F.sqrt(F.col("squares") / (F.col("n_ref") - 1)))
    )
    empty = F.col("n_cur") == 0
    joined = sides.join(distance, "column", "left").withColumns(
        {
            "statistic": F.when(empty, F.lit(1.0)).otherwise(F.col("d")),
            "p_value": F.when(empty, F.lit(0.0)).otherwise(ks_p_value(F.col("d"), F.col("n_ref"), F.col("n_cur"))),
        }
    )
    shift = F.abs(F.col("current_mean") - F.col("reference_mean"))
    return joined.select(
        "column",
        "statistic",
        "p_value",
        (F.col("p_value") < limit).alias("drift_detected"),
        F.when(~empty, divide_or_zero(shift, F.nullif(F.col("std_ref"), F.lit(0.0)))).alias("mean_shift"),
        "reference_mean",
        "current_mean",
        (
            (1 - F.try_divide(F.col("n_cur"), F.col("rows_cur"))) - (1 - F.try_divide(F.col("n_ref"), F.col("rows_ref")))
        ).alias("missing_rate_change"),
    )


def category_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, ref, cur)`` over the union of categories; null is a category."""
    columns = _shared(reference, current, columns)
    counts = value_counts(_tagged(reference, current, columns), columns, keep=["is_current"])
    return counts.groupBy("column", "value").agg(
        F.coalesce(F.sum(F.when(~F.col("is_current"), F.col("n"))), F.lit(0)).alias("ref"),
        F.coalesce(F.sum(F.when(F.col("is_current"), F.col("n"))), F.lit(0)).alias("cur"),
    )


def new_categories(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values seen now that the reference does not have, as rows."""
    return (
        category_counts(reference, current, columns)
        .where((F.col("ref") == 0) & (F.col("cur") > 0))
        .select("column", "value", F.col("cur").alias("n"))
    )


def chi_square_test(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], limit: float = P_VALUE_LIMIT
) -> DataFrame:
    """Goodness of fit of the current categories to the reference shares, for all columns at once."""
    counts = category_counts(reference, current, columns)
    totals = counts.groupBy("column").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    shares = counts.join(F.broadcast(totals), "column").withColumns(  # one row per column
        {
            "share_ref": F.try_divide(F.col("ref"), F.col("all_ref")),
            "share_cur": F.try_divide(F.col("cur"), F.col("all_cur")),
        }
    )
    expected = F.when(F.col("ref") == 0, F.lit(NO_EXPECTATION)).otherwise(F.col("share_ref") * F.col("all_cur"))
    result = (
        shares.withColumn("expected", expected)
        .groupBy("column")
        .agg(
            F.sum(F.pow(F.col("cur") - F.col("expected"), F.lit(2.0)) / F.col("expected")).alias("statistic"),
            (F.count("*") - 1).alias("degrees"),
            (0.5 * F.sum(F.abs(F.col("share_ref") - F.col("share_cur")))).alias("tv_distance"),
            F.count_if((F.col("ref") == 0) & (F.col("cur") > 0)).alias("n_new_categories"),
            F.coalesce(
                F.max(F.when(F.col("value").isNull(), F.col("share_cur") - F.col("share_ref"))), F.lit(0.0)
            ).alias("missing_rate_change"),
        )
        .withColumn("p_value", chi_square_p_value(F.col("statistic"), F.col("degrees")))
    )
    return result.withColumn("drift_detected", F.col("p_value") < limit)


def drift_tests(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """``(column, test, statistic, p_value, drift_detected)`` for every shared column."""
    keep = ["column", "statistic", "p_value", "drift_detected"]
    return (
        ks_test(reference, current, numeric)
        .select(*keep, F.lit("KS test").alias("test"))
        .unionByName(chi_square_test(reference, current, categorical).select(*keep, F.lit("Chi-square").alias("test")))
    )


def drift_report(tests: DataFrame) -> DataFrame:
    """Share of drifted columns; ``drifted_columns`` is bounded by the number of columns."""
    return tests.agg(
        F.count("*").alias("columns_analyzed"),
        F.count_if("drift_detected").alias("n_drifted"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("column")))), ", ").alias(
            "drifted_columns"
        ),
    ).select(
        "*",
        (F.col("n_drifted") > 0).alias("drift_detected"),
        divide_or_zero(F.col("n_drifted"), F.col("columns_analyzed")).alias("drift_score"),
    )


def _edge_table(baseline: DataFrame) -> DataFrame:
    """Sorted distinct bin edges per column and the baseline share below each edge."""
    points = [("min", 0.0), *BASELINE_PROBS.items(), ("max", 1.0)]
    pairs = F.array(*[F.struct(F.col(c).alias("edge"), F.lit(p).alias("below")) for c, p in points])
    return baseline.select("column", F.inline(pairs)).groupBy("column", "edge").agg(F.min("below").alias("below")).groupBy(
        "column"
    ).agg(F.array_sort(F.collect_list(F.struct("edge", "below"))).alias("_edges"))


def _population_index(actual: Column, expected: Column) -> Column:
    floor = F.lit(EMPTY_SHARE)
    a = F.when(actual == 0, floor).otherwise(actual)
    e = F.when(expected == 0, floor).otherwise(expected)
    return (a - e) * F.ln(a / e)


def psi(
    current: DataFrame,
    baseline: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    expected: str = "uniform",
) -> DataFrame:
    """Population stability index per column (and group).

    Bins run between the sorted distinct baseline points, left-closed, the last
    one closed; values outside are dropped. ``expected="uniform"`` gives each
    bin the share 1 / number of edges; ``"baseline"`` the true share between
    the baseline quantiles.
    """
    if expected not in ("uniform", "baseline"):
        raise ValueError(f"unknown expected shares {expected!r}")
    by = list(by)
    width = len(BASELINE_PROBS) + 2
    edges = _edge_table(baseline).select(
        "column", "_edges", *[F.get(F.col("_edges.edge"), F.lit(i)).alias(f"_e{i}") for i in range(width)],
        F.size("_edges").alias("_k"),
    )
    edges = F.broadcast(edges)  # one row per column
    value = F.col("value")
    passed = sum(
        (F.coalesce((value >= F.col(f"_e{i}")).cast("int"), F.lit(0)) for i in range(1, width)),
        F.coalesce((value >= F.col("_e0")).cast("int"), F.lit(0)),
    )
    last = F.element_at("_edges.edge", -1)
    binned = (
        unpivot_numeric(current, columns, keep=by)
        .where(value.isNotNull())
        .join(edges, "column")
        .where((value >= F.col("_e0")) & (value <= last))
        .groupBy(*by, "column", F.least(passed - 1, F.col("_k") - 2).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    groups = binned.groupBy(*by, "column").agg(F.sum("n").alias("total"))
    below = F.col("_edges.below")
    upper = F.when(F.col("bin") == F.col("_k") - 2, F.lit(1.0)).otherwise(F.get(below, F.col("bin") + 1))
    share = (
        F.lit(1.0) / F.col("_k") if expected == "uniform" else upper - F.get(below, F.col("bin"))
    )
    grid = (
        groups.join(edges, "column")
        .where(F.col("_k") > 1)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_k") - 2)))
        .withColumn("_share", share)
    )
    return (
        grid.select(*by, "column", "bin", "total", "_share")
        .join(binned, [*by, "column", "bin"], "left")
        .withColumn("_actual", F.coalesce("n", F.lit(0)) / F.col("total"))
        .groupBy(*by, "column")
        .agg(F.abs(F.sum(_population_index(F.col("_actual"), F.col("_share")))).alias("psi"))
    )


def psi_report(scores: DataFrame, by: Sequence[str] = (), limit: float = PSI_LIMIT) -> DataFrame:
    """Drifted features per group from PSI scores; the list is bounded by the number of columns."""
    drifted = F.array_sort(F.collect_list(F.when(F.col("psi") > limit, F.col("column"))))
    return scores.groupBy(*by).agg(drifted.alias("drifted_features"), F.max("psi").alias("max_psi")).withColumn(
        "drift_detected", F.size("drifted_features") > 0
    )
