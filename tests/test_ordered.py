import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.operators.ordered import Selection, number_rows, quantiles, running_totals


@pytest.mark.parametrize("slots", [1, 2, 16, 300])
def test_running_totals(spark, slots):
    rng = np.random.default_rng(slots)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500, p=[0.95, 0.05]), "v": rng.exponential(size=500)})
    pdf["n"], pdf["m"] = rng.integers(0, 9, 500), 1
    got = running_totals(spark.createDataFrame(pdf), "v", ["n", "m"], by=["g"], slots=slots).toPandas()
    got = got.sort_values(["g", "v"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "v"]).reset_index(drop=True)
    assert (got["run_n"] == want.groupby("g")["n"].cumsum()).all()
    assert (got["run_m"] == want.groupby("g").cumcount() + 1).all()
    assert (got["all_n"] == want.groupby("g")["n"].transform("sum")).all()


def test_number_rows(spark):
    ids = spark.range(0, 3000, 3)
    got = number_rows(ids, "id").toPandas()
    assert (got["row_number"] == got["id"] // 3 + 1).all()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.5, -2.0, 7.25, 1e6]) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.prob: r.value for r in quantiles(df, ["v"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9)


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    rows = quantiles(df, ["a", "b"], [0.5]).collect()
    assert [(r.column, r.value) for r in rows] == [("a", 2.0)]
    assert quantiles(df, ["a"], [0.5], approx=True).first().value in (1.0, 3.0)


def test_any_number_of_groups(spark):
    df = spark.range(3300).select((F.col("id") % 1100).alias("g"), F.col("id").cast("double").alias("v"), F.lit(2).alias("n"))
    rows = running_totals(df, "v", ["n"], by=["g"]).collect()
    assert len(rows) == 3300
    assert all(r.all_n == 6 and r.run_n == 2 * (int(r.v) // 1100 + 1) for r in rows)


@pytest.mark.parametrize("small", [100, 100_000])
def test_only_values_near_the_quantiles_are_counted(spark, monkeypatch, small):
    monkeypatch.setattr("tidewatch.operators.ordered.SMALL_BRACKET", small)
    rows = 200_000
    df = spark.range(0, rows, 1, 6).select((F.hash("id") * 1.0).alias("v"), F.when(F.col("id") % 3 > 0, 7.0).alias("hot"))
    chosen = Selection(df, ["v", "hot"], [0.25, 0.5, 0.75])
    assert 0 < chosen.counted.count() < 0.02 * rows
    values = df.toPandas()
    got = {(r.column, r.prob): r.value for r in chosen.quantiles().collect()}
    for p in (0.25, 0.5, 0.75):
        assert got["v", p] == np.quantile(values["v"], p) and got["hot", p] == 7.0
    m = {r.column: r for r in chosen.moments().collect()}
    assert m["hot"]["count"] == values["hot"].count() and m["v"]["std"] == pytest.approx(values["v"].std())


@pytest.mark.parametrize("bracket", [(10.0, 12.0), (900.0, 901.0), (499.2, 499.4), (-5.0, -4.0), (2000.0, 2001.0)])
def test_a_bracket_that_misses_is_widened(spark, monkeypatch, bracket):
    df = spark.range(0, 1000, 1, 3).select(F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(Selection, "_first_brackets", lambda self, stats: [bracket])
    got = {r.prob: r.value for r in Selection(df, ["v"], [0.1, 0.5, 0.99]).quantiles().collect()}
    assert got == pytest.approx({p: np.quantile(np.arange(1000), p) for p in (0.1, 0.5, 0.99)})


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(1.0, None, float("inf"), 5), (2.0, None, 1.0, 5), (float("nan"), None, -float("inf"), 5)],
        "`a.b` double, n double, i double, k int",
    )
    got = {(r.column, r.prob): r.value for r in quantiles(df, ["`a.b`", "n", "i", "k"], [0.5, 0.5, 1.0]).collect()}
    assert got == {("`a.b`", 0.5): 1.5, ("`a.b`", 1.0): 2.0, ("i", 0.5): 1.0, ("i", 1.0): float("inf"), ("k", 0.5): 5.0, ("k", 1.0): 5.0}
    assert quantiles(df.limit(0), ["n"], [0.5]).count() == 0
