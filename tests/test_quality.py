import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.schema import BOOLEAN, CATEGORICAL, NUMERIC, STRING, SUBSCRIBER_FIELDS, Field, spark_schema
from tidewatch.operators import cleaning, quality, validation

NAN = float("nan")


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(1, 1.0, "a"), (2, NAN, None), (3, None, "a"), (4, 4.0, "b"), (4, 4.0, "b")]
    return spark.createDataFrame(rows, "k int, x double, c string")


def by_column(df, *names):
    return {r["column"]: tuple(r[n] for n in names) for r in df.collect()}


def test_nulls_count_nan(gappy):
    assert by_column(quality.null_profile(gappy), "n_missing", "pct_missing") == {
        "k": (0, 0.0), "x": (2, 40.0), "c": (1, 20.0)
    }


def test_empty_table(spark):
    empty = spark.createDataFrame([], "x double, c string")
    assert by_column(quality.null_profile(empty), "n_missing", "pct_missing") == {"x": (0, 0.0), "c": (0, 0.0)}
    assert tuple(quality.duplicate_rows(empty).first()) == (0, 0)
    assert quality.describe_numeric(empty, ["x"]).first()["q50"] is None
    gate = {r.check: r.passed for r in quality.model_input_gate(empty, ["x"]).collect()}
    assert gate == {"empty_table": False, "missing_values": True, "extra_column": True}


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert tuple(quality.duplicate_rows(df).first()) == (3, 1)


def test_distinct_and_top(gappy):
    assert by_column(quality.distinct_counts(gappy, ["k", "c"]), "n_distinct") == {"k": (4,), "c": (2,)}
    top = quality.top_values(gappy, ["c"], 1).collect()
    assert [(r.value, r.n, r.n_distinct) for r in top] == [("a", 2, 2)]
    plan = quality.top_values(gappy, ["c"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_histogram(spark):
    df = spark.range(0, 31).select(F.col("id").cast("double").alias("x"), F.lit(5.0).alias("same"))
    rows = quality.histogram(df, ["x", "same"], 10).collect()
    x = sorted((r.bin, r.n) for r in rows if r.column == "x")
    assert len(x) == 10 and sum(n for _, n in x) == 31 and x[-1][1] == 4
    same = [r for r in rows if r.column == "same" and r.n]
    assert len(same) == 1 and same[0].bin == 5
    assert abs(sum(r.density * 3.0 for r in rows if r.column == "x") - 1) < 1e-9


def test_kernel_density_integrates_to_one(spark):
    df = spark.range(0, 200).select((F.col("id") % 17).cast("double").alias("x"))
    rows = quality.kernel_density(df, "x").orderBy("point").collect()
    step = rows[1].x - rows[0].x
    assert len(rows) == 1000 and abs(sum(r.density for r in rows) * step - 1) < 0.01


@pytest.mark.parametrize("power", [1, 4])
def test_kernel_density_equals_the_direct_sum(spark, power):
    df = spark.range(0, 5000).select(F.pow(F.pmod(F.xxhash64("id"), F.lit(9973)) / 100.0, F.lit(power)).alias("x"))
    values = np.array([r.x for r in df.collect()])
    h = values.std(ddof=1) * len(values) ** -0.2
    rows = quality.kernel_density(df, "x", 200).orderBy("point").collect()
    z = (np.array([r.x for r in rows])[:, None] - values[None, :]) / h
    want = np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.density for r in rows], want, rtol=0, atol=1e-10 * want.max())
    plan = quality.kernel_density(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_kernel_density_without_spread(spark):
    empty = spark.createDataFrame([(None,), (NAN,)], "x double")
    assert quality.kernel_density(empty, "x").count() == 0
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r.density for r in quality.kernel_density(same, "x", 10).collect()} == {None}


def test_narrowest_types(spark):
    df = spark.createDataFrame([(1, 300, 2**40, "a"), (100, -5, 1, "a"), (7, 7, 7, "a")], "a bigint, b bigint, c bigint, s string")
    assert by_column(quality.narrowest_types(df), "to_type") == {
        "a": ("tinyint",), "b": ("smallint",), "c": ("bigint",), "s": ("dictionary",)
    }


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, NAN), (4.0, 8.0)], "a double, b double")
    rows = {(r["row"], r["column"]): r.correlation for r in quality.correlation(df, ["a", "b"]).collect()}
    assert rows[("a", "b")] == pytest.approx(1.0) and rows[("a", "b")] == rows[("b", "a")]


def test_gram_correlation_of_many_columns(spark):
    def cell(i):
        value = F.pmod(F.xxhash64("id", F.lit(i % 40)), F.lit(1000)) + 1e6 * (i % 3) + (F.col("id") % (i + 2))
        return F.when(F.pmod(F.xxhash64("id", F.lit(-i)), F.lit(10)) > 1, value).cast("double").alias(f"c{i}")

    df = spark.range(0, 2000, 1, 4).select(*[cell(i) for i in range(300)])
    names = df.columns
    table = df.toPandas()
    want = table.corr().to_numpy()
    rows = quality.correlation(df, names).collect()
    got = {(r["row"], r["column"]): r.correlation for r in rows}
    assert len(rows) == len(got) == 300 * 300
    assert np.allclose([[got[a, b] for b in names] for a in names], want, rtol=0, atol=1e-9)
    few = names[:12]
    coded = {(r["row"], r["column"]): r.correlation for r in quality.correlation(df, few).collect()}
    assert all(coded[p] == pytest.approx(got[p], abs=1e-9) for p in coded)
    plan = quality.gram_correlation(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 2000") == 1


def test_gram_correlation_edges(spark):
    rows = [(1.0, 5.0, None, 1.0), (2.0, 5.0, None, float("inf")), (4.0, 5.0, 7.0, 2.0), (NAN, 5.0, 8.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, same double, c double, d double")
    got = {(r["row"], r["column"]): r.correlation for r in quality.gram_correlation(df, df.columns).collect()}
    assert got["a", "a"] == 1.0 and got["a", "same"] is None and got["a", "c"] is None
    assert got["d", "a"] != got["d", "a"] and got["c", "d"] == pytest.approx(1.0)
    empty = quality.gram_correlation(df.where("a > 9"), df.columns).collect()
    assert len(empty) == 16 and {r.correlation for r in empty} == {None}


FIELDS = [
    Field("id", STRING, required=False),
    Field("n", NUMERIC, low=0, high=10),
    Field("c", CATEGORICAL, allowed=("x", "y")),
    Field("b", BOOLEAN),
    Field("absent", NUMERIC),
]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("1", "5", "x", "yes", 1), ("", "-2", "z", "TRUE", 2), (None, "11", None, "0", 3)]
    return spark.createDataFrame(rows, "id string, n string, c string, b string, other int")


def test_findings(raw):
    found = {(r.field, r.rule): (r.severity, r.n) for r in validation.validate(raw, FIELDS).collect()}
    assert found == {
        ("absent", "missing_field"): ("error", 1),
        ("other", "extra_field"): ("warning", 1),
        ("id", "null"): ("error", 1),
        ("id", "empty_text"): ("warning", 1),
        ("n", "below_minimum"): ("error", 1),
        ("n", "above_maximum"): ("error", 1),
        ("c", "null"): ("error", 1),
        ("c", "invalid_value"): ("error", 1),
        ("b", "not_boolean"): ("error", 1),
    }
    assert validation.verdict(validation.validate(raw, FIELDS)).first().valid is False


def test_bad_numbers_stop_range_rules(spark):
    df = spark.createDataFrame([("abc",), ("-5",)], "n string")
    found = [r.rule for r in validation.cell_findings(df, [Field("n", NUMERIC, low=0)]).collect()]
    assert found == ["not_numeric"]


def test_record_verdicts_and_split(raw):
    verdicts = {r.other: (r.valid, r.issues) for r in validation.record_verdicts(raw, FIELDS, "other").collect()}
    assert verdicts[1] == (True, [])
    assert verdicts[2][0] is False and "n: below minimum" in verdicts[2][1]
    valid, rejected = validation.split_requests(raw, FIELDS)
    assert (valid.count(), rejected.count()) == (1, 2)


def test_sanitize(raw):
    rows = {r.other: r for r in cleaning.sanitize(raw, FIELDS).collect()}
    assert (rows[2].n, rows[2].c, rows[2].b) == (0.0, None, None)
    assert (rows[3].n, rows[3].c, rows[3].b) == (10.0, None, False)


def test_fills(spark):
    df = spark.createDataFrame([(1.0, "b", None), (None, "a", None), (3.0, None, None)], "x double, c string, e string")
    rows = cleaning.fill_mode(cleaning.fill_median(df, ["x"]), ["c", "e"]).collect()
    assert sorted(r.x for r in rows) == [1.0, 2.0, 3.0]
    assert [r.c for r in rows] == ["b", "a", "a"] and {r.e for r in rows} == {"Unknown"}


def test_clean(spark):
    df = spark.createDataFrame([("1", 1.0, "a"), (" ", None, "a"), ("3", 3.0, None)], "t string, x double, c string")
    rows = cleaning.clean(df, ["t"], ["x"], ["c"]).collect()
    assert sorted((r.t, r.x, r.c) for r in rows) == [(1.0, 1.0, "a"), (2.0, 2.0, "a"), (3.0, 3.0, "a")]


def test_subscriber_schema():
    assert len(SUBSCRIBER_FIELDS) == 20
    assert spark_schema(SUBSCRIBER_FIELDS)["tenure"].dataType.simpleString() == "double"
    assert spark_schema(SUBSCRIBER_FIELDS, as_text=True)["tenure"].dataType.simpleString() == "string"


def test_batch_rules(spark):
    df = spark.createDataFrame([(120.0, -1.0, None), (5.0, 2000.0, 1.0)], "tenure double, MonthlyCharges double, TotalCharges double")
    row = validation.batch_rules(df).first()
    assert not row.valid and row.issues.count(";") == 3 and row.quality_score == pytest.approx(5 / 6)
    fine = validation.batch_rules(spark.createDataFrame([(1.0, 2.0, 3.0)], df.schema)).first()
    assert fine.valid and fine.issues == ""
