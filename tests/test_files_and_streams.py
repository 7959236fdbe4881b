import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from tidewatch.functions.schema import NUMERIC, Field
from tidewatch.operators import drift, modeling, monitoring
from tidewatch.operators.registry import ModelRegistry
from tidewatch.operators.scoring import score_linear
from tidewatch.session import materialize, scratch_path, shared_folder
from tidewatch.sources import files, prediction_log
from tidewatch.streaming import jobs


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,x\noops,y\n3,"quoted, comma"\n')
    schema = spark.createDataFrame([], "a int, b string").schema
    rows = files.read_csv(spark, str(tmp_path / "in.csv"), schema).collect()
    assert [(r.a, r.b, r._corrupt) for r in rows] == [(1, "x", None), (None, "y", "oops,y"), (3, "quoted, comma", None)]
    assert files.read_csv(spark, str(tmp_path / "in.csv")).count() == 3
    with pytest.raises(AnalysisException):
        files.read_csv(spark, str(tmp_path / "none.csv"), schema)


def test_records(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2.5}',), ('[{"a": 2}, {"a": 3}]',)], "body string")
    assert [(r.a, r.b) for r in files.from_records(df, "body", "a int, b double").collect()] == [(1, 2.5), (2, None), (3, None)]


def test_pretty_printed_log(spark, tmp_path):
    entry = {"timestamp": "2026-02-09T16:53:41.038444", "model_version": None, "batch_size": 1, "prediction_stats": {"positive_rate": 0.0}}
    (tmp_path / "log.json").write_text(json.dumps([entry, entry], indent=2))
    log = prediction_log.read(spark, str(tmp_path / "log.json"), multi_line=True)
    assert log.count() == 2 and log.first().timestamp == dt.datetime(2026, 2, 9, 16, 53, 41, 38444)


def test_shared_folder_is_kept(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert materialize(spark.range(3)).count() == 3


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """Accuracy rows in three files, to be read as three micro-batches."""
    path = str(tmp_path_factory.mktemp("history"))
    rows = [(m, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 0.9 if i % 9 else 0.7) for m in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "model string, day timestamp_ntz, accuracy double")
    for lo in (0, 10, 20):
        part = df.where(F.dayofyear("day").between(lo + 1, lo + 10))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, df


def plain_history(rows):
    return sorted((r.model, str(r.day)[:10], r.degraded, round(r.recent_accuracy or -1, 9)) for r in rows.collect())


def test_degradation_state_spans_batches(spark, history):
    path, df = history
    stream = jobs.event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), "day", "0 seconds")
    got = jobs.run_to_files(jobs.degradation_stream(stream, "model", "day"), spark)
    want = monitoring.degradation(df, ["model"], "day").where(F.dayofyear("day") < 30)
    assert plain_history(got) == plain_history(want)


def test_a_closed_source_lets_its_newest_rows_out(spark, history, tmp_path):
    path, df = history
    compare = lambda s: jobs.degradation_stream(jobs.event_time(s, "day", "3 days"), "model", "day")
    got = jobs.run_closed(path, "day", compare, spark, str(tmp_path / "closed"))
    assert plain_history(got) == plain_history(monitoring.degradation(df, ["model"], "day"))


def test_late_batches_are_compared_in_order(spark, history, tmp_path):
    _, df = history
    path, folder = str(tmp_path / "late"), str(tmp_path / "job")
    for lo in (0, 20, 10):  # the middle ten days come last
        df.where(F.dayofyear("day").between(lo + 1, lo + 10)).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.event_time(spark.readStream.schema(df.schema).parquet(path), "day", "25 days")
        got = jobs.run_to_files(jobs.degradation_stream(stream, "model", "day"), spark, folder)
    want = monitoring.degradation(df, ["model"], "day").where(F.dayofyear("day") < 5)
    assert plain_history(got) == plain_history(want)
    df.withColumn("day", F.expr("day + interval 60 days")).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.event_time(spark.readStream.schema(df.schema).parquet(path), "day", "25 days")
    got = jobs.run_to_files(jobs.degradation_stream(stream, "model", "day"), spark, folder)
    want = monitoring.degradation(df, ["model"], "day")
    assert plain_history(got.where(F.dayofyear("day") <= 30)) == plain_history(want)


def test_routing_over_batches(spark, history):
    path, df = history
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    valid, rejected = jobs.route_valid_rejected(stream, spark, [Field("accuracy", NUMERIC, low=0.8)])
    assert spark.read.parquet(valid).count() == df.where("accuracy >= 0.8").count()
    back = spark.read.parquet(rejected)
    assert back.count() == df.where("accuracy < 0.8").count()
    assert back.first().reasons == ["accuracy: below minimum"]
    assert back.select("batch").distinct().count() == 3


def test_windows_drop_only_what_is_open(spark, history):
    path, df = history
    stream = jobs.event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), "day")
    stats = jobs.run_to_files(jobs.windowed_stats(stream, "accuracy", ["model"], "day", "1 day"), spark)
    # The watermark ends one hour before the 30th day starts, so days 29 and 30 are still open.
    assert stats.count() == 2 * 28
    assert stats.agg(F.sum("batch_size")).first()[0] == 56


def test_scored_stream(spark, history):
    path, df = history
    stream = spark.readStream.schema(df.schema).parquet(path)
    scored = jobs.score_stream(stream, lambda rows: score_linear(rows, 0.0, {"accuracy": 1.0}, "p"), "p", "accuracy")
    rows = jobs.run_to_files(scored, spark)
    assert rows.count() == 60 and rows.select("business_impact.retention_priority").distinct().count() >= 1


def test_restarted_jobs_go_on_where_they_stopped(spark, history, tmp_path):
    path, df = history
    grown = str(tmp_path / "grown")

    def arrive(lo):
        df.where(F.dayofyear("day").between(lo + 1, lo + 10)).coalesce(1).write.mode("append").parquet(grown)

    folder = str(tmp_path / "job")
    counts = []
    for lo in (0, 10, 20):
        arrive(lo)
        stream = spark.readStream.schema(df.schema).parquet(grown)
        counts.append(jobs.run_to_files(stream, spark, folder).count())
        valid, rejected = jobs.route_valid_rejected(stream, spark, [Field("accuracy", NUMERIC, low=0.8)], f"{folder}-routed")
    assert counts == [20, 40, 60]
    assert spark.read.parquet(valid).count() + spark.read.parquet(rejected).count() == 60
    assert spark.read.parquet(valid).select("batch").distinct().count() == 3


def test_monitored_batches_are_compared_with_earlier_ones(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "job")
    baseline = drift.baseline_stats(spark.range(100).select(F.col("id").cast("double").alias("x")), ["x"])
    for batch in range(4):
        right = 18 if batch < 3 else 10  # of 20
        rows = [("m", float(i), 0.9, int(i < right), dt.datetime(2026, 1, 1 + batch)) for i in range(20)]
        spark.createDataFrame(rows, "model string, x double, p double, y int, ts timestamp_ntz").coalesce(1).write.mode(
            "append"
        ).parquet(path)
        stream = spark.readStream.schema("model string, x double, p double, y int, ts timestamp_ntz").parquet(path)
        metrics, alerts = jobs.monitor_stream(stream, spark, baseline, ["x"], ["model"], "p", "ts", "y", folder)
    got = {r.batch_id: r for r in spark.read.parquet(f"{metrics}/*").collect()}
    assert [got[i].degraded for i in range(4)] == [False, False, False, True]
    assert abs(got[3].degradation_amount - 0.4) < 1e-9
    kinds = {(r.batch_id, r.type) for r in spark.read.parquet(f"{alerts}/*").collect()}
    assert (3, "PERFORMANCE_DEGRADATION") in kinds and (2, "PERFORMANCE_DEGRADATION") not in kinds


def test_a_new_champion_takes_over_between_batches(spark, tmp_path):
    fields = [Field("x", NUMERIC, low=0, high=10)]
    store = ModelRegistry(spark, str(tmp_path / "registry"))
    row = spark.range(1).select(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created"))

    def model(cut):
        rows = spark.range(40).select((F.col("id") / 4).alias("x"), (F.col("id") / 4 > cut).cast("int").alias("label"))
        pre = modeling.fit_preprocessor(rows, ["x"], [])
        return modeling.assemble(pre, modeling.logistic(40).fit(pre.transform(rows)))

    source, folder = str(tmp_path / "source"), str(tmp_path / "job")
    requests = spark.createDataFrame([(1, "1"), (2, "9"), (3, "11"), (4, None), (5, "many")], "id int, x string")

    def serve():
        requests.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(requests.schema).parquet(source)
        return jobs.score_with_champion(stream, spark, store, fields, "x", folder)

    with pytest.raises(StreamingQueryException, match="no champion"):
        serve()
    store.register_model(model(5), row, "v1", "2024-01-01 00:00:00")
    stream = spark.readStream.schema(requests.schema).parquet(source)
    jobs.score_with_champion(stream, spark, store, fields, "x", folder)
    store.register_model(model(8), row, "v2", "2024-01-02 00:00:00")
    scored, rejected = serve()
    got = {(r.model_version, r.id): r.prediction for r in spark.read.parquet(scored).collect()}
    assert got == {("v1", 1): 0, ("v1", 2): 1, ("v2", 1): 0, ("v2", 2): 1}
    ps = {(r.model_version, r.id): r.churn_probability for r in spark.read.parquet(scored).collect()}
    assert ps["v1", 2] != ps["v2", 2]
    reasons = {r.id: r.reasons for r in spark.read.parquet(rejected).where("batch = 1").collect()}
    assert reasons == {3: ["x: above maximum"], 4: ["x: null"], 5: ["x: not numeric"]}
