"""Structured Streaming jobs. Each takes a streaming DataFrame, so any source fits.

State is bounded by watermarks; sinks are files with a checkpoint, and ``foreachBatch``
writers are idempotent per batch id. A job keeps its results and its checkpoint
under ``folder``: started again with the same folder it goes on where it stopped
and neither loses nor repeats rows. Without one it works in a fresh folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import columns as C
from tidewatch.functions.schema import Field
from tidewatch.operators import drift, modeling, monitoring
from tidewatch.operators.registry import ModelRegistry
from tidewatch.operators.scoring import add_bands
from tidewatch.operators.validation import split_requests
from tidewatch.session import materialize, scratch_path, use_utc


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of the data folder as a file stream.

    The pattern matches a table kept as one file as well as a folder of files.
    """
    use_utc(spark)
    path = f"{folder}/{name}.parquet*"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Watermarks need a timestamp with time zone; Parquet columns often lack one."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def run_to_files(stream: DataFrame, spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Process everything available, append to files, and read them back."""
    folder = folder or scratch_path(spark, "stream")
    out = f"{folder}/rows"
    job = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    job = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], p: str, monthly: str) -> DataFrame:
    """Probability, band, confidence and business record for each arriving row."""
    return add_bands(scorer(stream), p).withColumns(
        {
            "confidence_score": C.confidence_score(p),
            "business_impact": C.business_record("risk_level", monthly),
        }
    )


def route_valid_rejected(
    stream: DataFrame, spark: SparkSession, fields: Sequence[Field], folder: str | None = None
) -> tuple[str, str]:
    """Write valid and rejected records to two folders; returns their paths."""
    folder = folder or scratch_path(spark, "routed")
    valid_path, rejected_path = f"{folder}/valid", f"{folder}/rejected"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        valid, rejected = split_requests(batch, fields)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    run_batches(stream, folder, write)
    return valid_path, rejected_path


def score_with_champion(
    stream: DataFrame,
    spark: SparkSession,
    registry: ModelRegistry,
    fields: Sequence[Field],
    monthly: str,
    folder: str | None = None,
) -> tuple[str, str]:
    """Check requests as they arrive and score the valid ones with the champion of the moment.

    The registry is asked at the start of every micro-batch, so a new champion takes over with the next
    batch and without a restart; each row says which version scored it. Requests that
    break a limit, or lack a number, go to the second folder with their reasons; text numbers are parsed.
    Returns the folders of scored and of rejected rows.
    """
    folder = folder or scratch_path(spark, "served")
    scored_path, rejected_path = f"{folder}/scored", f"{folder}/rejected"
    loaded: dict[str, PipelineModel] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        champion = registry.champion().select("version", "model_path").head()
        if champion is None:
            raise ValueError("no champion is set")
        if champion.model_path not in loaded:
            loaded.clear()  # one version in memory at a time
            loaded[champion.model_path] = PipelineModel.load(champion.model_path)
        batch.persist()
        valid, rejected = split_requests(batch, fields)
        model = loaded[champion.model_path]
        scored = score_stream(valid, lambda rows: modeling.score(model, rows, fields), "churn_probability", monthly)
        scored = scored.withColumn("model_version", F.lit(champion.version))
        scored.write.mode("overwrite").parquet(f"{scored_path}/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    run_batches(stream, folder, write)
    return scored_path, rejected_path


def _window_aggregates(p: str) -> list:
    prob = F.col(p)
    return [
        F.count("*").alias("batch_size"),
        F.avg(C.hard_label(p)).alias("positive_rate"),
        F.avg(prob).alias("mean_probability"),
        F.stddev_pop(prob).alias("std_probability"),
        F.min(prob).alias("min_probability"),
        F.max(prob).alias("max_probability"),
        F.avg((prob > 0.8).cast("int")).alias("high_confidence_rate"),
        F.avg((prob < 0.2).cast("int")).alias("low_confidence_rate"),
    ]


def windowed_stats(
    stream: DataFrame, p: str, by: Sequence[str], ts: str = "ts", length: str = "1 hour", slide: str | None = None
) -> DataFrame:
    """Prediction statistics per event-time window; sliding when ``slide`` is given."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (
        stream.groupBy(window.alias("w"), *by)
        .agg(*_window_aggregates(p))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *by,
            "batch_size",
            "positive_rate",
            "mean_probability",
            "std_probability",
            "min_probability",
            "max_probability",
            "high_confidence_rate",
            "low_confidence_rate",
        )
    )


def sessions(stream: DataFrame, user: str, value: str, ts: str = "ts", gap: str = "6 hours") -> DataFrame:
    """Activity per user session.

    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` lets a task
    merge the sessions of its rows before the shuffle; set it on the session for hot users.
    """
    return (
        stream.groupBy(user, F.session_window(ts, gap).alias("s"))
        .agg(F.count("*").alias("n_events"), F.sum(value).alias("total_value"))
        .select(
            user,
            F.col("s.start").alias("session_start"),
            F.col("s.end").alias("session_end"),
            "n_events",
            "total_value",
        )
    )


def monitor_stream(
    stream: DataFrame,
    spark: SparkSession,
    baseline: DataFrame,
    features: Sequence[str],
    by: Sequence[str],
    p: str,
    ts: str,
    actual: str | None = None,
    folder: str | None = None,
) -> tuple[str, str]:
    """Drift, band rates, performance and alerts of each micro-batch; returns the metric and alert folders.

    ``baseline`` is a small static table (one row per feature), computed once. With the
    outcome ``actual`` in the rows each batch also gets its accuracy, compared with the
    mean of the last ten batches before it that the metric folder holds.
    """
    folder = folder or scratch_path(spark, "monitor")
    metrics_path, alerts_path = f"{folder}/metrics", f"{folder}/alerts"
    baseline = materialize(baseline)
    keys = list(by)

    def accuracies(batch: DataFrame, batch_id: int) -> DataFrame:
        if actual is None:
            return batch.select(*keys).distinct().withColumns(
                {"accuracy": F.lit(None).cast("double"), "recent_accuracy": F.lit(None).cast("double")}
            )
        right = (C.hard_label(p) == F.col(actual)).cast("double")
        now = batch.groupBy(*keys).agg(F.avg(right).alias("accuracy"))
        if batch_id == 0:
            return now.withColumn("recent_accuracy", F.lit(None).cast("double"))
        # Earlier batches alone, so a batch that is written again sees the same history.
        earlier = spark.read.schema(metric_schema).parquet(f"{metrics_path}/*").where(F.col("batch_id") < batch_id)
        last = monitoring.newest_per_group(
            earlier.where("accuracy is not null"), keys, "batch_id", monitoring.HISTORY_BATCHES
        )
        return now.join(last.groupBy(*keys).agg(F.avg("accuracy").alias("recent_accuracy")), keys, "left")

    kinds = {c: stream.schema[c].dataType.simpleString() for c in keys}
    metric_schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], "batch_id int, accuracy double"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        scores = drift.psi(batch, baseline, features, by=by)
        found = drift.psi_report(scores, by=by)
        rates = batch.groupBy(*by).agg(*monitoring.band_rates(F.col(p)), F.max(ts).alias("timestamp"))
        fallen = F.coalesce(F.col("accuracy") < F.col("recent_accuracy") - monitoring.ACCURACY_DROP, F.lit(False))
        metrics = (
            rates.join(found, keys, "left")
            .join(accuracies(batch, batch_id), keys, "left")
            .withColumns(
                {
                    "drifted_features": F.coalesce("drifted_features", F.array().cast("array<string>")),
                    "degraded": fallen,
                    "degradation_amount": F.when(fallen, F.col("recent_accuracy") - F.col("accuracy")).otherwise(F.lit(0.0)),
                    "batch_id": F.lit(batch_id).cast("int"),
                }
            )
        )
        metrics.write.mode("overwrite").parquet(f"{metrics_path}/batch={batch_id}")
        stored = spark.read.parquet(f"{metrics_path}/batch={batch_id}")
        monitoring.alerts(stored, ["batch_id", *by], "timestamp").write.mode("overwrite").parquet(
            f"{alerts_path}/batch={batch_id}"
        )
        batch.unpersist()

    run_batches(stream, folder, write)
    return metrics_path, alerts_path


def join_late_outcomes(
    predictions: DataFrame, outcomes: DataFrame, key: str, within: str, predicted_at: str, known_at: str
) -> DataFrame:
    """Predictions with the outcome that arrives within a time bound.

    Both sides carry watermarks, so Spark drops state that can no longer match.
    """
    return predictions.join(
        outcomes.withColumnRenamed(key, "_key"),
        (F.col(key) == F.col("_key"))
        & (F.col(known_at) >= F.col(predicted_at))
        & (F.col(known_at) <= F.col(predicted_at) + F.expr(f"INTERVAL {within}")),
    ).drop("_key")


DEGRADED_SCHEMA = "{by} string, {order} timestamp, accuracy double, recent_accuracy double, degraded boolean"
MICROSECOND = pd.Timedelta(microseconds=1)
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Degradation(StatefulProcessor):
    """Compares the accuracies of one model with the ten before them, in order of event time.

    Two lists are kept: what waits for the watermark, and the newest accuracies that have passed it. A
    timer for each event time wakes the model once the watermark has passed it.
    """

    def __init__(self, by: str, order: str, drop: float) -> None:
        self.by, self.order, self.drop = by, order, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time bigint, accuracy double")
        self.recent = handle.getListState("recent", "accuracy double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            times = ((part[self.order] - pd.Timestamp(0)) // MICROSECOND).tolist()
            self.waiting.appendList(list(zip(times, part["accuracy"].astype(float).tolist())))
            for time in set(times):
                self.handle.registerTimer(time // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        queue = sorted(tuple(r) for r in self.waiting.get())
        ready = [x for x in queue if x[0] < passed]
        if not ready:
            return  # an earlier timer of the same watermark has done it
        recent, out = [r[0] for r in self.recent.get()], []
        for time, accuracy in ready:
            mean = sum(recent) / len(recent) if recent else None
            out.append((key[0], time, accuracy, mean, mean is not None and accuracy < mean - self.drop))
            recent = (recent + [accuracy])[-monitoring.HISTORY_BATCHES :]
        self.recent.put([(a,) for a in recent])
        self.waiting.clear()
        if len(ready) < len(queue):
            self.waiting.put(queue[len(ready) :])
        found = pd.DataFrame(out, columns=[self.by, self.order, "accuracy", "recent_accuracy", "degraded"])
        found[self.order] = pd.to_datetime(found[self.order].astype("int64"), unit="us")
        found["recent_accuracy"] = found["recent_accuracy"].astype("float64")
        yield found

    def close(self) -> None:
        pass


def degradation_stream(stream: DataFrame, by: str, order: str, drop: float = monitoring.ACCURACY_DROP) -> DataFrame:
    """Compare each batch of a model with its last ten accuracies, in order of event time.

    The stream needs a watermark on ``order`` (see ``event_time``). An accuracy waits in state
    until the watermark has passed it, so batches that arrive late within the allowed
    time are compared with the ten before them and not with newer ones. State lives in RocksDB
    and holds ten accuracies and what waits; ``run_closed`` lets the newest ones out of a bounded source.
    """
    stream.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)  # the only store with lists and timers
    return stream.select(by, order, "accuracy").groupBy(by).transformWithStateInPandas(
        Degradation(by, order, drop), DEGRADED_SCHEMA.format(by=by, order=order), "append", "eventTime"
    )


def run_closed(
    path: str, order: str, build: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str | None = None
) -> DataFrame:
    """Run over a folder of files that will not grow any more, and let out what waits for the watermark.

    The source is read to its end first. Then a row without a key, later than all others, comes through a
    second folder, and the job goes on from its checkpoint: the watermark passes every real row,
    the added one itself stays in state.
    """
    folder = folder or scratch_path(spark, "closed")
    ends = f"{folder}/end"
    known = spark.read.parquet(path)
    known.limit(0).write.mode("overwrite").parquet(ends)

    def job() -> DataFrame:
        files = spark.readStream.schema(known.schema)
        # Joined before the watermark is set, so that one watermark covers both.
        return run_to_files(build(files.parquet(path).unionByName(files.parquet(ends))), spark, folder)

    job()
    last = known.agg(F.max(order).alias(order)).where(F.col(order).isNotNull())
    last.select(
        *[
            (F.col(order) + F.expr("INTERVAL 400 DAYS") if f.name == order else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in known.schema.fields
        ]
    ).write.mode("overwrite").parquet(ends)
    return job()
