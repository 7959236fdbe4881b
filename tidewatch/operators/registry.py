"""Model registry as append-only tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION_SCHEMA = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("training_rows", T.LongType()),
        T.StructField("performance", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("hyperparameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("business_impact", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model_path", T.StringType()),
    ]
)
CHAMPION_SCHEMA = "version string, set_at timestamp_ntz"


class ModelRegistry:
    """Versions and champion changes in two tables under one folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str, schema) -> DataFrame:
        """A registry table; empty before its first row."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """The newest registration of each version."""
        latest = self._read("model_versions", VERSION_SCHEMA)
        whole = F.struct(*latest.columns)
        return latest.groupBy("version").agg(F.max_by(whole, F.struct("created", "model_path")).alias("r")).select("r.*")

    def register(self, rows: DataFrame) -> None:
        """Append version rows; columns not given stay null."""
        full = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in VERSION_SCHEMA.fields
        ]
        rows.select(*full).write.mode("append").parquet(f"{self.folder}/model_versions")

    def register_model(self, model, rows: DataFrame, version: str, set_at: str, champion: bool = True) -> str:
        """Save a fitted pipeline next to its metadata row."""
        path = f"{self.folder}/{version}/pipeline"
        model.write().overwrite().save(path)
        self.register(rows.withColumns({"version": F.lit(version), "model_path": F.lit(path)}))
        if champion:
            self.set_champion(version, set_at)
        return path

    def set_champion(self, version: str, set_at: str) -> None:
        if self._read("model_versions", VERSION_SCHEMA).where(F.col("version") == version).isEmpty():
            raise ValueError(f"model version {version} is not registered")
        row = self.spark.createDataFrame([(version, set_at)], "version string, set_at string")
        row.select("version", F.col("set_at").cast("timestamp_ntz").alias("set_at")).write.mode("append").parquet(
            f"{self.folder}/champion_log"
        )

    def _pointer(self) -> DataFrame:
        return self._read("champion_log", CHAMPION_SCHEMA).agg(F.max_by("version", F.struct("set_at", "version")).alias("champion"))

    def flagged(self) -> DataFrame:
        """All versions with ``is_champion``."""
        return (
            self.versions()
            .join(F.broadcast(self._pointer()))  # one row
            .withColumn("is_champion", F.coalesce(F.col("version") == F.col("champion"), F.lit(False)))
            .drop("champion")
        )

    def champion(self) -> DataFrame:
        return self.flagged().where("is_champion").drop("is_champion")

    def champion_path(self) -> str:
        row = self.champion().select("model_path").head()
        if row is None:
            raise ValueError("no champion is set")
        return row["model_path"]

    def compare(self, metric: str = "test_roc_auc") -> DataFrame:
        """Versions by a metric, best first; a version without it counts as 0."""
        return (
            self.flagged()
            .select(
                "version",
                "created",
                "model_type",
                F.coalesce(F.element_at("performance", metric), F.lit(0.0)).alias(metric),
                "is_champion",
            )
            .orderBy(F.col(metric).desc(), "version")
        )


def model_card(versions: DataFrame) -> DataFrame:
    """One row of card facts and a short markdown text per version."""
    perf = lambda m: F.coalesce(F.element_at("performance", m), F.lit(0.0))
    gain = lambda m: F.coalesce(F.element_at("business_impact", m), F.lit(0.0))
    facts = versions.select(
        "version",
        "model_type",
        *[perf(f"test_{m}").alias(m) for m in ("accuracy", "precision", "recall", "roc_auc")],
        *[gain(m).alias(m) for m in ("revenue_saved", "roi_ratio", "customers_saved", "churn_reduction_pct")],
        F.size("features").cast("bigint").alias("n_features"),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Churn model "), "version"),
        F.concat(F.lit("- Type: "), "model_type"),
        F.format_string("- Accuracy: %.3f", F.col("accuracy")),
        F.format_string("- Precision: %.3f", F.col("precision")),
        F.format_string("- Recall: %.3f", F.col("recall")),
        F.format_string("- ROC-AUC: %.3f", F.col("roc_auc")),
        F.concat(F.lit("- Revenue protected: $"), F.format_number("revenue_saved", 0)),
        F.format_string("- ROI: %.1f:1", F.col("roi_ratio")),
        F.format_string("- Customers saved: %.0f", F.col("customers_saved")),
        F.format_string("- Churn reduction: %.1f%%", F.col("churn_reduction_pct")),
        F.format_string("- Features: %d", F.col("n_features")),
    )
    return facts.withColumn("card", text)
