"""CSV, JSON and Parquet files, and records held as JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import scratch_path

__all__ = [
    "from_records", "load_processed", "read_csv", "read_json", "save_processed", "scratch_path", "template_rows",
    "to_record", "write_csv", "write_json",
]

CORRUPT = "_corrupt"

# The sample rows offered as an upload template.
TEMPLATE_ROWS = [(1, 12.0, 50.0, 600.0), (2, 24.0, 65.0, 1560.0), (3, 36.0, 80.0, 2880.0), (4, 48.0, 45.0, 2160.0), (5, 6.0, 95.0, 570.0)]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. With a schema no inference pass runs, and bad lines keep their text in ``_corrupt``.

    A missing path fails at once with PATH_NOT_FOUND.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (
        reader.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def save_processed(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_record(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_records(df: DataFrame, body: str, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record; a body may hold one object or an array of objects."""
    parsed = F.from_json(F.col(body), f"array<struct<{_fields(schema)}>>")
    return df.select(*keep, F.inline(parsed))


def _fields(schema: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) for part in schema.split(","))


def template_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATE_ROWS, "template int, tenure double, MonthlyCharges double, TotalCharges double")
