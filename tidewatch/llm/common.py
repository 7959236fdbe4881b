"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.tables import table

CHUNK_ROWS = 500  # rows a Python step turns into objects at a time


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small: long texts never stand in memory as Python strings all at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
