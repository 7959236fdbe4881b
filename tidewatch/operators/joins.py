"""Joins that stay sound when the lookup side grows or one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table with unique keys.

    Spark broadcasts the lookup table as long as its size in bytes allows; beyond
    that the adaptive plan splits the rows of hot keys over several tasks.
    """
    return big.join(small, list(keys), "left")
