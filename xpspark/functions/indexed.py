"""Lookups by key, position, composite key and range, as joins and filters of DataFrames.

A table that is looked up often can be written bucketed by its key with ``store``; later lookups on the key then join
without a shuffle of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(table: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``table`` whose ``columns`` equal those of a row of ``keys``."""
    return table.join(keys.select(*columns).distinct(), list(columns), "left_semi")


def by_position(array_col: str, position: int):
    """The member of an array column, counted from 1; NULL outside."""
    return F.get(F.col(array_col), F.lit(position - 1))


def by_range(table: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with ``low <= column <= high``; the conditions reach a Parquet scan and skip row groups."""
    if low is not None:
        table = table.where(F.col(column) >= F.lit(low))
    return table.where(F.col(column) <= F.lit(high)) if high is not None else table


def store(table: DataFrame, name: str, buckets: int, *columns: str) -> None:
    """Write a table bucketed and sorted by its lookup columns."""
    table.write.bucketBy(buckets, *columns).sortBy(*columns).mode("overwrite").saveAsTable(name)
