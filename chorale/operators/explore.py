"""Small questions asked of a stage's output."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def share_at_least(df: DataFrame, column: str, cutoff: float) -> DataFrame:
    """Rows, rows at or above the cutoff, and their share; nulls stay in the denominator. No rows, no share."""
    hits = F.count_if(F.col(column) >= cutoff)
    return df.agg(F.count("*").alias("n_rows"), hits.alias("n_relevant"), F.try_divide(hits, F.count("*")).alias("share"))


def lookup(df: DataFrame, **keys: str) -> DataFrame:
    """Rows equal on every given column; the test reaches the scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df


def first_value(df: DataFrame, column: str) -> Any:
    row = df.select(column).first()
    return None if row is None else row[0]


def head(df: DataFrame, order: list[str | Column], n: int = 5) -> DataFrame:
    """First n rows of a stated order; without one, a distributed table has no first rows."""
    return df.orderBy(*order).limit(n)
