"""Top-k and one-row-per-key, shaped so that no single task sees a whole hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 64


def top_k(df: DataFrame, k: int, order: Sequence[Column], by: Sequence[str] = (), spread_by: str | None = None,
          rank: str = "rank", buckets: int = SPREAD) -> DataFrame:
    """First `k` rows per group in a total `order`, with their 1-based rank.

    Both row_number filters plan as WindowGroupLimit: every map task keeps at most k rows per group
    before the shuffle. With `spread_by` the survivors of a group are first cut down in `buckets`
    tasks, so the last step gets at most `buckets * k` rows per group however large the group is.
    Without `by` there is one group, and `spread_by` is what keeps it off a single task.
    """
    if spread_by is not None:
        bucket = Window.partitionBy(*by, "__bucket").orderBy(*order)
        df = (
            df.withColumn("__bucket", F.pmod(F.xxhash64(spread_by), F.lit(buckets)))
            .withColumn("__n", F.row_number().over(bucket))
            .filter(F.col("__n") <= k)
            .drop("__n", "__bucket")
        )
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(group)).filter(F.col(rank) <= k)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`; a named survivor, unlike dropDuplicates.

    A key with very many copies is cut to one row per map task before the shuffle.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") == 1).drop("__n")
