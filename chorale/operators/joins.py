"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
NULL_FAN = 1_000


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than `rows_per_task` rows and the number of tasks (`fan`) each should get.

    Reads only the key column and combines before its shuffle. Fewer keys than rows / `rows_per_task`
    can be that large, which bounds the result; raise `rows_per_task` with the table.
    """
    return (
        df.groupBy(key).agg(F.count("*").alias("__rows"))
        .filter((F.col("__rows") > rows_per_task) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("__rows") / rows_per_task).cast("int").alias("fan"))
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner",
                hot: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join of a large `left` to `right`, with the hot keys of `left` split over several tasks.

    A hot key's left rows get a slot from the hash of `spread_by`; its right rows are copied once per
    slot. All other keys have the one slot 0. `how` is inner or left. Null keys of a left join match
    nothing and are spread too. Both sides look the hot keys up, so `left` (or `hot`) must give the
    same rows whenever it is read, as files do and unseeded random columns do not. `hot` may come from a cheaper frame with the same keys, since it only
    steers balance. Its narrow rows, fewer than rows / `rows_per_task`, are broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = F.broadcast(hot_keys(left, key, rows_per_task) if hot is None else hot)
    slot = F.pmod(F.xxhash64(spread_by), F.coalesce("fan", F.when(F.col(key).isNull(), NULL_FAN).otherwise(1)))
    slotted_left = left.join(hot, key, "left").withColumn("__slot", slot.cast("int")).drop("fan")
    slots = F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)
    slotted_right = right.join(hot, key, "left").withColumn("__slot", F.explode(slots)).drop("fan")
    return slotted_left.join(slotted_right, [key, "__slot"], how).drop("__slot")
