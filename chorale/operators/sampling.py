"""Exact, seeded, partition-independent samples and disjoint label splits.

The order is the md5 of id and seed: the same rows come out whatever the file layout, engine or
number of tasks. Rows are picked on ids and their counts alone; wide rows are fetched by the at most n picked ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Picked ids up to this many are broadcast; a larger sample is joined as Spark sees fit.
BROADCAST_ROWS = 100_000
ID = "comment_id"


def sample_key(seed: int, key: str = ID) -> Column:
    return F.md5(F.concat_ws(":", F.col(key), F.lit(str(seed))))


def id_frame(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    """A local relation of distinct ids: Spark knows its size and broadcasts it only if small."""
    return spark.createDataFrame(pa.table({ID: pa.array(list(dict.fromkeys(ids)), pa.string())}))


def with_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows whose id is listed; every copy is kept."""
    return df.join(id_frame(df.sparkSession, ids), ID, "left_semi")


def missing_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Listed ids that the table does not hold. The table is only filtered; found ids are few."""
    found = with_ids(df.select(ID), ids).distinct()
    return id_frame(df.sparkSession, ids).join(found, ID, "left_anti")


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in `ids`. Rows without an id go as well, which an anti-join alone would keep."""
    return df.filter(F.col(ID).isNotNull()).join(ids.select(ID), ID, "left_anti")


def _ranked(ids: DataFrame, n: int) -> DataFrame:
    """Of the first n rows in the order of keys: their ids, `__before` (rows in front of an id's first) and `__take`.

    `ids` has one row an id with its key and its number of rows. Rows are counted by the first four hex digits of the
    key. Only digit groups up to the one in which the n-th row falls are ranked, each on its own, behind the number of
    rows in the groups before it. An id with very many rows is one row here.
    """
    heads = ids.groupBy(F.substring("__key", 1, 4).alias("__head")).agg(F.sum("__rows").alias("c"))  # at most 65,536 rows
    before = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("__head")) - F.col("c")
    heads = heads.select("__head", before.alias("__earlier")).filter(F.col("__earlier") < n)
    own = Window.partitionBy("__head").orderBy("__key", ID)
    kept = ids.withColumn("__head", F.substring("__key", 1, 4)).join(F.broadcast(heads), "__head")
    before = F.col("__earlier") + F.sum("__rows").over(own) - F.col("__rows")
    return (kept.select(ID, "__rows", before.alias("__before")).filter(F.col("__before") < n)
            .select(ID, "__before", F.least(F.col("__rows"), n - F.col("__before")).alias("__take")))


def seeded_sample(df: DataFrame, n: int, seed: int, rank: str | None = None) -> DataFrame:
    """Exactly n rows without replacement, or all when there are fewer; `rank` names their order column.

    Rows are drawn in the order of their ids' keys, and rows that share an id in that of a hash of their content, so
    copies of an id count as the rows they are. Ids are counted and ranked on their own and the wide rows fetched by
    them, where they lie; of an id at most n rows leave a task. Rows without an id can't be found again and are never drawn.
    """
    df = df.filter(F.col(ID).isNotNull())
    ids = df.groupBy(ID).agg(F.count("*").alias("__rows")).withColumn("__key", sample_key(seed))
    picked = _ranked(ids, n)
    if n <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    content = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    copy = F.row_number().over(Window.partitionBy(ID).orderBy("__content"))
    rows = (df.withColumn("__content", content).join(picked, ID).withColumn("__copy", copy)
            .filter(F.col("__copy") <= n).filter(F.col("__copy") <= F.col("__take")))
    if rank:
        rows = rows.withColumn(rank, (F.col("__before") + F.col("__copy")).cast("int"))
    return rows.drop("__content", "__copy", "__before", "__take")


def pilot_cut(queue: DataFrame, size: int, seed: int) -> DataFrame:
    """A pilot's share of the queue: a seeded sample, or the whole queue when it is no longer than that."""
    return seeded_sample(queue, size, seed)


@dataclass(frozen=True)
class Quotas:
    train: int
    val: int

    @property
    def total(self) -> int:
        return self.train + self.val


def random_quotas(n: int, val_ratio: float, manual_train: int, manual_val: int) -> Quotas:
    """Random rows still needed per split after the manual picks."""
    val = int(n * val_ratio)
    return Quotas(max(0, n - val - manual_train), max(0, val - manual_val))


def label_split(df: DataFrame, n: int, seed: int, val_ratio: float,
                train_ids: Sequence[str] = (), val_ids: Sequence[str] = ()) -> DataFrame:
    """Rows for labelling with `split` (train/val) and `origin` (manual/random).

    Manual picks come first and count against their split's quota; the random rest never holds a
    manual id of either split. A short pool fills train first. One small job counts the manual rows.
    """
    listed = [*train_ids, *val_ids]
    manual = with_ids(df, listed)
    in_train, in_val = F.col(ID).isin(*train_ids), F.col(ID).isin(*val_ids)
    found = manual.agg(F.count_if(in_train).alias("train"), F.count_if(in_val).alias("val")).first() if listed else None
    need = random_quotas(n, val_ratio, *(found or (0, 0)))
    pool = without_ids(df, id_frame(df.sparkSession, listed))
    # Copies of an id listed on both sides belong to both splits.
    sides = F.array_compact(F.array(F.when(in_train, "train"), F.when(in_val, "val")))
    picked = manual.withColumn("split", F.explode(sides)).withColumn("origin", F.lit("manual"))
    random = seeded_sample(pool, need.total, seed, rank="__rank")
    random = (
        random.withColumn("split", F.when(F.col("__rank") <= need.train, "train").otherwise("val"))
        .withColumn("origin", F.lit("random")).drop("__rank")
    )
    return picked.unionByName(random)


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "origin").agg(F.count("*").alias("n_rows"))


def label_sheet(df: DataFrame, columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The listed columns that exist, then one empty slot per feature to label."""
    shown = [c for c in columns if c in df.columns]
    return df.select(*shown, *[F.lit(None).cast("string").alias(f) for f in features])
