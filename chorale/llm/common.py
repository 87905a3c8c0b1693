"""Helpers the corpus operators share: stored tables, group streams, running sums, components."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.session import work_dir

# What counts as white space between words: the ASCII blanks, as `bytes.split()` sees them.
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read again: later reads survive lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of the whole text; null counts 0."""
    parts = F.split(text, BLANKS)
    blank = lambda at: (F.element_at(parts, at) == "").cast("int")
    # A text of blanks alone splits into two empty ends, an empty one into a single empty part.
    count = F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1))
    return F.when(text.isNull(), 0).otherwise(count).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def groups_of(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that arrive sorted by `keys`; holds one group and one batch."""
    parts: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        marks = batch[list(keys)].to_numpy()
        starts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        if parts and (parts[-1][list(keys)].to_numpy()[-1] != marks[0]).any():
            yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            parts = []
        bounds = [0, *starts.tolist()]
        for begin, end in zip(bounds, bounds[1:], strict=False):
            parts.append(batch.iloc[begin:end])
            yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            parts = []
        parts.append(batch.iloc[bounds[-1]:])
    if parts:
        yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


def by_groups(df: DataFrame, keys: Sequence[str], function, schema: str) -> DataFrame:
    """`function(group)` for each key, as a stream over sorted partitions: a few microseconds a group
    where a grouped Pandas UDF takes milliseconds. A group must fit one task; callers split hot ones.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, keys):
            out = function(group)
            if out is not None and len(out):
                yield out
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str]) -> DataFrame:
    """Global inclusive running sums in `order`, with no task seeing more than its range of rows.

    Rows are dealt into ranges and stored with their range number; one row per range is summed, and
    the offsets (as many as there are partitions, hence broadcast) are added to the sums of a range.
    `order` should be total: tied rows get their sums in an unspecified order among themselves.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(*[F.sum(v).alias(f"__{k}") for k, v in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[
        F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (dealt.join(F.broadcast(offsets), "__part")
            .withColumns({k: F.sum(v).over(own) + F.col(f"__{k}") for k, v in sums.items()})
            .drop("__part", *[f"__{k}" for k in sums]))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _to_smallest(edges: DataFrame) -> DataFrame:
    """The same connections: a node keeps its smallest neighbour, which its other smaller ones are linked to.

    Edges are (a, b) with a > b, before and after. Each edge makes one edge, and most of those are equal.
    """
    least = edges.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    return least.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (a, b) that isn't itself its component's smallest node.

    Alternating stars: every round links the larger neighbours of a node to its smallest neighbour,
    then its smaller ones. The number of rounds grows with the logarithm of a component's diameter.
    The smaller ones come first once before: forests of many tasks that share their nodes name up to
    one smaller neighbour a task for each, and all but one of these go before any join.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(_to_smallest(edges), "edges")
    mark = _mark(edges)
    while mark[0]:
        low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        edges = stored(_to_smallest(large), "edges")
        old, mark = mark, _mark(edges)
        if mark == old:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def forest(rows: Sequence[tuple[int, np.ndarray]], nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest. rows: a position and the positions it is linked to."""
    label, out = np.arange(len(nodes)), []
    for at, near in rows:
        roots = np.unique(label[np.append(near, at)])
        if len(roots) > 1:
            out += [(int(nodes[roots[0]]), int(nodes[r])) for r in roots[1:]]
            label[np.isin(label, roots[1:])] = roots[0]
    return out
