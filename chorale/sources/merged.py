"""The newest row of each key, kept up run by run: a merged table in buckets of which a run rewrites only its own.

    <table>/run=<id>/bucket=<n>/...     the buckets a run has rewritten
    <table>/manifest                    which run's folder holds each bucket now, one narrow row a bucket

A run's folder is not part of the table before the manifest names it, and the manifest is replaced as a whole. A run that
dies is started again; a run that is in the manifest already changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.operators.cleaning import merge_runs
from chorale.sources import files

BUCKETS = 64
# Rows without a key are no duplicates of each other: a run adds its own to this bucket and rewrites none.
KEYLESS = -1
_MANIFEST = "bucket int, run string, buckets int"


def _bucket(key: str, buckets: int) -> Column:
    return F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def manifest(spark: SparkSession, table: str) -> list[tuple[int, str, int]]:
    """(bucket, run, number of buckets) rows: at most one for each bucket, and one for each run with keyless rows."""
    path = f"{table}/manifest"
    files.recover(spark, path)
    if not files.path_exists(spark, path):
        return []
    return sorted(tuple(r) for r in spark.read.schema(_MANIFEST).parquet(path).collect())


def _read(spark: SparkSession, table: str, rows: Sequence[tuple[int, str, int]]) -> DataFrame | None:
    paths = [f"{table}/run={run}/bucket={bucket}" for bucket, run, _ in rows]
    return spark.read.parquet(*paths) if paths else None


def read_merged(spark: SparkSession, table: str, key_values: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The merged rows; with `key_values` (a frame with `key`) only the buckets that can hold these are opened."""
    held = manifest(spark, table)
    if not held:
        raise FileNotFoundError(f"no merged table at {table}")
    if key_values is not None:
        # At most as many values as there are buckets.
        wanted = {r[0] for r in key_values.select(_bucket(key, held[0][2])).distinct().collect()}
        found = _read(spark, table, [r for r in held if r[0] in wanted])
        return found if found is not None else _read(spark, table, held).limit(0)
    return _read(spark, table, held)


def merge_increment(new: DataFrame, table: str, run: str, key: str, keep: str = "last", ties: Sequence[str] = (),
                    buckets: int = BUCKETS) -> list[int]:
    """Merges one run's rows (which have `extraction_id`) into the table; returns the buckets it has rewritten.

    The cost follows the run and the buckets it touches, not the runs before it. The number of buckets is that of the
    table once it exists.
    """
    spark, held = new.sparkSession, manifest(new.sparkSession, table)
    if any(r[1] == run for r in held):
        return []
    buckets = held[0][2] if held else buckets
    new = new.withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most `buckets` + 1 rows
    replaced = [r for r in held if r[0] in touched and r[0] != KEYLESS]
    before = _read(spark, table, replaced)
    rows = new if before is None else new.unionByName(before.withColumn("bucket", _bucket(key, buckets)))
    merged = merge_runs(rows, key, keep, ties)
    # A bucket is a few files, and AQE splits one with very many rows.
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/run={run}")
    after = [r for r in held if r not in replaced] + [(b, run, buckets) for b in touched]
    rows = pa.table({"bucket": pa.array([r[0] for r in after], pa.int32()), "run": pa.array([r[1] for r in after], pa.string()),
                     "buckets": pa.array([r[2] for r in after], pa.int32())})
    files.write_table(spark.createDataFrame(rows).coalesce(1), f"{table}/manifest")
    return touched


def drop_replaced(spark: SparkSession, table: str) -> list[str]:
    """Deletes bucket folders the manifest no longer names; for times without readers of an older state."""
    held = {f"run={run}/bucket={bucket}" for bucket, run, _ in manifest(spark, table)}
    gone = []
    for folder in files.list_names(spark, table):
        if not folder.startswith("run="):
            continue
        for bucket in files.list_names(spark, f"{table}/{folder}"):
            if bucket.startswith("bucket=") and f"{folder}/{bucket}" not in held:
                files.delete(spark, f"{table}/{folder}/{bucket}")
                gone.append(f"{folder}/{bucket}")
    return gone
