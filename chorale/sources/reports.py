"""Validation reports as an append-only table, one row per feature and validation run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_report(report: DataFrame, path: str, run: str) -> None:
    report.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
