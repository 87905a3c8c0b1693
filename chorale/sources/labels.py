"""Label sheets: JSON a person fills in, one object a line, and their way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.operators.sampling import label_sheet
from chorale.schema import LABEL_SHEET_COLUMNS
from chorale.sources.files import path_exists


def write_sheet(df: DataFrame, path: str, features: Sequence[str],
                columns: Sequence[str] = LABEL_SHEET_COLUMNS) -> None:
    """A folder of JSON lines with an explicit null per label slot, in id order; any number of rows."""
    sheet = label_sheet(df, columns, features).orderBy("comment_id")
    sheet.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_sheet(spark: SparkSession, path: str, features: Sequence[str],
               columns: Sequence[str] = LABEL_SHEET_COLUMNS) -> DataFrame:
    """A filled-in sheet: JSON lines, or one JSON array. A file that is neither is an error.

    Labels are kept as the text that was typed; `labelled_only` casts them.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no label sheet at {path}; draw and label a sample first")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, *features)])
    begin = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''").first()
    is_array = begin is not None and begin["v"].startswith("[")
    return spark.read.schema(schema).option("multiLine", is_array).option("mode", "FAILFAST").json(path)


def sheets_exist(spark: SparkSession, *paths: str) -> bool:
    """True only when every sheet is there."""
    return all(path_exists(spark, p) for p in paths)
