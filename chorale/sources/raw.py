"""Raw collection runs: one output per run, named after the run.

    posts_data_raw_20240101000000.parquet     comments_data_raw_20240101000000.parquet

An entry may be a single file or a folder of part files. The run id is only in the name, so it is
read back from the path into `extraction_id`.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chorale.schema import RAW_SCHEMAS
from chorale.sources.files import list_names

log = logging.getLogger(__name__)
FOOTERS_AT_ONCE = 16


def run_id(moment: datetime) -> str:
    return moment.strftime("%Y%m%d%H%M%S")


def run_path(folder: str, kind: str, extraction_id: str) -> str:
    return f"{folder.rstrip('/')}/{kind}_data_raw_{extraction_id}.parquet"


def write_run(df: DataFrame, folder: str, kind: str, extraction_id: str) -> bool:
    """One run's posts or comments. An empty result is reported and leaves no output."""
    if df.isEmpty():
        log.warning("no %s in run %s; nothing written", kind, extraction_id)
        return False
    df.write.mode("errorifexists").parquet(run_path(folder, kind, extraction_id))
    return True


def list_runs(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Entries of the folder whose name before the first dot holds the kind."""
    return [n for n in list_names(spark, folder) if kind in n.split(".")[0]]


def run_of(name: str, kind: str) -> str | None:
    """The run id in an entry's name, or None."""
    found = re.fullmatch(rf"{kind}_data_raw_([0-9]+)", name.split(".")[0])
    return found and found[1]


def schema_faults(spark: SparkSession, paths: Sequence[str], schema: StructType) -> dict[str, list[str]]:
    """What each run lacks or has beside the schema, by path; runs without a fault are left out.

    Footers are read by Spark, many runs at a time.
    """
    want = {(f.name, f.dataType) for f in schema}

    def fault(path: str) -> tuple[str, list[str]]:
        return path, sorted(map(str, {(f.name, f.dataType) for f in spark.read.parquet(path).schema} ^ want))

    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        return {path: found for path, found in pool.map(fault, paths) if found}


def read_runs(spark: SparkSession, folder: str, kind: str, extraction_id: str | None = None,
              check_schemas: bool = True) -> DataFrame:
    """All runs of `posts` or `comments` as one scan, or the single run with that id; duplicates are kept.

    The schema is the stored contract. A run that lacks a column or has another type is refused, and all such runs are
    named: a plain read would fill the column with nulls.
    """
    schema = RAW_SCHEMAS[kind]
    names = list_runs(spark, folder, kind)
    if extraction_id is not None:
        names = [n for n in names if run_of(n, kind) == extraction_id]
    if not names:
        raise FileNotFoundError(f"no {kind} runs in {folder}" + (f" with the id {extraction_id}" if extraction_id else ""))
    paths = [f"{folder.rstrip('/')}/{n}" for n in names]
    if check_schemas and (faults := schema_faults(spark, paths, schema)):
        raise ValueError("; ".join(f"{path} differs from the {kind} schema: {what}" for path, what in faults.items()))
    run = F.regexp_extract(F.col("_metadata.file_path"), rf"{kind}_data_raw_([0-9]+)", 1)
    return spark.read.schema(schema).parquet(*paths).withColumn("extraction_id", run)
