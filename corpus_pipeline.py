"""Five stages from raw documents to token sequences in training order.

run(spark, sf_dir) applies them to `documents`; each stage's rows are written to the shared folder and
read again before the next one. All but the last return the columns of `documents`; the last writes
the shards and returns their index, one row a sequence.

Edge cases: null, empty and blank texts pass the classifier, are copies of each other for the near-dedup (one stays),
hold no benchmark item, and are never taken by the mix; very long texts are read whole; repeated rows, and rows of one
doc_id, are judged each by itself but for the near-dedup, which keeps one row of the smallest doc_id of a group; rows
with a null doc_id are never dropped as copies; null sources are a source of their own; an empty table runs through;
further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chorale.llm import decontaminate, materialise, mixing, quality, simhash
from chorale.llm.common import stored
from chorale.session import work_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weak-label classifier accepts."""
    return quality.keep_good(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash at 4 or fewer of 64 bits, as op5, and beyond these the near
    copies with 0.8 of their five-word shingles in common.
    """
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a document taken n times is n rows."""
    return mixing.mixed(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in shards below the shared folder, and their index."""
    return materialise.materialise(docs, work_dir(spark, "training"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("training order", training_order),
]

# The classifier, the fingerprints and the edit matching are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
