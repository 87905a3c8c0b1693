"""Path checks through the session's own file system, so they work on any store Spark can read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return fs.exists(hadoop_path)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Visible entries of a folder, sorted; hidden and marker files are left out."""
    hadoop_path, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def same_path(spark: SparkSession, a: str, b: str) -> bool:
    (pa, fs_a), (pb, fs_b) = _path(spark, a), _path(spark, b)
    return fs_a.makeQualified(pa).equals(fs_b.makeQualified(pb))


def _beside(path: str, kind: str) -> str:
    """A hidden folder next to `path`, which no listing of tables shows."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}.{kind}"


def _rename(spark: SparkSession, old: str, new: str) -> None:
    (source, fs), (target, _) = _path(spark, old), _path(spark, new)
    if not fs.rename(source, target):
        raise OSError(f"can't rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path, fs = _path(spark, path)
    fs.delete(hadoop_path, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts the former table back if a replacement died between its two renames."""
    if not path_exists(spark, path) and path_exists(spark, _beside(path, "old")):
        _rename(spark, _beside(path, "old"), path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage's output; a missing one names the path instead of failing inside the plan."""
    recover(spark, path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}; run the stage that writes it first")
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, inputs: tuple[str, ...] = ()) -> None:
    """Replaces a stage's output as a whole: it is written beside the former one, which stays readable until the new
    one is complete and then gives way to it by renaming. A write that fails changes nothing.

    A stage must not write onto what it reads: its readers would see files go.
    """
    spark = df.sparkSession
    for source in inputs:
        if same_path(spark, source, path):
            raise ValueError(f"{path} is also an input of this write")
    recover(spark, path)
    draft, old = _beside(path, f"draft-{uuid.uuid4().hex}"), _beside(path, "old")
    try:
        df.write.parquet(draft)
        if path_exists(spark, path):
            delete(spark, old)
            _rename(spark, path, old)
        _rename(spark, draft, path)
    except BaseException:
        recover(spark, path)
        delete(spark, draft)
        raise
    delete(spark, old)


def write_once(df: DataFrame, path: str) -> bool:
    """Writes unless the output is there already; says whether it wrote."""
    if path_exists(df.sparkSession, path):
        return False
    df.write.mode("ignore").parquet(path)
    return True


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "comment_id") -> None:
    """A catalog table bucketed and sorted by id: joins between such tables shuffle nothing.

    Repartitioning by the bucket hash first gives one file per bucket instead of one per task and bucket.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .format("parquet").saveAsTable(table))


def feature_folders(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every feature table of a folder by name; the file name up to its first dot is the name."""
    return {name.split(".")[0]: spark.read.parquet(f"{path}/{name}") for name in list_names(spark, path)}
