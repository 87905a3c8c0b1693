"""Incremental scoring: landing files in, answers appended, every id paid for once.

The checkpoint remembers files; the answer store remembers ids. A batch asks only for ids the store
lacks, so re-delivered comments and replayed batches cost nothing: if a batch dies after some of its
answers became visible, the replay finds them and asks for the rest. A batch opens only the buckets of the store its ids
belong to.

A comment that comes before its post waits in a table of its own, one version a batch, and is taken up again with every
batch until the post has landed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chorale.functions.text import text_content
from chorale.operators.cleaning import drop_comment_noise, drop_post_noise
from chorale.operators.joins import ROWS_PER_TASK, spread_join
from chorale.operators.ranking import one_per_key
from chorale.operators.scoring import score_into_store
from chorale.registry import Feature
from chorale.sources.files import delete, list_names, path_exists, write_table


def landing_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000,
                   pattern: str | None = None) -> DataFrame:
    """Parquet files as they arrive, at most `files_per_batch` to a batch.

    A batch reads the ids of the store's buckets that its own ids belong to.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, store: str, checkpoint: str, features: Sequence[Feature],
                 ask: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Scores all files that are there and stops; the next start takes up what came since.

    `stream` has comment_id and text_content.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        score_into_store(batch, store, features, ask)

    return (stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def clean_stream(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Arriving comments, cleaned and with their text assembled from the stored posts.

    `posts` has one row per post (see `merge_runs`). Every micro-batch joins the posts as stored when
    it runs. A comment that comes before its post is dropped here: for streams that can run ahead of their posts
    there is `score_arrivals`.
    """
    kept = drop_post_noise(posts).select("post_id", "post_title", "post_body")
    joined = drop_comment_noise(comments).join(kept, "post_id")
    return joined.select("comment_id", text_content().alias("text_content"))


_WAITING = "comment_id string, post_id string, comment_body string"


def _waiting(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """Comments that waited when batch `before` began."""
    after = [int(n.removeprefix("after=")) for n in list_names(spark, folder)] if path_exists(spark, folder) else []
    known = [n for n in after if n < before]
    if not known:
        return spark.createDataFrame([], _WAITING)
    return spark.read.schema(_WAITING).parquet(f"{folder}/after={max(known)}")


def _take_up(arrived: DataFrame, posts: DataFrame, store: str, waiting: str, batch: int, features: Sequence[Feature],
             ask: Callable[[DataFrame], DataFrame], rows_per_task: int) -> None:
    """Scores the comments whose post is there, and stores the others as those that wait after this batch."""
    spark = arrived.sparkSession
    comments = drop_comment_noise(arrived).filter("post_id is not null").select("comment_id", "post_id", "comment_body")
    comments = comments.unionByName(_waiting(spark, waiting, batch))
    # Read by the join, by the count of hot posts and by the anti-join.
    comments = one_per_key(comments, ["comment_id"], [F.asc("post_id"), F.asc("comment_body")]).persist()
    try:
        kept = drop_post_noise(posts).select("post_id", "post_title", "post_body")
        joined = spread_join(comments, kept, "post_id", "comment_id", rows_per_task=rows_per_task)
        texts = joined.select("comment_id", text_content().alias("text_content"))
        score_into_store(texts, store, features, ask, unique=True)
        # A comment whose post has landed as noise waits no longer.
        early = comments.join(posts.select("post_id"), "post_id", "left_anti").select("comment_id", "post_id", "comment_body")
        early.write.mode("overwrite").parquet(f"{waiting}/after={batch}")
    finally:
        comments.unpersist()
    # A replay of this batch needs the version before it; older ones are done with.
    for name in list_names(spark, waiting):
        if int(name.removeprefix("after=")) < batch - 1:
            delete(spark, f"{waiting}/{name}")


def score_arrivals(comments: DataFrame, posts: Callable[[], DataFrame], store: str, waiting: str, checkpoint: str,
                   features: Sequence[Feature], ask: Callable[[DataFrame], DataFrame],
                   rows_per_task: int = ROWS_PER_TASK) -> StreamingQuery:
    """Scores arriving raw comments with the posts stored so far; comments whose post is not there yet wait for it.

    `posts()` is read anew by every batch and has one row per post; unlike an inner join with a stream of posts this
    needs no state that grows with the posts. A post with very many comments is split over tasks. `waiting` is the
    folder of the comments that wait: a batch reads what the one before it left and writes its own version, so a
    replayed batch finds the same. Comments without a post id are dropped.
    """
    def commit(batch: DataFrame, batch_id: int) -> None:
        _take_up(batch, posts(), store, waiting, batch_id, features, ask, rows_per_task)

    return (comments.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def settle(spark: SparkSession, posts: DataFrame, store: str, waiting: str, features: Sequence[Feature],
           ask: Callable[[DataFrame], DataFrame], rows_per_task: int = ROWS_PER_TASK) -> int:
    """Takes up the waiting comments when posts have landed but no comment has; returns how many still wait.

    For times without a running stream.
    """
    if not path_exists(spark, waiting):
        return 0
    last = max(int(n.removeprefix("after=")) for n in list_names(spark, waiting))
    rows = spark.read.schema(_WAITING).parquet(f"{waiting}/after={last}")
    kept = drop_post_noise(posts).select("post_id", "post_title", "post_body")
    joined = spread_join(rows, kept, "post_id", "comment_id", rows_per_task=rows_per_task)
    score_into_store(joined.select("comment_id", text_content().alias("text_content")), store, features, ask, unique=True)
    write_table(rows.join(posts.select("post_id"), "post_id", "left_anti").select(
        "comment_id", "post_id", "comment_body"), f"{waiting}/after={last}")
    return spark.read.schema(_WAITING).parquet(f"{waiting}/after={last}").count()
