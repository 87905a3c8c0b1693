"""Merging collection runs, removing duplicates and noise, joining comments to their posts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.text import is_noise, text_content
from chorale.operators.joins import ROWS_PER_TASK, hot_keys, spread_join
from chorale.operators.ranking import one_per_key


def concat_strict(*frames: DataFrame) -> DataFrame:
    """Vertical concat of frames with the same columns and types; anything else is an error.

    A plain union would widen an int and a string column to one type without a word.
    """
    if not frames:
        raise ValueError("nothing to concatenate")
    want = [(f.name, f.dataType) for f in frames[0].schema]
    for frame in frames[1:]:
        got = [(f.name, f.dataType) for f in frame.schema]
        if got != want:
            raise ValueError(f"schemas differ: {sorted(map(str, set(want) ^ set(got)))}")
    return reduce(DataFrame.unionAll, frames)


def merge_runs(df: DataFrame, key: str, keep: str = "last", ties: Sequence[str] = ()) -> DataFrame:
    """One row per key over overlapping runs: of the latest (or first) run, then the smallest `ties`.

    Rows without a key are no duplicates of each other: all of them stay.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    run = F.desc("extraction_id") if keep == "last" else F.asc("extraction_id")
    merged = one_per_key(df.filter(F.col(key).isNotNull()), [key], [run, *[F.asc(c) for c in ties]])
    return merged.unionByName(df.filter(F.col(key).isNull()))


def drop_comment_noise(df: DataFrame) -> DataFrame:
    """Without comments whose body is noise or null."""
    return df.filter(~is_noise("comment_body"))


def drop_post_noise(df: DataFrame) -> DataFrame:
    """Without posts whose title and body are both noise; one real field is enough to stay.

    Three-valued: a null beside a real field stays, a null beside noise or null goes.
    """
    return df.filter(~(is_noise("post_title") & is_noise("post_body")))


def join_posts(comments: DataFrame, posts: DataFrame, hot: DataFrame | None = None,
               rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each comment with its post's columns. A post with very many comments is split over tasks."""
    return spread_join(comments, posts, "post_id", "comment_id", hot=hot, rows_per_task=rows_per_task)


def process(comments: DataFrame, posts: DataFrame, keep: str = "last",
            post_ties: Sequence[str | Column] = (), comment_ties: Sequence[str | Column] = (),
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Raw runs to one row per clean comment, with its post and `text_content`.

    Runs are merged before the join: k copies on both sides would give k*k rows. Duplicates go
    before noise, so a comment deleted by its latest run disappears. Each side's filter sits below
    the join; the long assembled text is built above it and never shuffled. Hot posts are found on
    the raw comments, where it takes one narrow column.
    """
    hot = hot_keys(comments, "post_id", rows_per_task)
    comments = drop_comment_noise(merge_runs(comments, "comment_id", keep, comment_ties))
    posts = drop_post_noise(merge_runs(posts, "post_id", keep, post_ties))
    overlap = [c for c in posts.columns if c in comments.columns and c != "post_id"]
    joined = join_posts(comments, posts.drop(*overlap), hot=hot)
    return joined.withColumn("text_content", text_content())
