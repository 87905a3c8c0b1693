"""Explicit schemas of the stored tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_POSTS = _struct(
    ("post_id", _S),
    ("post_subreddit", _S),
    ("post_title", _S),
    ("post_body", _S),
    ("post_url", _S),
    ("post_score", _L),
    ("post_upvote_ratio", _D),
    ("post_num_comments", _L),
    ("post_num_crossposts", _L),
    ("post_total_awards", _L),
    ("post_is_self", _B),
    ("post_is_over_18", _B),
    ("post_is_stickied", _B),
    ("post_is_locked", _B),
    ("post_subreddit_subscribers", _L),
    ("post_domain", _S),
    ("post_flair", _S),
    ("post_created_utc", _D),
    ("post_created_utc_date", _S),
    ("extraction_query", _S),
    ("extraction_sort", _S),
    ("extraction_time", _S),
)

RAW_COMMENTS = _struct(
    ("comment_id", _S),
    ("post_id", _S),
    ("comment_body", _S),
    ("comment_score", _L),
    ("comment_score_hidden", _B),
    ("comment_created_utc", _D),
    ("comment_created_utc_date", _S),
)

AUTHORS = _struct(
    ("author_id", _S),
    ("author_name", _S),
    ("author_post_karma", _L),
    ("author_comment_karma", _L),
    ("author_created_utc", _D),
    ("is_suspended", _B),
)

# One row per (comment, feature) answer; `feature` is the partition directory.
RESPONSES = _struct(
    ("comment_id", _S),
    ("response", _S),
    ("error", _S),
    ("scored_at", T.TimestampType()),
    ("feature", _S),
)

# Columns shown to the person who labels a sample.
LABEL_SHEET_COLUMNS = ("comment_id", "post_title", "post_body", "comment_body", "text_content")

RAW_SCHEMAS = {"posts": RAW_POSTS, "comments": RAW_COMMENTS}
