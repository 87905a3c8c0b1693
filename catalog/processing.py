"""Merging runs, cleaning, joining, assembling and looking things up."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Catalog, comments_base, comments_raw, posts_base, posts_raw
from chorale.functions.text import NOISE
from chorale.operators import cleaning, explore
from chorale.operators.joins import hot_keys
from chorale.session import work_dir
from chorale.sources import merged

catalog = Catalog()
_NOISE = str(NOISE)
_BOTH = f"not (post_title in {_NOISE} and post_body in {_NOISE})"
_TEXT = """'Post Title:' || chr(10) || chr(10) || coalesce(p.post_title, '') || chr(10) || chr(10) ||
      'Post Body:' || chr(10) || chr(10) || coalesce(p.post_body, '') || chr(10) || chr(10) ||
      'Comment Body:' || chr(10) || chr(10) || c.comment_body"""
_PROCESSED = f"""
    , processed as (
      select c.comment_id, p.post_id, p.post_score, c.comment_score, {_TEXT} as text_content
      from comments_v c join posts_v p on c.post_id = p.post_id
      where c.comment_body not in {_NOISE} and {_BOTH})
    """


@catalog.add("union_extractions", """
    select post_id, extraction_id, post_score, 'posts' as kind from posts_raw
    union all select comment_id, extraction_id, comment_score, 'comments' from comments_raw""")
def union_extractions(spark, sf_dir):
    """Posts and comments brought to one shape; each side is itself a union of runs."""
    posts = posts_raw(spark, sf_dir).select("post_id", "extraction_id", "post_score", F.lit("posts").alias("kind"))
    comments = comments_raw(spark, sf_dir).select(
        F.col("comment_id").alias("post_id"), "extraction_id", F.col("comment_score").alias("post_score"),
        F.lit("comments").alias("kind"))
    return cleaning.concat_strict(posts, comments)


@catalog.add("dedup_latest_posts", "select post_id, post_title, post_body, post_score, extraction_id from posts_v")
def dedup_latest_posts(spark, sf_dir):
    return cleaning.merge_runs(posts_raw(spark, sf_dir), "post_id").select(
        "post_id", "post_title", "post_body", "post_score", "extraction_id")


_SOME_KEYS = "case when cast(post_id as bigint) % 4 = 0 then null else comment_id end as comment_id"


@catalog.add("merge_keeps_null_ids", f"""
    , partly as (select * replace ({_SOME_KEYS.rsplit(' as ', 1)[0]} as comment_id) from comments_raw)
    select comment_id, post_id, comment_score, extraction_id from (
      select *, row_number() over (partition by comment_id order by extraction_id desc) as rn from partly)
    where rn = 1 or comment_id is null""")
def merge_keeps_null_ids(spark, sf_dir):
    """A quarter of the comments has no id: these are no copies of each other."""
    some = comments_raw(spark, sf_dir).withColumn("comment_id", F.expr(_SOME_KEYS.rsplit(" as ", 1)[0]))
    return cleaning.merge_runs(some, "comment_id").select("comment_id", "post_id", "comment_score", "extraction_id")


@catalog.add("dedup_latest_comments",
             "select comment_id, post_id, comment_body, comment_score, extraction_id from comments_v")
def dedup_latest_comments(spark, sf_dir):
    return cleaning.merge_runs(comments_raw(spark, sf_dir), "comment_id").select(
        "comment_id", "post_id", "comment_body", "comment_score", "extraction_id")


@catalog.add("dedup_first_comments", """
    select comment_id, comment_score, extraction_id from (select *, row_number() over (
      partition by comment_id order by extraction_id) as rn from comments_raw) where rn = 1""")
def dedup_first_comments(spark, sf_dir):
    return cleaning.merge_runs(comments_raw(spark, sf_dir), "comment_id", keep="first").select(
        "comment_id", "comment_score", "extraction_id")


@catalog.add("merge_increment", """
    select comment_id, post_id, comment_body, comment_score, extraction_id, 1 as n_rows from comments_v""")
def merge_increment(spark, sf_dir):
    """The runs merged one after the other into a bucketed table; the last one twice, which changes nothing."""
    table, raw = f"{work_dir(spark, 'merged')}/comments", comments_raw(spark, sf_dir)
    for run in ("20240101000000", "20240201000000", "20240301000000", "20240301000000"):
        merged.merge_increment(raw.filter(F.col("extraction_id") == run), table, run, "comment_id", buckets=16)
    rows = merged.read_merged(spark, table)
    return rows.groupBy("comment_id", "post_id", "comment_body", "comment_score", "extraction_id").agg(
        F.count("*").cast("int").alias("n_rows"))


@catalog.add("join_comments_posts", """
    select c.comment_id, p.post_id, p.post_subreddit, c.comment_score, p.post_score
    from comments_v c join posts_v p on c.post_id = p.post_id""")
def join_comments_posts(spark, sf_dir):
    raw = comments_raw(spark, sf_dir)
    posts = cleaning.merge_runs(posts_raw(spark, sf_dir), "post_id").drop("extraction_id")
    joined = cleaning.join_posts(cleaning.merge_runs(raw, "comment_id"), posts, hot=hot_keys(raw, "post_id"))
    return joined.select("comment_id", "post_id", "post_subreddit", "comment_score", "post_score")


@catalog.add("clean_comments", f"select comment_id, comment_body from comments_base where comment_body not in {_NOISE}")
def clean_comments(spark, sf_dir):
    return cleaning.drop_comment_noise(comments_base(spark, sf_dir)).select("comment_id", "comment_body")


@catalog.add("clean_posts", f"select post_id, post_title, post_body from posts_base where {_BOTH}")
def clean_posts(spark, sf_dir):
    return cleaning.drop_post_noise(posts_base(spark, sf_dir)).select("post_id", "post_title", "post_body")


def processed(spark, sf_dir):
    return cleaning.process(comments_raw(spark, sf_dir), posts_raw(spark, sf_dir))


@catalog.add("processed_text_content", _PROCESSED + "select * from processed")
def processed_text_content(spark, sf_dir):
    return processed(spark, sf_dir).select("comment_id", "post_id", "post_score", "comment_score", "text_content")


@catalog.add("lookup_post", "select post_id, post_title, post_score, extraction_id from posts_raw where post_id = '7'")
def lookup_post(spark, sf_dir):
    return explore.lookup(posts_raw(spark, sf_dir), post_id="7").select(
        "post_id", "post_title", "post_score", "extraction_id")


@catalog.add("lookup_comment", _PROCESSED + "select comment_id, text_content from processed where post_id = '16' and comment_id = '16_2'")
def lookup_comment(spark, sf_dir):
    return explore.lookup(processed(spark, sf_dir), post_id="16", comment_id="16_2").select("comment_id", "text_content")


@catalog.add("first_text", _PROCESSED + """
    select comment_id, length(text_content) as n_chars, (select text_content from processed where comment_id = '16_2') as shown
    from processed where post_id = '16'""")
def first_text(spark, sf_dir):
    """One comment's text as a plain value, set beside all comments of its post."""
    rows = processed(spark, sf_dir)
    shown = explore.first_value(explore.lookup(rows, post_id="16", comment_id="16_2"), "text_content")
    return explore.lookup(rows, post_id="16").select(
        "comment_id", F.length("text_content").cast("bigint").alias("n_chars"), F.lit(shown).cast("string").alias("shown"))


@catalog.add("extraction_view", "select comment_id, comment_score from comments_raw where extraction_id = '20240201000000'")
def extraction_view(spark, sf_dir):
    return explore.lookup(comments_raw(spark, sf_dir), extraction_id="20240201000000").select(
        "comment_id", "comment_score")


@catalog.add("head", _PROCESSED + "select comment_id, post_id, text_content from processed order by comment_id limit 5")
def head(spark, sf_dir):
    return explore.head(processed(spark, sf_dir), ["comment_id"]).select("comment_id", "post_id", "text_content")
