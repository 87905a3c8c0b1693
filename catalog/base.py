"""Inputs of the registered queries, shaped from the given tables.

The expressions below are plain SQL that both engines read the same way; they only shape inputs.
Noise, nulls and overlapping runs are worked in by arithmetic on the keys because the given tables
have none. Every row of the source tables takes part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = WITH + sql
            return fn
        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The first line of a text, without splitting the rest.
POST_TITLE_LINE = "case when instr(text, chr(10)) > 0 then substr(text, 1, instr(text, chr(10)) - 1) else text end"

# Conversations: turn 0 is a post, the other turns are its comments.
POST_EXPRS = [
    "cast(conv_id as string) as post_id",
    "'src' || cast(conv_id % 20 as string) as post_subreddit",
    "case when conv_id % 13 = 0 then '' when conv_id % 17 = 0 then null else " + POST_TITLE_LINE + " end as post_title",
    "case when conv_id % 13 = 0 then '[removed]' when conv_id % 7 = 0 then null"
    " when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end as post_body",
    "(conv_id * 37) % 101 as post_score",
    "(conv_id * 13) % 57 as post_num_comments",
    "cast(1704067200 + conv_id * 3600 as double) as post_created_utc",
    "conv_id as n",
]
COMMENT_EXPRS = [
    "cast(conv_id as string) || '_' || cast(turn as string) as comment_id",
    "cast(conv_id as string) as post_id",
    "case when (conv_id * 31 + turn) % 11 = 0 then '[deleted]' when (conv_id * 31 + turn) % 13 = 0 then ''"
    " when (conv_id * 31 + turn) % 17 = 0 then null else text end as comment_body",
    "(conv_id * 7 + turn * 3) % 50 - 10 as comment_score",
    "cast(1704067200 + conv_id * 3600 + turn * 60 as double) as comment_created_utc",
    "conv_id as n",
]
# Each row is delivered by two of three runs, the later delivery with a fresher score.
EARLY_RUN = "case n % 3 when 2 then '20240201000000' else '20240101000000' end"
LATE_RUN = "case n % 3 when 0 then '20240201000000' else '20240301000000' end"
# Documents as a second corpus: posts to search, texts to sample and score.
DOC_POST_EXPRS = [
    "cast(doc_id as string) as post_id",
    "source as post_subreddit",
    POST_TITLE_LINE + " as post_title",
    "case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end as post_body",
    "(doc_id * 37) % 101 as post_score",
    "(doc_id * 13) % 57 as post_num_comments",
    "cast(1704067200 + doc_id * 3600 as double) as post_created_utc",
]
DOC_EXPRS = ["cast(doc_id as string) as comment_id", "text as text_content", "lang", "n_chars", "doc_id"]
TRUTH_EXPRS = [
    "cast(doc_id as string) as comment_id",
    "text as text_content",
    "quality * 3 + (1 - toxic) * 2 as content_relevance_score",
    "cast(n_chars % 201 - 100 as double) / 100e0 as sentiment_score",
    "case when toxic = 1 then 'Hostile' when quality = 1 then 'Analytical' else 'Other' end as discourse_tone",
]


def response_expr(feature: str, good: tuple[str, str, str]) -> str:
    """Ten kinds of answer, well and badly formed, over the documents."""
    a, b, c = good
    return f"""case doc_id % 10
      when 0 then '{{"{feature}": {a}}}' when 1 then '{{"{feature}": "{b}"}}'
      when 2 then '{{"{feature}": {c}}}' when 3 then '{{"{feature}": "{c}"}}'
      when 4 then '{{"{feature}": null}}' when 5 then '{{}}' when 6 then 'not json' when 7 then '[1]'
      when 8 then '{{"{feature}": true}}' else '{{"other": 1, "{feature}": {a}}}' end"""


def posts_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(*POST_EXPRS)


def comments_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("turn > 0").selectExpr(*COMMENT_EXPRS)


def two_runs(df: DataFrame, score: str) -> DataFrame:
    early = F.struct(F.expr(EARLY_RUN).alias("run"), F.lit(0).alias("more"))
    late = F.struct(F.expr(LATE_RUN).alias("run"), F.lit(5).alias("more"))
    return (df.withColumn("d", F.explode(F.array(early, late)))
            .withColumn(score, F.col(score) + F.col("d.more"))
            .withColumn("extraction_id", F.col("d.run")).drop("d", "n"))


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(posts_base(spark, sf_dir), "post_score")


def comments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(comments_base(spark, sf_dir), "comment_score")


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*DOC_POST_EXPRS)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*DOC_EXPRS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return both.selectExpr(*TRUTH_EXPRS)


def _select(exprs: list[str], source: str) -> str:
    return f"select {', '.join(exprs)} from {source}"


def _two_runs(base: str, columns: str, score: str) -> str:
    return (f"select {columns}, {score}, {EARLY_RUN} as extraction_id from {base}"
            f" union all select {columns}, {score} + 5, {LATE_RUN} from {base}")


_POST_COLUMNS = "post_id, post_subreddit, post_title, post_body, post_num_comments, post_created_utc"
_COMMENT_COLUMNS = "comment_id, post_id, comment_body, comment_created_utc"
_VIEWS = {
    "posts_base": _select(POST_EXPRS, "conversations where turn = 0"),
    "comments_base": _select(COMMENT_EXPRS, "conversations where turn > 0"),
    "posts_raw": _two_runs("posts_base", _POST_COLUMNS, "post_score"),
    "comments_raw": _two_runs("comments_base", _COMMENT_COLUMNS, "comment_score"),
    "posts_v": "select * exclude (rn) from (select *, row_number() over (partition by post_id"
               " order by extraction_id desc) as rn from posts_raw) where rn = 1",
    "comments_v": "select * exclude (rn) from (select *, row_number() over (partition by comment_id"
                  " order by extraction_id desc) as rn from comments_raw) where rn = 1",
    "doc_posts": _select(DOC_POST_EXPRS, "documents"),
    "docs": _select(DOC_EXPRS, "documents"),
    "truth": _select(TRUTH_EXPRS, "labels join documents using (doc_id)"),
}
WITH = "with " + ",\n".join(f"{name} as ({body})" for name, body in _VIEWS.items()) + "\n"
