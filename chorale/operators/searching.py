"""Corpus search over a stored posts table: grid, keywords, time window, top-k, first-seen rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale.functions.terms import Group, Word, matched_words, searchable
from chorale.functions.times import age_days, iso_utc, within_window
from chorale.operators.joins import spread_join
from chorale.operators.ranking import one_per_key, top_k

# The orders a search offers.
SORTS = ("relevance", "top", "new", "comments")
# Found posts up to this many narrow rows (id and cell, some tens of bytes) are broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class SearchGrid:
    """Every community with every query in every sort; communities vary slowest, sorts fastest."""

    communities: tuple[str, ...]
    queries: tuple[Word | Group, ...]
    sorts: tuple[str, ...] = SORTS

    def __post_init__(self) -> None:
        if unknown := set(self.sorts) - set(SORTS):
            raise ValueError(f"unknown sorts: {sorted(unknown)}")

    @property
    def size(self) -> int:
        return len(self.communities) * len(self.queries) * len(self.sorts)


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def search_hits(posts: DataFrame, grid: SearchGrid, k: int, as_of: datetime | None = None,
                window: str = "all") -> DataFrame:
    """Best `k` posts of each grid cell: post_id, cell, rank, extraction_query, extraction_sort.

    `posts` has one row per post. With `as_of`, only posts of the window that ends there are searched.
    A post reads its text once per query, whatever the number of sorts; a cell is an exploded literal,
    so no grid frame is joined. The text is dropped before anything is shuffled.
    """
    if as_of is not None:
        posts = posts.filter(within_window(F.col("post_created_utc"), as_of, window))
    elif window != "all":
        raise ValueError("a time window needs as_of")
    text = F.col("__text")
    found = F.array_compact(F.array(*[
        F.when(q.matches(text), F.struct(F.lit(i).alias("q"), matched_words(q, text).alias("words")))
        for i, q in enumerate(grid.queries)
    ]))
    main = {
        "relevance": F.col("hit.words"),
        "top": F.col("post_score"),
        "new": F.col("post_created_utc"),
        "comments": F.col("post_num_comments"),
    }
    orders = F.array(*[
        F.struct(F.lit(i).alias("s"), main[s].cast("double").alias("first"),
                 (F.col("post_score") if s == "relevance" else F.lit(0)).cast("double").alias("second"))
        for i, s in enumerate(grid.sorts)
    ])
    community = F.array_position(_literals(grid.communities), F.col("post_subreddit")) - 1
    cell = (community * len(grid.queries) + F.col("hit.q")) * len(grid.sorts) + F.col("sort.s")
    candidates = (
        posts.filter(F.col("post_subreddit").isin(*grid.communities))
        .withColumn("__text", searchable("post_title", "post_body"))
        .select("post_id", "post_subreddit", "post_score", "post_num_comments", "post_created_utc",
                F.explode(found).alias("hit"))
        .withColumn("sort", F.explode(orders))
        .select("post_id", cell.cast("int").alias("cell"), "sort.first", "sort.second",
                F.col("hit.q").alias("q"), F.col("sort.s").alias("s"))
    )
    best = top_k(candidates, k, [F.desc("first"), F.desc("second"), F.asc("post_id")], by=["cell"],
                 spread_by="post_id")
    return best.select(
        "post_id", "cell", "rank",
        F.element_at(_literals([str(q) for q in grid.queries]), F.col("q") + 1).alias("extraction_query"),
        F.element_at(_literals(grid.sorts), F.col("s") + 1).alias("extraction_sort"),
    )


def first_seen_posts(hits: DataFrame) -> DataFrame:
    """Each post once, with the lineage of the first cell that found it."""
    return one_per_key(hits, ["post_id"], [F.asc("cell"), F.asc("rank")])


def _join_found(comments: DataFrame, found: DataFrame, max_found: int | None) -> DataFrame:
    """Comments with the columns of their found post, whose ids are unique.

    The found posts are counted, unless a bound says already that they are too many: a narrow job, and a cheap one
    over a stored table. Few are broadcast and no comment is shuffled; else posts with very many comments are split
    over tasks.
    """
    if (max_found is None or max_found <= BROADCAST_ROWS) and found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return comments.join(F.broadcast(found), "post_id")
    return spread_join(comments, found, "post_id", "comment_id")


def comments_of(comments: DataFrame, posts: DataFrame, max_posts: int | None = None) -> DataFrame:
    """The comments of the given posts."""
    return _join_found(comments, posts.select("post_id").distinct(), max_posts)


def first_seen_comments(comments: DataFrame, seen: DataFrame, max_seen: int | None = None) -> DataFrame:
    """Each comment of a seen post once; under two posts, the earlier found one keeps it.

    `seen` has post_id, cell, rank and at most `max_seen` rows.
    """
    joined = _join_found(comments, seen.select("post_id", "cell", "rank"), max_seen)
    return one_per_key(joined, ["comment_id"], [F.asc("cell"), F.asc("rank"), F.asc("post_id")]).drop("cell", "rank")


def cell_lineage(grid: SearchGrid, cell: Column) -> tuple[Column, Column]:
    """Query text and sort of a grid cell, looked up in the grid's own lists."""
    sorts = len(grid.sorts)
    query = F.element_at(_literals([str(q) for q in grid.queries]), (F.floor(cell / sorts) % len(grid.queries) + 1).cast("int"))
    return query, F.element_at(_literals(grid.sorts), (cell % sorts + 1).cast("int"))


def with_search_lineage(posts: DataFrame, seen: DataFrame, extraction_time: str, grid: SearchGrid,
                        max_seen: int | None = None) -> DataFrame:
    """The wide rows of the seen posts with query, sort and the run's one time stamp.

    Only post_id and cell meet the posts; the texts of query and sort are looked up behind the join.
    """
    keep = [c for c in posts.columns if not c.startswith("extraction_") and c != "cell"]
    narrow = seen.select("post_id", "cell")
    if (max_seen is None or max_seen <= BROADCAST_ROWS) and narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        narrow = F.broadcast(narrow)
    query, sort = cell_lineage(grid, F.col("cell"))
    return posts.select(*keep).join(narrow, "post_id").select(
        *keep, query.alias("extraction_query"), sort.alias("extraction_sort"), F.lit(extraction_time).alias("extraction_time"))


def project_posts(source: DataFrame, extraction_query: Column, extraction_sort: Column,
                  extraction_time: str) -> DataFrame:
    """Source post fields to the raw posts table."""
    return source.select(
        F.col("id").cast("string").alias("post_id"),
        F.col("community").alias("post_subreddit"),
        F.col("title").alias("post_title"),
        F.col("body").alias("post_body"),
        F.col("url").alias("post_url"),
        F.col("score").cast("bigint").alias("post_score"),
        F.col("upvote_ratio").cast("double").alias("post_upvote_ratio"),
        F.col("num_comments").cast("bigint").alias("post_num_comments"),
        F.col("num_crossposts").cast("bigint").alias("post_num_crossposts"),
        F.col("total_awards").cast("bigint").alias("post_total_awards"),
        F.col("is_self").alias("post_is_self"),
        F.col("over_18").alias("post_is_over_18"),
        F.col("stickied").alias("post_is_stickied"),
        F.col("locked").alias("post_is_locked"),
        F.col("community_subscribers").cast("bigint").alias("post_subreddit_subscribers"),
        F.col("domain").alias("post_domain"),
        F.nullif(F.col("flair"), F.lit("")).alias("post_flair"),
        F.col("created_utc").cast("double").alias("post_created_utc"),
        iso_utc(F.col("created_utc")).alias("post_created_utc_date"),
        extraction_query.alias("extraction_query"),
        extraction_sort.alias("extraction_sort"),
        F.lit(extraction_time).alias("extraction_time"),
    )


def project_comments(source: DataFrame) -> DataFrame:
    """Source comment fields to the raw comments table."""
    return source.select(
        F.col("id").cast("string").alias("comment_id"),
        F.col("post_id").cast("string").alias("post_id"),
        F.col("body").alias("comment_body"),
        F.col("score").cast("bigint").alias("comment_score"),
        F.col("score_hidden").alias("comment_score_hidden"),
        F.col("created_utc").cast("double").alias("comment_created_utc"),
        iso_utc(F.col("created_utc")).alias("comment_created_utc_date"),
    )


def with_authors(df: DataFrame, authors: DataFrame, as_of: datetime, spread_by: str) -> DataFrame:
    """Adds author columns; deleted, suspended and unreadable accounts get the fixed defaults.

    `df.author_id` is null or unknown for a deleted account. One author may own very many rows, and
    the deleted ones share the null key: both are spread.
    """
    table = authors.select(
        F.col("author_id"), F.col("author_name").alias("__name"),
        F.col("author_post_karma").alias("__pk"), F.col("author_comment_karma").alias("__ck"),
        F.col("author_created_utc").alias("__created"), F.col("is_suspended").alias("__suspended"),
        F.lit(True).alias("__known"),
    )
    joined = spread_join(df, table, "author_id", spread_by, how="left")
    # Statuses and the defaults of accounts that cannot be read.
    status = (
        F.when(F.col("__known").isNull(), "Deleted")
        .when(F.col("__suspended"), "Suspended")
        .when(F.col("__created").isNull(), "Error")
        .otherwise("Active")
    )
    active = F.col("author_status") == "Active"
    return joined.withColumn("author_status", status).withColumns({
        "author_id": F.when(active, F.col("author_id")).otherwise("[unavailable]"),
        "author_name": F.when(active, F.col("__name"))
        .when(F.col("author_status") == "Suspended", "[suspended]").otherwise("[deleted]"),
        "author_post_karma": F.when(active, F.col("__pk")).otherwise(F.lit(0)),
        "author_comment_karma": F.when(active, F.col("__ck")).otherwise(F.lit(0)),
        "account_age_days": F.when(active, age_days(F.col("__created"), as_of)).otherwise(F.lit(-1)),
    }).drop("__name", "__pk", "__ck", "__created", "__suspended", "__known")


def unique_counts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct posts and comments; each side combines before its one shuffle."""
    return (
        posts.agg(F.countDistinct("post_id").alias("n")).select(F.lit("posts").alias("kind"), "n")
        .unionAll(comments.agg(F.countDistinct("comment_id").alias("n")).select(F.lit("comments").alias("kind"), "n"))
    )


def running_unique_posts(hits: DataFrame) -> DataFrame:
    """Unique posts found up to and including each grid cell with a hit.

    Counts per cell come first, so the running sum sees at most one row per cell.
    """
    new = F.count_if("__first").alias("new_posts")
    marked = hits.withColumn("__first", F.row_number().over(
        Window.partitionBy("post_id").orderBy("cell", "rank")) == 1)
    per_cell = marked.groupBy("cell").agg(F.count("*").alias("hits"), new)
    upto = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return per_cell.withColumn("unique_posts", F.sum("new_posts").over(upto))
