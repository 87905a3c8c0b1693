"""Search, first-seen rows, projections, authors and counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import POST_TITLE_LINE, Catalog, comments_base, comments_raw, doc_posts, posts_raw, table
from chorale.functions.terms import all_of, any_of, phrase, prefix, searchable, term
from chorale.functions.times import within_window
from chorale.operators import searching
from chorale.operators.cleaning import merge_runs
from chorale.session import work_dir
from chorale.sources.raw import read_runs, write_run

catalog = Catalog()

QUERIES = (
    all_of(any_of("thon", prefix("anti")), any_of("erin", "thing", phrase("it is"))),
    any_of(prefix("onen"), phrase("of the")),
    all_of("than", any_of("thre", all_of("thed", term("er")))),
)
COMMUNITIES = tuple(f"src{i}" for i in range(20))
GRID = searching.SearchGrid(COMMUNITIES, QUERIES)
K = 5


def _has(words: str) -> str:
    return f"cast(regexp_matches(t, '(^|[^a-z0-9_])({words})($|[^a-z0-9_])') as int)"


_W = {w: _has(w) for w in ("thon", "anti[a-z0-9_]*", "erin", "thing", "it\\s+is", "onen[a-z0-9_]*", "of\\s+the",
                           "than", "thre", "thed", "er")}


def _sum(*words: str) -> str:
    return " + ".join(_W[w] for w in words)


_TESTS = [
    (f"({_sum('thon', 'anti[a-z0-9_]*')}) > 0 and ({_sum('erin', 'thing', 'it\\s+is')}) > 0",
     _sum("thon", "anti[a-z0-9_]*", "erin", "thing", "it\\s+is")),
    (f"({_sum('onen[a-z0-9_]*', 'of\\s+the')}) > 0", _sum("onen[a-z0-9_]*", "of\\s+the")),
    (f"{_W['than']} = 1 and ({_W['thre']} = 1 or ({_W['thed']} = 1 and {_W['er']} = 1))",
     _sum("than", "thre", "thed", "er")),
]


def _hits(posts: str) -> str:
    """The SQL of `search_hits` over a view of posts."""
    found = " union all ".join(
        f"select *, {q} as q, {words} as words from searched where {test}" for q, (test, words) in enumerate(_TESTS))
    return f"""
    , searched as (select *, lower(coalesce(post_title, '') || ' ' || coalesce(post_body, '')) as t from {posts})
    , found as ({found})
    , cells as (
      select post_id, (cast(substr(post_subreddit, 4) as int) * 3 + q) * 4 + s as cell, q, sort_name,
        cast(case s when 0 then words when 1 then post_score when 2 then post_created_utc else post_num_comments end as double) as m1,
        case s when 0 then post_score else 0 end as m2
      from found, (values (0, 'relevance'), (1, 'top'), (2, 'new'), (3, 'comments')) as sorts(s, sort_name))
    , hits as (
      select * from (select *, row_number() over (partition by cell order by m1 desc, m2 desc, post_id) as rk from cells)
      where rk <= {K})
    """


@catalog.add("search_boolean_keywords", f"""
    , searched as (select post_id, post_subreddit, lower(coalesce(post_title, '') || ' ' || coalesce(post_body, '')) as t from doc_posts)
    select post_id, post_subreddit, {_TESTS[0][0]} as q0, {_TESTS[1][0]} as q1, {_TESTS[2][0]} as q2 from searched""")
def search_boolean_keywords(spark, sf_dir):
    text = searchable("post_title", "post_body")
    return doc_posts(spark, sf_dir).select(
        "post_id", "post_subreddit", *[q.matches(text).alias(f"q{i}") for i, q in enumerate(QUERIES)])


@catalog.add("search_in_community", f"""
    , searched as (select post_id, post_subreddit, lower(coalesce(post_title, '') || ' ' || coalesce(post_body, '')) as t from doc_posts)
    select post_id, post_subreddit from searched where post_subreddit in ('src3', 'src7') and {_TESTS[1][0]}""")
def search_in_community(spark, sf_dir):
    posts = doc_posts(spark, sf_dir).filter(F.col("post_subreddit").isin("src3", "src7"))
    return posts.filter(QUERIES[1].matches(searchable("post_title", "post_body"))).select("post_id", "post_subreddit")


@catalog.add("search_time_window", """
    select event_id, user_id, event_type, value from events where ts >= timestamp '2024-01-15 00:00:00' and ts <= timestamp '2024-01-22 00:00:00'""")
def search_time_window(spark, sf_dir):
    recent = within_window(F.col("ts"), datetime(2024, 1, 22), "week", epoch=False)
    return table(spark, sf_dir, "events").filter(recent).select("event_id", "user_id", "event_type", "value")


@catalog.add("search_grid_topk", _hits("doc_posts") + """
    select post_id, cell, cast(rk as int) as rank, q as query_no, sort_name as extraction_sort from hits""")
def search_grid_topk(spark, sf_dir):
    hits = searching.search_hits(doc_posts(spark, sf_dir), GRID, K)
    number = F.array_position(F.array(*[F.lit(str(q)) for q in QUERIES]), F.col("extraction_query")) - 1
    return hits.select("post_id", "cell", "rank", number.cast("int").alias("query_no"), "extraction_sort")


@catalog.add("search_first_seen_posts", _hits("(select * from doc_posts where post_created_utc >= 1704067200 + 86400 * 7 and post_created_utc <= 1736294400)") + """
    select post_id, cell, cast(rk as int) as rank, sort_name as extraction_sort from (
      select *, row_number() over (partition by post_id order by cell, rk) as rn from hits) where rn = 1""")
def search_first_seen_posts(spark, sf_dir):
    hits = searching.search_hits(doc_posts(spark, sf_dir), GRID, K, as_of=datetime(2025, 1, 8), window="year")
    return searching.first_seen_posts(hits).select("post_id", "cell", "rank", "extraction_sort")


def _stored_seen(posts):
    """The found posts as a run stores them, narrow; their number is then known before they are joined."""
    path = work_dir(posts.sparkSession, "seen")
    searching.first_seen_posts(searching.search_hits(posts, GRID, K)).select("post_id", "cell", "rank").write.parquet(path)
    return posts.sparkSession.read.parquet(path)


@catalog.add("search_first_seen_comments", _hits("posts_v") + """
    , seen as (select post_id, cell, rk from (
      select *, row_number() over (partition by post_id order by cell, rk) as rn from hits) where rn = 1)
    , filed as (
      select comment_id, post_id, comment_body from comments_base
      union all
      select comment_id, cast(n + 1 as string), comment_body from comments_base)
    select comment_id, post_id, comment_body from (
      select f.*, row_number() over (partition by comment_id order by cell, rk, f.post_id) as rn
      from filed f join seen s on f.post_id = s.post_id) where rn = 1""")
def search_first_seen_comments(spark, sf_dir):
    """Every comment is also filed under the next post, so that two found posts may claim it."""
    seen = _stored_seen(merge_runs(posts_raw(spark, sf_dir), "post_id"))
    once = comments_base(spark, sf_dir)
    filed = once.withColumn("post_id", F.explode(F.array("post_id", (F.col("n") + 1).cast("string"))))
    kept = searching.first_seen_comments(filed, seen, max_seen=GRID.size * K)
    return kept.select("comment_id", "post_id", "comment_body")


@catalog.add("search_comments_of_posts", _hits("posts_v") + """
    select comment_id, post_id, extraction_id from comments_raw where post_id in (select post_id from hits)""")
def search_comments_of_posts(spark, sf_dir):
    seen = _stored_seen(merge_runs(posts_raw(spark, sf_dir), "post_id"))
    found = searching.comments_of(comments_raw(spark, sf_dir), seen, GRID.size * K)
    return found.select("comment_id", "post_id", "extraction_id")


@catalog.add("search_found_posts_wide", _hits("doc_posts") + """
    , seen as (select post_id, sort_name from (
      select *, row_number() over (partition by post_id order by cell, rk) as rn from hits) where rn = 1)
    select p.post_id, p.post_subreddit, p.post_title, p.post_body, s.sort_name as extraction_sort,
      '2025-01-01T00:00:00+00:00' as extraction_time from doc_posts p join seen s on p.post_id = s.post_id""")
def search_found_posts_wide(spark, sf_dir):
    posts = doc_posts(spark, sf_dir)
    wide = searching.with_search_lineage(posts, _stored_seen(posts), "2025-01-01T00:00:00+00:00", GRID, GRID.size * K)
    return wide.select("post_id", "post_subreddit", "post_title", "post_body", "extraction_sort", "extraction_time")


_QUERY_TEXT = "case q " + " ".join(
    "when {} then '{}'".format(n, str(q).replace("'", "''")) for n, q in enumerate(QUERIES)) + " end"


@catalog.add("search_lineage", _hits("doc_posts") + f"""
    , seen as (select post_id, q, sort_name from (
      select *, row_number() over (partition by post_id order by cell, rk) as rn from hits) where rn = 1)
    select post_id, {_QUERY_TEXT} as extraction_query, sort_name as extraction_sort from seen""")
def search_lineage(spark, sf_dir):
    """Which query and order found each post."""
    posts = doc_posts(spark, sf_dir)
    wide = searching.with_search_lineage(posts, _stored_seen(posts), "2025-01-01T00:00:00+00:00", GRID, GRID.size * K)
    return wide.select("post_id", "extraction_query", "extraction_sort")


@catalog.add("running_unique_posts", _hits("doc_posts") + """
    , marked as (select cell, row_number() over (partition by post_id order by cell, rk) as rn from hits)
    select cell, count(*) as hits, count(*) filter (rn = 1) as new_posts,
      cast(sum(count(*) filter (rn = 1)) over (order by cell) as bigint) as unique_posts from marked group by cell""")
def running_unique_posts(spark, sf_dir):
    return searching.running_unique_posts(searching.search_hits(doc_posts(spark, sf_dir), GRID, K))


_SOURCE_POSTS = [
    "conv_id as id", "'src' || cast(conv_id % 20 as string) as community", POST_TITLE_LINE + " as title",
    "text as body", "'https://forum.example/' || cast(conv_id as string) as url", "(conv_id * 37) % 101 as score",
    "cast(conv_id % 100 as double) / 100e0 as upvote_ratio", "(conv_id * 13) % 57 as num_comments",
    "conv_id % 3 as num_crossposts", "conv_id % 2 as total_awards", "conv_id % 4 <> 0 as is_self",
    "conv_id % 9 = 0 as over_18", "conv_id % 50 = 0 as stickied", "conv_id % 25 = 0 as locked",
    "(conv_id % 20 + 1) * 1000 as community_subscribers", "'self.src' || cast(conv_id % 20 as string) as domain",
    "case conv_id % 3 when 0 then '' when 1 then 'News' end as flair",
    "cast(1704067200 + conv_id * 3600 as double) as created_utc",
]
_SOURCE_COMMENTS = [
    "cast(conv_id as string) || '_' || cast(turn as string) as id", "conv_id as post_id", "text as body",
    "turn * 3 - 4 as score", "turn % 2 = 0 as score_hidden",
    "cast(1704067200 + conv_id * 3600 + turn * 60 as double) as created_utc",
]
_ISO = "strftime(make_timestamp(cast(created_utc as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


@catalog.add("project_posts", f"""
    select cast(id as string) as post_id, community as post_subreddit, title as post_title, body as post_body,
      url as post_url, score as post_score, upvote_ratio as post_upvote_ratio, num_comments as post_num_comments,
      num_crossposts as post_num_crossposts, total_awards as post_total_awards, is_self as post_is_self,
      over_18 as post_is_over_18, stickied as post_is_stickied, locked as post_is_locked,
      community_subscribers as post_subreddit_subscribers, domain as post_domain, nullif(flair, '') as post_flair,
      created_utc as post_created_utc, {_ISO} as post_created_utc_date, 'q' as extraction_query,
      'top' as extraction_sort, '2025-01-01T00:00:00+00:00' as extraction_time
    from (select {', '.join(_SOURCE_POSTS)} from conversations where turn = 0)""")
def project_posts(spark, sf_dir):
    source = table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(*_SOURCE_POSTS)
    return searching.project_posts(source, F.lit("q"), F.lit("top"), "2025-01-01T00:00:00+00:00")


_TWO_RUNS = [("20240101000000", 0), ("20240201000000", 5)]


@catalog.add("raw_runs_round_trip", f"""
    , source as (select {', '.join(_SOURCE_POSTS)} from conversations where turn = 0)
    select cast(id as string) as post_id, title as post_title, score as post_score, '20240101000000' as extraction_id from source
    union all select cast(id as string), title, score + 5, '20240201000000' from source""")
def raw_runs_round_trip(spark, sf_dir):
    """Two runs written as runs and read back as one table, the run known from the file name."""
    folder = work_dir(spark, "raw")
    source = table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(*_SOURCE_POSTS)
    for run, more in _TWO_RUNS:
        posts = searching.project_posts(source, F.lit("q"), F.lit("top"), "2025-01-01T00:00:00+00:00")
        write_run(posts.withColumn("post_score", F.col("post_score") + more), folder, "posts", run)
    return read_runs(spark, folder, "posts").select("post_id", "post_title", "post_score", "extraction_id")


@catalog.add("comment_runs_round_trip", f"""
    , source as (select {', '.join(_SOURCE_COMMENTS)} from conversations where turn > 0)
    select id as comment_id, body as comment_body, score as comment_score, '20240101000000' as extraction_id from source
    union all select id, body, score + 5, '20240201000000' from source""")
def comment_runs_round_trip(spark, sf_dir):
    folder = work_dir(spark, "raw-comments")
    comments = project_comments(spark, sf_dir)
    for run, more in _TWO_RUNS:
        write_run(comments.withColumn("comment_score", F.col("comment_score") + more), folder, "comments", run)
    return read_runs(spark, folder, "comments").select("comment_id", "comment_body", "comment_score", "extraction_id")


@catalog.add("empty_run_guard", f"""
    , source as (select {', '.join(_SOURCE_COMMENTS)} from conversations where turn > 0)
    select 'kept' as run, count(*) as n_rows, true as wrote from source
    union all select 'empty', 0, false""")
def empty_run_guard(spark, sf_dir):
    """A run without comments leaves no output; a run with some does."""
    folder, comments = work_dir(spark, "guard"), project_comments(spark, sf_dir)
    out = None
    for name, run, rows in (("kept", "20240101000000", comments), ("empty", "20240201000000", comments.filter("comment_score < -1000"))):
        wrote = write_run(rows, folder, "comments", run)
        held = read_runs(spark, folder, "comments").filter(F.col("extraction_id") == run)
        row = held.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("run"), "n_rows", F.lit(wrote).alias("wrote"))
        out = row if out is None else out.unionAll(row)
    return out


@catalog.add("project_comments", f"""
    select id as comment_id, cast(post_id as string) as post_id, body as comment_body, score as comment_score,
      score_hidden as comment_score_hidden, created_utc as comment_created_utc, {_ISO} as comment_created_utc_date
    from (select {', '.join(_SOURCE_COMMENTS)} from conversations where turn > 0)""")
def project_comments(spark, sf_dir):
    source = table(spark, sf_dir, "conversations").filter("turn > 0").selectExpr(*_SOURCE_COMMENTS)
    return searching.project_comments(source)


_AUTHORS = [
    "cast(c_custkey as string) as author_id", "c_name as author_name", "c_nationkey * 100 as author_post_karma",
    "cast(c_custkey % 1000 as bigint) as author_comment_karma",
    "case when c_custkey % 29 = 0 then null else 1500000000e0 + c_custkey * 50000 end as author_created_utc",
    "c_acctbal < 0 as is_suspended",
]
_AUTHOR_OF = "case n % 3 when 0 then '7' when 1 then cast(n * 11 as string) end as author_id"


@catalog.add("author_enrichment", f"""
    , authors as (select {', '.join(_AUTHORS)} from customer)
    , written as (select comment_id, {_AUTHOR_OF} from comments_base)
    , joined as (select w.comment_id, w.author_id as wanted, a.*, case when a.author_id is null then 'Deleted'
        when is_suspended then 'Suspended' when author_created_utc is null then 'Error' else 'Active' end as st
      from written w left join authors a on w.author_id = a.author_id)
    select comment_id, st as author_status,
      case st when 'Active' then author_id else '[unavailable]' end as author_id,
      case st when 'Active' then author_name when 'Suspended' then '[suspended]' else '[deleted]' end as author_name,
      case st when 'Active' then author_post_karma else 0 end as author_post_karma,
      case st when 'Active' then author_comment_karma else 0 end as author_comment_karma,
      case st when 'Active' then cast(floor((1735689600 - author_created_utc) / 86400) as bigint) else -1 end as account_age_days
    from joined""")
def author_enrichment(spark, sf_dir):
    """A third of the comments by one account, a third without a known one."""
    authors = table(spark, sf_dir, "customer").selectExpr(*_AUTHORS)
    written = comments_base(spark, sf_dir).selectExpr("comment_id", _AUTHOR_OF)
    return searching.with_authors(written, authors, datetime(2025, 1, 1), "comment_id")


@catalog.add("unique_counts", """
    select 'posts' as kind, count(distinct post_id) as n from posts_raw
    union all select 'comments', count(distinct comment_id) from comments_raw""")
def unique_counts(spark, sf_dir):
    return searching.unique_counts(posts_raw(spark, sf_dir), comments_raw(spark, sf_dir))
