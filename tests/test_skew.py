"""A third of the rows under one key, on every operator that groups or joins; against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chorale.functions.terms import term
from chorale.operators import cleaning, sampling, scoring, searching

N = 3000


@pytest.fixture(scope="module")
def runs():
    """(comment_id, post_id, body, run): a third copies of one comment, a third under one post."""
    rng = random.Random(7)
    rows = []
    for i in range(N):
        hot = i % 3
        cid = "c-hot" if hot == 0 else f"c{rng.randrange(N // 2)}"
        body = rng.choice(["", "[deleted]", None, "text", "more text"])
        rows.append((cid, "p-hot" if hot == 1 else f"p{rng.randrange(40)}", body, f"{rng.randrange(10**6):07d}"))
    return rows


def brute_force(rows, posts):
    latest = {}
    for cid, pid, body, run in rows:
        if cid not in latest or run > latest[cid][2]:
            latest[cid] = (pid, body, run)
    return sorted((cid, pid, posts[pid], body) for cid, (pid, body, _) in latest.items()
                  if body not in (None, "", "[deleted]") and pid in posts)


def test_process(spark, runs):
    runs = list({(c, r): (c, p, b, r) for c, p, b, r in runs}.values())  # no two copies of one run
    posts = {f"p{i}": f"title {i}" for i in range(0, 40, 2)} | {"p-hot": "hot"}
    comments = spark.createDataFrame(runs, "comment_id string, post_id string, comment_body string, extraction_id string").repartition(6)
    table = spark.createDataFrame([(p, t, "b", r) for p, t in posts.items() for r in ("1", "2")],
                                  "post_id string, post_title string, post_body string, extraction_id string")
    for rows_per_task in (50, 10**6):
        got = cleaning.process(comments, table, rows_per_task=rows_per_task).select(
            "comment_id", "post_id", "post_title", "comment_body").collect()
        assert sorted(map(tuple, got)) == brute_force(runs, posts)


def test_sample_of_a_pool_with_a_hot_id(spark, runs):
    pool = spark.createDataFrame([(c,) for c, *_ in runs], "comment_id string").repartition(5)
    for n in (10, 1200):
        got = sampling.seeded_sample(pool, n, 3)
        want = pool.orderBy(F.md5(F.concat_ws(":", "comment_id", F.lit("3"))), "comment_id").limit(n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_search_with_a_hot_community(spark):
    posts = spark.range(N).select(
        F.concat(F.lit("p"), "id").alias("post_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("post_subreddit"),
        F.lit("war").alias("post_title"), F.lit("").alias("post_body"), (F.col("id") * 31 % 997).alias("post_score"),
        F.lit(0).cast("bigint").alias("post_num_comments"), F.col("id").cast("double").alias("post_created_utc"))
    grid = searching.SearchGrid(("hot", "s1", "s2"), (term("war"),), ("top", "new"))
    got = {(r.cell, r["rank"]): r.post_id for r in searching.search_hits(posts, grid, 50).collect()}
    rows = posts.collect()
    for ci, community in enumerate(grid.communities):
        mine = [r for r in rows if r.post_subreddit == community]
        for si, key in enumerate((lambda r: (-r.post_score, r.post_id), lambda r: (-r.post_created_utc, r.post_id))):
            want = [r.post_id for r in sorted(mine, key=key)[:50]]
            assert [got[(ci * 2 + si, i + 1)] for i in range(len(want))] == want
    assert len(got) == 300


def test_queue_with_a_hot_id(spark, runs):
    texts = spark.createDataFrame([(c, b or "") for c, _, b, _ in runs], "comment_id string, text_content string")
    done = spark.createDataFrame([(f"c{i}",) for i in range(0, N, 2)], "comment_id string")
    queue = scoring.resume_queue(scoring.unique_texts(texts), done)
    want = {c for c, *_ in runs} - {f"c{i}" for i in range(0, N, 2)}
    assert sorted(r.comment_id for r in queue.collect()) == sorted(want)
