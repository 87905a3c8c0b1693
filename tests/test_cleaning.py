import pytest
from pyspark.sql import functions as F

from chorale.functions.text import text_content
from chorale.operators import cleaning
from chorale.operators.joins import hot_keys, spread_join
from chorale.operators.ranking import one_per_key, top_k


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comment_noise(spark):
    bodies = ["", "[deleted]", "[removed]", None, " ", "ok"]
    df = spark.createDataFrame([(b,) for b in bodies], "comment_body string")
    assert {r[0] for r in cleaning.drop_comment_noise(df).collect()} == {" ", "ok"}


def test_post_noise_three_valued(spark):
    noise, real = "[removed]", "text"
    cases = [(noise, ""), (noise, real), (real, noise), (None, real), (None, noise), (noise, None), (None, None), (real, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases, 1)], "i int, post_title string, post_body string")
    assert {r.i for r in cleaning.drop_post_noise(df).collect()} == {2, 3, 4, 8}


def test_text_content_of_missing_post_fields(spark):
    df = spark.createDataFrame([(None, None, "x"), ("t", "b", None)], "post_title string, post_body string, comment_body string")
    rows = [r[0] for r in df.select(text_content()).collect()]
    assert rows == ["Post Title:\n\n\n\nPost Body:\n\n\n\nComment Body:\n\nx", None]


def test_concat_is_strict(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert cleaning.concat_strict(a, a).count() == 2
    for other in ("k bigint, v string", "v string, k int", "k int"):
        with pytest.raises(ValueError):
            cleaning.concat_strict(a, spark.createDataFrame([], other))
    with pytest.raises(ValueError):
        cleaning.concat_strict()


def _runs(spark):
    comments = spark.createDataFrame(
        [("a", "p", "old", "1"), ("a", "p", "[deleted]", "2"), ("b", "p", "kept", "1"), ("b", "p", "newer", "2"), ("c", "q", "solo", "1")],
        "comment_id string, post_id string, comment_body string, extraction_id string")
    posts = spark.createDataFrame(
        [("p", "T", "B", "1"), ("p", "T2", "B2", "2"), ("q", "", "[removed]", "1")],
        "post_id string, post_title string, post_body string, extraction_id string")
    return comments, posts


def test_overlapping_runs_do_not_multiply(spark):
    comments, posts = _runs(spark)
    rows = cleaning.process(comments, posts).select("comment_id", "comment_body", "post_title").collect()
    assert [tuple(r) for r in rows] == [("b", "newer", "T2")]  # a: deleted by its latest run; c: post is noise
    first = cleaning.process(comments, posts, keep="first").select("comment_id", "comment_body").collect()
    assert {tuple(r) for r in first} == {("a", "old"), ("b", "kept")}


def test_merge_runs_is_idempotent_and_layout_independent(spark):
    comments, _ = _runs(spark)
    once = cleaning.merge_runs(comments, "comment_id")
    assert sorted(once.collect()) == sorted(cleaning.merge_runs(once, "comment_id").collect())
    assert sorted(once.collect()) == sorted(cleaning.merge_runs(comments.repartition(7), "comment_id").collect())


def test_one_per_key_cuts_copies_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 1).alias("k"), F.col("id").alias("v"))
    picked = one_per_key(df, ["k"], [F.desc("v")])
    assert [tuple(r) for r in picked.collect()] == [(0, 999)]
    text = plan(picked)
    partial = text.index("row_number(), 1, Partial")
    assert text.index("Exchange hashpartitioning(k") < partial  # printed from the top: the exchange sits above


def test_top_k_over_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                  F.col("id"), (F.col("id") * 7919 % 5003).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    plain = top_k(df, 10, order, by=["g"]).collect()
    spread = top_k(df, 10, order, by=["g"], spread_by="id", buckets=7).collect()
    assert sorted(plain) == sorted(spread)
    assert sum(r.g == "hot" for r in spread) == 10


def test_spread_join_equals_plain_join(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"),
        F.col("id").cast("string").alias("c"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), ("6", 4), (None, 5)], "k string, r int")
    hot = {r.k: r.fan for r in hot_keys(left, "k", 100).collect()}
    assert hot == {"hot": 10}
    for how in ("inner", "left"):
        want = left.join(right, "k", how).select("k", "c", "r")
        have = spread_join(left, right, "k", "c", how, rows_per_task=100).select("k", "c", "r")
        assert have.exceptAll(want).count() == 0 and want.exceptAll(have).count() == 0


def test_hot_post_is_split_over_tasks(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("c"))
    right = spark.createDataFrame([("hot", 1)], "k string, r int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = spread_join(left, right, "k", "c", rows_per_task=100)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in per_task) == 4000
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 3000


def test_filters_sit_below_the_join(spark, tmp_path):
    comments, posts = _runs(spark)
    comments.write.parquet(str(tmp_path / "c"))
    df = cleaning.drop_comment_noise(cleaning.join_posts(spark.read.parquet(str(tmp_path / "c")), posts.drop("extraction_id")))
    scan = plan(df).split("FileScan parquet")[1].split("DataFilters: ")[1].split("Format")[0]
    assert "comment_body" in scan and "[deleted]" in scan


def test_merge_keeps_rows_without_key(spark):
    from chorale.operators.cleaning import merge_runs

    rows = [("a", "1", "x"), ("a", "2", "y"), (None, "1", "p"), (None, "2", "q")]
    merged = merge_runs(spark.createDataFrame(rows, "comment_id string, extraction_id string, body string"), "comment_id")
    assert sorted(r["body"] for r in merged.collect()) == ["p", "q", "y"]


def test_sample_is_full_despite_null_ids(spark):
    from chorale.operators.sampling import seeded_sample

    rows = [(None if k % 5 == 0 else f"c{k}", "t") for k in range(50)]
    df = spark.createDataFrame(rows, "comment_id string, text_content string")
    assert all(seeded_sample(df, n, seed).count() == n for seed in (1, 2) for n in (30, 40))
