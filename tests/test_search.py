from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chorale.functions.terms import all_of, any_of, matched_words, phrase, prefix, term
from chorale.functions.times import age_days, iso_utc, utc_timestamp, window_start, within_window
from chorale.operators import searching
from chorale.schema import AUTHORS, RAW_POSTS


def hits(spark, query, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i for r in df.filter(query.matches(F.lower("t"))).collect()}


def test_words_prefixes_and_phrases(spark):
    texts = ["Gaza today", "gazans", "pro-palestine", "Palestinian", "war\ncrime", "warcrime", "anti-semitism", "UN.", "unit", "gaza_x"]
    assert hits(spark, term("gaza"), texts) == {0}
    assert hits(spark, prefix("palestin"), texts) == {2, 3}
    assert hits(spark, phrase("war crime"), texts) == {4}
    assert hits(spark, phrase("anti-semit", open_end=True), texts) == {6}
    assert hits(spark, term("UN"), texts) == {7}


def test_groups(spark):
    query = all_of(any_of("gaza", prefix("palestin")), any_of("war", all_of("aid", "un")))
    texts = ["gaza war", "gaza aid", "palestinian aid, UN", "war", "GAZA: WAR"]
    assert hits(spark, query, texts) == {0, 2, 4}
    assert str(query) == "((gaza OR palestin*) AND (war OR (aid AND un)))"
    assert str(phrase("hate speech")) == '"hate speech"'


def test_group_needs_parts():
    with pytest.raises(ValueError):
        any_of()


def test_words_are_taken_literally(spark):
    assert hits(spark, any_of("c++", phrase("a.b (c)"), "été"), ["C++ code", "c", "a.b (c)", "axb (c)", "l'été", "ete"]) == {0, 2, 4}
    with pytest.raises(ValueError):
        term(" ")


def test_word_edges_are_ascii(spark):
    assert hits(spark, term("rep"), ["éreprep", "é rep", "érep", "rep"]) == {1, 2, 3}


def test_matched_words_counts_different_words(spark):
    query = any_of("a1", "b1", all_of("a1", "c1"))
    df = spark.createDataFrame([("a1 a1 b1",), ("c1",), ("x",)], "t string")
    assert [r[0] for r in df.select(matched_words(query, F.col("t"))).collect()] == [2, 1, 0]


def test_iso_stamp_in_any_session_zone(spark):
    df = spark.createDataFrame([(1704067200.0,), (1704067200.5,), (None,)], "s double")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in df.select(iso_utc(F.col("s"))).collect()]
        assert got == ["2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.500000+00:00", None]
        assert df.select(F.unix_micros(utc_timestamp(F.col("s")))).first()[0] == 1704067200 * 1_000_000
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("window,start", [
    ("hour", datetime(2024, 2, 28, 23)), ("day", datetime(2024, 2, 28)), ("week", datetime(2024, 2, 22)),
    ("month", datetime(2024, 1, 29)), ("year", datetime(2023, 2, 28)), ("all", None)])
def test_window_start(window, start):
    assert window_start(datetime(2024, 2, 29), window) == start


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1704067200.0,), (1.0,)], "post_created_utc double").write.parquet(path)
    df = spark.read.parquet(path).filter(within_window(F.col("post_created_utc"), datetime(2024, 1, 2), "week"))
    assert df.count() == 1
    assert "GreaterThanOrEqual(post_created_utc" in df._jdf.queryExecution().executedPlan().toString()


def _posts(spark):
    rows = [("p1", "A", "gaza war", 5, 1, 10.0), ("p2", "A", "gaza", 9, 2, 20.0), ("p3", "B", "gaza", 1, 3, 30.0),
            ("p4", "C", "gaza", 7, 4, 40.0), ("p5", "A", "other", 99, 9, 50.0)]
    return spark.createDataFrame(rows, "post_id string, post_subreddit string, post_title string, post_score bigint, "
                                       "post_num_comments bigint, post_created_utc double").withColumn("post_body", F.lit(None).cast("string"))


def test_grid_order_ranks_and_lineage(spark):
    grid = searching.SearchGrid(("B", "A"), (any_of("gaza", "war"), term("gaza")), ("relevance", "top"))
    got = searching.search_hits(_posts(spark), grid, 1).orderBy("cell").collect()
    assert [(r.cell, r.post_id, r.extraction_sort) for r in got] == [
        (0, "p3", "relevance"), (1, "p3", "top"), (2, "p3", "relevance"), (3, "p3", "top"),
        (4, "p1", "relevance"), (5, "p2", "top"), (6, "p2", "relevance"), (7, "p2", "top")]
    assert got[0].extraction_query == "(gaza OR war)"
    seen = searching.first_seen_posts(searching.search_hits(_posts(spark), grid, 1)).orderBy("post_id").collect()
    assert [(r.post_id, r.cell) for r in seen] == [("p1", 4), ("p2", 5), ("p3", 0)]


def test_limit_counts_before_first_seen(spark):
    """A cell's limit is spent on posts already seen, too."""
    grid = searching.SearchGrid(("A",), (term("gaza"),), ("top", "new"))
    seen = searching.first_seen_posts(searching.search_hits(_posts(spark), grid, 1)).collect()
    assert [(r.post_id, r.extraction_sort) for r in seen] == [("p2", "top")]


def test_unknown_sort_and_missing_as_of(spark):
    with pytest.raises(ValueError):
        searching.SearchGrid(("A",), (term("x"),), ("best",))
    with pytest.raises(ValueError):
        searching.search_hits(_posts(spark), searching.SearchGrid(("A",), (term("x"),)), 1, window="year")


def test_flair_and_projection(spark):
    fields = ("id community title body url score upvote_ratio num_comments num_crossposts total_awards is_self over_18 "
              "stickied locked community_subscribers domain flair created_utc").split()
    base = ["x", "c", "t", "b", "u", 1, 0.5, 2, 0, 0, True, False, False, False, 10, "d", "", 1704067200.0]
    rows = [tuple([*base[:16], f, base[17]]) for f in ("", None, "News")]
    kinds = "string string string string string bigint double bigint bigint bigint boolean boolean boolean boolean bigint string string double".split()
    df = spark.createDataFrame(rows, ", ".join(f"{f} {k}" for f, k in zip(fields, kinds)))
    out = searching.project_posts(df, F.lit("q"), F.lit("top"), "now")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in RAW_POSTS]
    assert [r.post_flair for r in out.collect()] == [None, None, "News"]


def test_author_defaults(spark):
    authors = spark.createDataFrame(
        [("1", "ann", 3, 4, 1704067200.0, False), ("2", "bob", 3, 4, 1704067200.0, True), ("3", "cy", 3, 4, None, False)],
        AUTHORS)
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None), ("e", "9")], "comment_id string, author_id string")
    got = {r.comment_id: r for r in searching.with_authors(rows, authors, datetime(2024, 1, 3, 12), "comment_id").collect()}
    assert [got[k].author_status for k in "abcde"] == ["Active", "Suspended", "Error", "Deleted", "Deleted"]
    assert (got["a"].author_name, got["a"].account_age_days) == ("ann", 2)
    assert (got["b"].author_name, got["b"].author_id, got["b"].account_age_days) == ("[suspended]", "[unavailable]", -1)
    assert got["d"].author_name == "[deleted]" and got["d"].author_post_karma == 0
    assert spark.range(1).select(age_days(F.lit(0.0), datetime(1970, 1, 2))).first()[0] == 1


def test_preset_queries(spark):
    from chorale import presets

    texts = ["Israel and the war", "war in gaza", "gaza beach", "war", "ANTI-SEMITIC trope about Israel", "palestinefree islamophobia"]
    found = {q: hits(spark, getattr(presets, q), texts) for q in ("SECURITY", "GEOPOLITICAL", "MEDIA", "ANY_MENTION")}
    assert found == {"SECURITY": {0, 1}, "GEOPOLITICAL": {4}, "MEDIA": {4, 5}, "ANY_MENTION": {1, 2, 5}}
    assert (len(presets.COMMUNITIES), len(presets.QUERIES)) == (18, 5)


@pytest.mark.parametrize("bound", [None, 10])
def test_comments_of_found_posts(spark, bound):
    seen = spark.createDataFrame([("p1", 3, 1), ("p2", 0, 1)], "post_id string, cell int, rank int")
    filed = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1"), ("c", "p9"), ("d", None)], "comment_id string, post_id string")
    got = searching.first_seen_comments(filed, seen, bound).select("comment_id", "post_id").collect()
    assert sorted(tuple(r) for r in got) == [("a", "p2"), ("b", "p1")]
    of = searching.comments_of(filed, seen.unionAll(seen), bound).select("comment_id", "post_id").collect()
    assert sorted(tuple(r) for r in of) == [("a", "p1"), ("a", "p2"), ("b", "p1")]


def test_only_id_and_cell_meet_the_posts(spark, tmp_path):
    posts = spark.range(50).select(
        F.concat(F.lit("p"), "id").alias("post_id"), F.lit("A").alias("post_subreddit"), F.lit("war and peace").alias("post_title"),
        F.lit("").alias("post_body"), F.col("id").alias("post_score"), F.lit(0).cast("bigint").alias("post_num_comments"),
        F.col("id").cast("double").alias("post_created_utc"))
    grid = searching.SearchGrid(("A",), (term("nothing"), term("war"), term("peace")), ("new", "top"))
    hits = searching.search_hits(posts, grid, 5)
    searching.first_seen_posts(hits).select("post_id", "cell", "rank").write.parquet(str(tmp_path / "seen"))
    wide = searching.with_search_lineage(posts, spark.read.parquet(str(tmp_path / "seen")), "t", grid)
    got = {(r.post_id, r.extraction_query, r.extraction_sort) for r in wide.collect()}
    want = {(r.post_id, r.extraction_query, r.extraction_sort) for r in searching.first_seen_posts(hits).collect()}
    assert got == want and len(got) == 5
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<post_id:string,cell:int>" in plan
