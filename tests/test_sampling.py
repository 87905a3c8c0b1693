import pytest
from pyspark.sql import functions as F

from chorale.operators import sampling


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(3000).select(F.concat(F.lit("c"), "id").alias("comment_id"), F.col("id").alias("v"))


def ids(df):
    return sorted(r.comment_id for r in df.collect())


@pytest.mark.parametrize("n", [1, 40, 1000, 1001, 2500, 5000])
def test_exact_size_and_reference_order(spark, pool, n):
    got = sampling.seeded_sample(pool, n, 7, rank="r")
    want = pool.orderBy(F.md5(F.concat(F.col("comment_id"), F.lit(":7"))), "comment_id").limit(n)
    assert ids(got) == ids(want)
    assert sorted(r.r for r in got.collect()) == list(range(1, min(n, 3000) + 1))


def test_layout_and_seed(spark, pool):
    a = ids(sampling.seeded_sample(pool, 40, 7))
    assert a == ids(sampling.seeded_sample(pool.repartition(13), 40, 7))
    assert a != ids(sampling.seeded_sample(pool, 40, 8))


@pytest.mark.parametrize("n", [50, 1500])
def test_copies_of_an_id_do_not_multiply(spark, pool, n):
    hot = spark.range(3000).select(F.lit("c1").alias("comment_id"), F.col("id").alias("v"))
    assert sampling.seeded_sample(pool.unionAll(hot), n, 7).count() == n


def test_quotas():
    assert sampling.random_quotas(10, 0.85, 0, 0) == sampling.Quotas(train=2, val=8)
    assert sampling.random_quotas(10, 0.85, 3, 1) == sampling.Quotas(train=0, val=7)


def test_split_with_manual_picks(spark, pool):
    train_ids, val_ids = ["c1", "c2", "c3", "nope"], ["c4"]
    split = sampling.label_split(pool, 10, 123, 0.85, train_ids, val_ids).cache()
    counts = {(r.split, r.origin): r.n_rows for r in sampling.split_counts(split).collect()}
    assert counts == {("train", "manual"): 3, ("val", "manual"): 1, ("val", "random"): 7}
    train, val = (ids(split.filter(F.col("split") == s)) for s in ("train", "val"))
    assert not set(train) & set(val) and train == ["c1", "c2", "c3"]
    assert ids(sampling.missing_ids(pool, train_ids)) == ["nope"]


def test_short_pool_fills_train_first(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "comment_id string")
    split = sampling.label_split(pool, 10, 1, 0.85)
    assert {(r.split, r.origin): r.n_rows for r in sampling.split_counts(split).collect()} == {("train", "random"): 2, ("val", "random"): 2}


def test_null_ids_leave_the_pool(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "comment_id string")
    assert ids(sampling.without_ids(df, sampling.id_frame(spark, ["a"]))) == ["b"]
    assert ids(sampling.without_ids(df, sampling.id_frame(spark, []))) == ["a", "b"]


def test_label_sheet_has_empty_slots(spark, pool):
    sheet = sampling.label_sheet(pool, ["comment_id", "post_title"], ["political_stance"])
    assert sheet.columns == ["comment_id", "political_stance"]
    assert sheet.filter(F.col("political_stance").isNotNull()).count() == 0


def test_large_sample_does_not_sort_the_pool(spark, pool):
    text = sampling.seeded_sample(pool, 2000, 7)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "TakeOrdered" not in text
    # The one task of its own sees the digit groups, not the rows.
    assert text.count("SinglePartition") == 1
