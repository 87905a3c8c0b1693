"""Shapes of the plans of all registered queries."""

import pytest

import __spark_entry__ as entry

# A user's scorer or embedder runs in Python workers.
PYTHON_QUERIES = {"score_pandas_scorer", "score_prompted_features", "embed_texts"}
STORED = {"stream_incremental_scores", "stream_early_comments", "stream_replay", "score_store_resume", "commit_restart",
          "embed_resume", "merge_increment", "label_sheet_round_trip", "raw_runs_round_trip"}
# The corpus operators have plan tests of their own.
NAMES = [n for c in entry._CATALOGS for n in c.queries if n not in STORED]


def plan(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_join_and_no_python(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_QUERIES:
        assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name,columns", [
    ("sample_pool", "struct<doc_id:bigint,n_chars:bigint>"),
    ("unique_counts", "struct<conv_id:bigint,turn:bigint>"),
    ("relevant_share", "struct<doc_id:bigint>"),
    ("search_time_window", "struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>"),
])
def test_scans_read_what_is_used(spark, sf_dir, name, columns):
    assert f"ReadSchema: {columns}" in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name,pushed", [
    ("search_time_window", "GreaterThanOrEqual(ts"), ("search_grid_topk", "In(source"), ("clean_posts", "EqualTo(turn,0)")])
def test_filters_reach_the_scan(spark, sf_dir, name, pushed):
    assert pushed in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["dedup_latest_comments", "processed_text_content", "search_grid_topk",
                                  "search_first_seen_comments", "sample_split"])
def test_groups_are_cut_down_before_the_shuffle(spark, sf_dir, name):
    assert "row_number(), " in plan(spark, sf_dir, name) and ", Partial" in plan(spark, sf_dir, name)

