import json
import sys
import types
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chorale.functions.terms import term
from chorale.operators import assembly, explore, scoring
from chorale.operators.cleaning import merge_runs
from chorale.operators.searching import SearchGrid
from chorale.plans import stages
from chorale.registry import RELEVANCE, SENTIMENT, TONE
from chorale.schema import RAW_COMMENTS, RAW_POSTS
from chorale.sources import files, labels, merged, raw
from chorale.streaming.scoring import clean_stream, landing_stream, score_arrivals, score_stream, settle

R = RELEVANCE.name


def posts(spark, rows):
    """rows: (post_id, title, body)"""
    full = []
    for pid, title, body in rows:
        by_name = {"post_id": pid, "post_subreddit": "A", "post_title": title, "post_body": body, "post_score": 1,
                   "post_num_comments": 1, "post_created_utc": 1704067200.0}
        full.append(tuple(by_name.get(f) for f in RAW_POSTS.fieldNames()))
    return spark.createDataFrame(full, RAW_POSTS)


def comments(spark, rows):
    """rows: (comment_id, post_id, body)"""
    return spark.createDataFrame([(c, p, b, 1, False, 1704067200.0, "d") for c, p, b in rows], RAW_COMMENTS)


def ask(queue):
    return scoring.call_columns(queue, scoring.each(
        {R: lambda t: F.concat(F.lit(f'{{"{R}": '), F.length(t) % 6, F.lit("}"))}))


def test_runs_round_trip(spark, tmp_path):
    folder = str(tmp_path / "raw")
    assert raw.write_run(posts(spark, [("p", "t", "b")]), folder, "posts", "20240101000000")
    assert raw.write_run(posts(spark, [("p", "t2", "b")]), folder, "posts", "20240201000000")
    assert not raw.write_run(comments(spark, []), folder, "comments", "20240101000000")
    assert raw.write_run(comments(spark, [("c", "p", "x")]), folder, "comments", "20240201000000")
    got = raw.read_runs(spark, folder, "posts")
    assert {(r.post_title, r.extraction_id) for r in got.collect()} == {("t", "20240101000000"), ("t2", "20240201000000")}
    one = raw.read_runs(spark, folder, "posts", "20240201000000")
    assert [r.post_title for r in one.collect()] == ["t2"]
    assert raw.list_runs(spark, folder, "comments") == ["comments_data_raw_20240201000000.parquet"]
    with pytest.raises(Exception):  # a run is never written twice
        raw.write_run(posts(spark, [("p", "t", "b")]), folder, "posts", "20240101000000")


def test_single_file_runs_and_strict_schema(spark, tmp_path):
    folder = tmp_path / "raw"
    posts(spark, [("p", "t", "b")]).coalesce(1).write.parquet(str(tmp_path / "w"))
    folder.mkdir()
    part = next((tmp_path / "w").glob("part-*"))
    (folder / "posts_data_raw_20240101000000.parquet").write_bytes(part.read_bytes())
    assert raw.read_runs(spark, str(folder), "posts").first().extraction_id == "20240101000000"
    posts(spark, [("q", "t", "b")]).drop("post_flair").write.parquet(str(folder / "posts_data_raw_20240102000000.parquet"))
    with pytest.raises(ValueError, match="post_flair"):
        raw.read_runs(spark, str(folder), "posts")
    with pytest.raises(FileNotFoundError):
        raw.read_runs(spark, str(folder), "comments")


def test_table_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError, match="no table"):
        files.read_table(spark, path)
    files.write_table(spark.range(2), path)
    with pytest.raises(ValueError, match="input"):
        files.write_table(files.read_table(spark, path), path, inputs=(path,))
    assert not files.write_once(spark.range(9), path) and files.read_table(spark, path).count() == 2
    assert files.write_once(spark.range(1), str(tmp_path / "u"))


def test_a_failed_write_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.range(3), path)
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        files.write_table(broken, path)
    assert files.read_table(spark, path).count() == 3 and files.list_names(spark, str(tmp_path)) == ["t"]
    files.write_table(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4
    # A replacement that died between its two renames.
    (tmp_path / "t").rename(tmp_path / ".t.old")
    assert files.read_table(spark, path).count() == 4
    assert not list(tmp_path.glob(".t.draft*"))


def test_run_ids_are_whole(spark, tmp_path):
    folder = str(tmp_path / "raw")
    for run in ("20240101000000", "20240102000000"):
        raw.write_run(posts(spark, [("p" + run, "t", "b")]), folder, "posts", run)
    assert raw.read_runs(spark, folder, "posts", "20240102000000").count() == 1
    with pytest.raises(FileNotFoundError, match="202401"):
        raw.read_runs(spark, folder, "posts", "202401")
    for run in ("20240103000000", "20240104000000"):
        posts(spark, [("q", "t", "b")]).drop("post_url").write.parquet(f"{folder}/posts_data_raw_{run}.parquet")
    with pytest.raises(ValueError) as told:  # the verdict names every run at fault
        raw.read_runs(spark, folder, "posts")
    assert "20240103000000" in str(told.value) and "20240104000000" in str(told.value) and "post_url" in str(told.value)


def rows_of_run(spark, run, rows):
    return spark.createDataFrame([(k, v, run) for k, v in rows], "comment_id string, v int, extraction_id string")


def test_increments_equal_the_full_merge(spark, tmp_path):
    table = str(tmp_path / "m")
    runs = {"1": [("a", 1), ("b", 1), (None, 1), ("c", 1)], "2": [("a", 2), (None, 2)], "3": [("d", 3)]}
    everything = None
    for run, rows in runs.items():
        new = rows_of_run(spark, run, rows)
        everything = new if everything is None else everything.unionByName(new)
        touched = merged.merge_increment(new, table, run, "comment_id", buckets=8)
        assert len(touched) <= len(rows)
        assert merged.merge_increment(new, table, run, "comment_id", buckets=8) == []
    want = merge_runs(everything, "comment_id")
    assert sorted(map(str, merged.read_merged(spark, table).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    held = {b: r for b, r, _ in merged.manifest(spark, table) if b >= 0}
    only_d = rows_of_run(spark, "9", [("d", 9)])
    touched = merged.merge_increment(only_d, table, "9", "comment_id", buckets=64)  # the table keeps its 8
    after = {b: r for b, r, _ in merged.manifest(spark, table) if b >= 0}
    assert len(touched) == 1 and {b for b in after if after[b] != held.get(b)} == set(touched)
    assert sorted(p.name for p in (tmp_path / "m" / "run=9").glob("bucket=*")) == [f"bucket={touched[0]}"]
    part = merged.read_merged(spark, table, only_d, "comment_id")
    assert "run=9" in str(part.inputFiles()) and {r.v for r in part.filter("comment_id = 'd'").collect()} == {9}
    assert merged.drop_replaced(spark, table) and merged.read_merged(spark, table).count() == 6


def test_an_increment_that_dies_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "m")
    merged.merge_increment(rows_of_run(spark, "1", [("a", 1)]), table, "1", "comment_id", buckets=4)
    broken = rows_of_run(spark, "2", [("a", 2)]).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        merged.merge_increment(broken, table, "2", "comment_id")
    assert [r.v for r in merged.read_merged(spark, table).collect()] == [1]
    merged.merge_increment(rows_of_run(spark, "2", [("a", 2)]), table, "2", "comment_id")
    assert [r.v for r in merged.read_merged(spark, table).collect()] == [2]


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, column in (("base_b", "text_content"), ("rel_b", R)):
            spark.sql(f"drop table if exists {name}")
            df = spark.range(100).select(F.col("id").cast("string").alias("comment_id"), F.col("id").cast("int").alias(column))
            files.write_bucketed(df, name, 4)
        wide = assembly.join_features(spark.table("base_b"), {R: spark.table("rel_b")})
        assert wide.count() == 100
        assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists base_b")
        spark.sql("drop table if exists rel_b")


def test_sheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "sheet.json")
    df = spark.createDataFrame([("a", "é \"x\"\n"), ("b", "y")], "comment_id string, text_content string")
    labels.write_sheet(df, path, [R, TONE.name])
    part = next((tmp_path / "sheet.json").glob("part-*"))
    text = part.read_text(encoding="utf-8")
    assert [json.loads(line) for line in text.splitlines()] == [{"comment_id": "a", "text_content": "é \"x\"\n", R: None, TONE.name: None},
                                {"comment_id": "b", "text_content": "y", R: None, TONE.name: None}]
    assert "é" in text and "\n" in text
    assert [tuple(r) for r in labels.read_sheet(spark, path, [R], ["comment_id"]).orderBy("comment_id").collect()] == [
        ("a", None), ("b", None)]
    filled = tmp_path / "filled.json"
    filled.write_text(json.dumps([{"comment_id": "a", "text_content": "t", R: 3}, {"comment_id": "b", "text_content": "u", R: None}]))
    rows = labels.read_sheet(spark, str(filled), [R]).orderBy("comment_id").collect()
    assert [(r.comment_id, r[R], r.post_title) for r in rows] == [("a", "3", None), ("b", None, None)]
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    assert labels.read_sheet(spark, str(empty), [R]).count() == 0
    with pytest.raises(FileNotFoundError):
        labels.read_sheet(spark, str(tmp_path / "none.json"), [R])
    assert not labels.sheets_exist(spark, path, str(tmp_path / "none.json"))


def test_explore(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("c", None)], f"comment_id string, {R} int")
    assert {tuple(r) for r in explore.value_counts(df, R).collect()} == {(5, 1), (1, 1), (None, 1)}
    assert tuple(explore.share_at_least(df, R, 3).first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(explore.share_at_least(df.filter("false"), R, 3).first()) == (0, 0, None)
    assert explore.first_value(explore.lookup(df, comment_id="a"), R) == 5
    assert explore.first_value(df.filter("false"), R) is None
    assert [r.comment_id for r in explore.head(df, ["comment_id"], 2).collect()] == ["a", "b"]


def test_relevance_filter_drops_unscored_and_failed(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "comment_id string")
    scores = spark.createDataFrame([("a", 3), ("b", 2), ("c", -1)], f"comment_id string, {R} int")
    kept = assembly.relevant_only(base, scores)
    assert [r.comment_id for r in kept.collect()] == ["a"]
    assert "LeftOuter" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_feature_join_is_idempotent(spark):
    base = spark.createDataFrame([("a",), ("b",)], "comment_id string")
    tables = {R: spark.createDataFrame([("a", 3)], f"comment_id string, {R} int")}
    once = assembly.join_features(base, tables)
    assert assembly.join_features(once, tables) is once and once.count() == 2


def test_whole_chain(spark, tmp_path):
    root = str(tmp_path)
    corpus = posts(spark, [("p1", "gaza", "news"), ("p2", "other", "x"), ("p3", "gaza", "")])
    talk = comments(spark, [("c1", "p1", "one"), ("c2", "p1", "[deleted]"), ("c3", "p3", "three"), ("c4", "p2", "no")])
    grid = SearchGrid(("A",), (term("gaza"),), ("top",))
    for day in (2, 3):  # two runs find the same
        stages.collect(corpus, talk, grid, 10, f"{root}/raw", datetime(2024, 1, day), "week")
    table = stages.process(spark, f"{root}/raw", f"{root}/processed")
    assert sorted(r.comment_id for r in table.collect()) == ["c1", "c3"]
    assert len(table.columns) == 29
    assert {r.extraction_time for r in table.collect()} == {"2024-01-03T00:00:00+00:00"}

    args = (spark, f"{root}/processed", f"{root}/train.json", f"{root}/val.json", [R], 2, 123, 0.5)
    assert stages.draw_samples(*args) and not stages.draw_samples(*args)
    sheet = labels.read_sheet(spark, f"{root}/val.json", [R])
    assert sheet.count() == 1
    val = sheet.withColumn(R, F.lit("9"))
    got = stages.validate(val, [RELEVANCE], ask, f"{root}/val_answers", f"{root}/reports", "r1").collect()
    assert [(r.feature, r.n_rows, r.run) for r in got] == [(R, 1, "r1")]

    stages.generate(table, [RELEVANCE], ask, f"{root}/answers", pilot=(1, 111))
    assert scoring.read_store(spark, f"{root}/answers").count() == 1
    stages.generate(table, [RELEVANCE], ask, f"{root}/answers", pilot=(1, 111))
    assert scoring.read_store(spark, f"{root}/answers").count() == 2
    stages.generate(table, [RELEVANCE], ask, f"{root}/answers")
    assert scoring.read_store(spark, f"{root}/answers").count() == 2
    stages.publish_feature(spark, f"{root}/answers", RELEVANCE, f"{root}/features")
    n = stages.filter_relevant(spark, f"{root}/processed", f"{root}/features/{R}.parquet", f"{root}/relevant")
    want = table.filter(F.length("text_content") % 6 >= 3).count()
    assert n == want
    wide = stages.join_all_features(spark, f"{root}/processed", f"{root}/features", f"{root}/wide")
    assert R in wide.columns and wide.count() == 2


def test_labelled_rows_are_left_out_and_kept_as_truth(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "xx")], "comment_id string, text_content string")
    human = spark.createDataFrame([("a", "t", "5")], f"comment_id string, text_content string, {R} string")
    store, out = str(tmp_path / "s"), str(tmp_path / "f")
    stages.generate(df, [RELEVANCE], ask, store, labelled=human)
    stages.publish_feature(spark, store, RELEVANCE, out, labelled=human)
    rows = spark.read.parquet(f"{out}/{R}.parquet").collect()
    assert {(r.comment_id, r[R], r.origin) for r in rows} == {("a", 5, "human"), ("b", 2, "predicted")}


def test_a_missing_label_leaves_the_row_to_the_scorer(spark):
    sheet = spark.createDataFrame([("a", "5", None), ("b", "??", "Hostile"), (None, "1", "Other")],
                                  f"comment_id string, {R} string, {TONE.name} string")
    pairs = scoring.labelled_pairs(sheet, [RELEVANCE, TONE])
    assert {tuple(r) for r in pairs.collect()} == {("a", R), ("b", TONE.name)}
    assert scoring.labelled_pairs(sheet.select("comment_id"), [RELEVANCE]).count() == 0


def test_missing_manual_ids_are_named(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([("a", "x"), ("b", "y")], "comment_id string, text_content string").write.parquet(table)
    with pytest.warns(UserWarning, match="zz"):
        stages.draw_samples(spark, table, str(tmp_path / "tr"), str(tmp_path / "va"), [R], 2, 1, 0.5, ["zz", "a"])


def test_stream_pays_once(spark, tmp_path):
    land, store, log = str(tmp_path / "land"), str(tmp_path / "store"), []
    schema = "comment_id string, text_content string"

    def counted(queue):
        log.append(queue.count())
        return ask(queue)

    def run(checkpoint="cp"):
        del log[:]
        stream = landing_stream(spark, land, spark.createDataFrame([], schema).schema, files_per_batch=1)
        query = score_stream(stream, store, str(tmp_path / checkpoint), [RELEVANCE], counted)
        query.awaitTermination()
        assert query.exception() is None
        return sum(log), len(log)

    def land_file(ids):
        spark.createDataFrame([(i, "t") for i in ids], schema).coalesce(1).write.mode("append").parquet(land)

    land_file(["a", "b", "b"])
    land_file(["b", "c"])
    assert run() == (3, 2)
    assert run() == (0, 0)
    land_file(["c", "d"])  # c is delivered again
    assert run() == (1, 1)
    assert run("lost-checkpoint")[0] == 0  # every file again, nothing to pay
    ids = [r.comment_id for r in scoring.read_store(spark, store).collect()]
    assert sorted(ids) == ["a", "b", "c", "d"]


def test_replay_after_partial_commit(spark, tmp_path):
    """A batch that died with some answers visible: the replay asks for the rest only."""
    store = str(tmp_path / "store")
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "comment_id string, text_content string")
    scoring.append_answers(ask(df.filter("comment_id = 'a'")), store, [RELEVANCE])
    asked = []

    def counted(queue):
        asked.extend(r.comment_id for r in queue.collect())
        return ask(queue)

    scoring.score_into_store(df, store, [RELEVANCE], counted)
    assert asked == ["b"] and scoring.read_store(spark, store).count() == 2


def test_second_pass_features_share_a_scan(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "comment_id string, text_content string")
    store = str(tmp_path / "s")
    both = lambda q: scoring.call_columns(q, scoring.each(
        {SENTIMENT.name: lambda t: F.lit(f'{{"{SENTIMENT.name}": 0.5}}'), TONE.name: lambda t: F.lit(f'{{"{TONE.name}": "Other"}}')}))
    stages.generate(df, [SENTIMENT, TONE], both, store)
    stages.generate(df, [SENTIMENT, TONE], both, store)
    answers = scoring.read_store(spark, store)
    assert answers.count() == 2
    assert scoring.feature_table(answers, TONE).first()[TONE.name] == "Other"


def test_stream_of_raw_comments(spark, tmp_path):
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    comments(spark, [("c1", "p1", "one"), ("c2", "p1", "[removed]"), ("c3", "p2", "noise post"), ("c4", "p9", "no post")]).write.parquet(land)
    stored = posts(spark, [("p1", "T", None), ("p2", "", "[deleted]")])
    stream = clean_stream(landing_stream(spark, land, RAW_COMMENTS), stored)
    score_stream(stream, store, str(tmp_path / "cp"), [RELEVANCE], ask).awaitTermination()
    rows = scoring.read_store(spark, store).collect()
    n = len("Post Title:\n\nT\n\nPost Body:\n\n\n\nComment Body:\n\none")
    assert [(r.comment_id, r.response) for r in rows] == [("c1", f'{{"{R}": {n % 6}}}')]


def test_early_comments_wait_for_their_post(spark, tmp_path):
    land, store, waiting = (str(tmp_path / n) for n in ("land", "store", "waiting"))
    known, asked = [], []

    def run(batch):
        comments(spark, batch).write.mode("append").parquet(land)
        score_arrivals(landing_stream(spark, land, RAW_COMMENTS), lambda: posts(spark, known), store, waiting,
                       str(tmp_path / "cp"), [RELEVANCE], counted, rows_per_task=2).awaitTermination()
        return sorted(r.comment_id for r in scoring.read_store(spark, store).collect())

    def counted(queue):
        asked.extend(r.comment_id for r in queue.collect())
        return ask(queue)

    assert run([("c1", "p1", "early"), ("c2", "p2", "early"), ("c3", "p3", "never"), ("c4", None, "x")]) == []
    known.append(("p1", "T", "b"))
    assert run([*[(f"h{k}", "p1", "hot") for k in range(7)], ("c5", "p1", "[deleted]")]) == ["c1", *[f"h{k}" for k in range(7)]]
    known.append(("p2", "", "[deleted]"))  # lands as noise: its comment is gone
    assert settle(spark, posts(spark, known), store, waiting, [RELEVANCE], counted) == 1
    known.append(("p3", "T", "b"))
    assert settle(spark, posts(spark, known), store, waiting, [RELEVANCE], counted) == 0
    assert sorted(asked) == ["c1", "c3", *[f"h{k}" for k in range(7)]]


def test_a_batch_opens_only_its_buckets(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.range(300).select(F.col("id").cast("string").alias("comment_id"), F.lit("x").alias("text_content"))
    scoring.score_into_store(df, store, [RELEVANCE], ask)
    one = df.filter("comment_id = '7'")
    plan = scoring.open_queue(one, store, [RELEVANCE])._jdf.queryExecution().executedPlan().toString()
    own = one.select(scoring.bucket_of(scoring.STORE_BUCKETS)).first()[0]
    assert f"bucket IN ({own})" in plan or f"(bucket#" in plan and f" = {own})" in plan
    assert scoring.open_queue(one, store, [RELEVANCE]).count() == 0
    assert scoring.read_store(spark, store).count() == 300 and scoring.store_buckets(spark, store) == scoring.STORE_BUCKETS


def test_a_run_that_died_goes_on_from_its_shares(spark, tmp_path):
    store, log, reads = str(tmp_path / "s"), [], []
    source = spark.range(60).select(F.col("id").cast("string").alias("comment_id"), F.lit("x").alias("text_content"))

    def dying(queue):
        if len(log) == 2 and not reads:
            raise RuntimeError("down")
        log.append(queue.count())
        return ask(queue)

    with pytest.raises(RuntimeError):
        scoring.score_into_store(source, store, [RELEVANCE], dying, save_every=10)
    stored = scoring.read_store(spark, store).count()
    assert stored == sum(log) and len(log) == 2
    reads.append(True)
    # Answers that were stored by a share which died before its mark are not asked for again.
    left = spark.read.parquet(f"{store}_queue/{R}/rows")
    done = {r[0] for r in scoring.read_store(spark, store).select("comment_id").collect()}
    one = next(r for r in left.orderBy("comment_id").collect() if r.comment_id not in done)
    scoring.append_answers(ask(source.filter(F.col("comment_id") == one.comment_id)), store, [RELEVANCE])
    scoring.score_into_store(source, store, [RELEVANCE], dying, save_every=10)
    rows = scoring.read_store(spark, store)
    assert rows.count() == rows.select("comment_id").distinct().count() == 60 and sum(log) == 59
    assert not (tmp_path / "s_queue" / R).exists()


def test_vectors_are_checked_and_paid_for_once(spark, tmp_path):
    store = str(tmp_path / "v")
    df = spark.createDataFrame([("a", "x"), ("b", "nan"), ("c", "short"), ("d", "zero"), ("e", "none")],
                               "comment_id string, text_content string")

    def factory():
        odd = {"nan": [float("nan"), 1.0], "short": [1.0], "zero": [0.0, 0.0], "none": None}
        return lambda texts: [odd.get(t, [3.0, 4.0]) for t in texts]

    assert scoring.embed_into_store(df, store, factory, 2) == 4
    assert scoring.embed_into_store(df, store, factory, 2) == 0
    rows = {r.comment_id: (r.norm, r.fault) for r in scoring.read_vectors(spark, store).collect()}
    assert rows == {"a": (5.0, None), "b": (None, "not finite"), "c": (None, "dimensions"), "d": (None, "zero"),
                    "e": (None, "missing")}
    good = lambda: lambda texts: [[1.0, 0.0] for _ in texts]
    assert scoring.embed_into_store(df, store, good, 2, retry_faults=True) == 0
    assert scoring.vector_table(scoring.read_vectors(spark, store)).count() == 5


def test_published_features_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "comment_id string, text_content string")
    store, out = str(tmp_path / "s"), str(tmp_path / "f")
    stages.generate(df, [RELEVANCE], ask, store)
    assert stages.publish_feature(spark, store, RELEVANCE, out, once=True)
    assert not stages.publish_feature(spark, store, RELEVANCE, out, once=True)


def test_command_line(spark, tmp_path, capsys):
    from chorale.__main__ import main

    def connect():
        """Three for everything; nested, so that it travels to the workers by value."""
        return lambda prompt: '{"content_relevance_score": 3}'

    module = types.ModuleType("cli_model")
    module.connect = connect
    sys.modules["cli_model"] = module
    root = str(tmp_path)
    raw.write_run(posts(spark, [("p", "t", "b")]), f"{root}/raw", "posts", "20240101000000")
    raw.write_run(comments(spark, [(f"c{i}", "p", "x" * i) for i in range(1, 9)]), f"{root}/raw", "comments", "20240101000000")
    main(["process", f"{root}/raw", f"{root}/table"])
    main(["sample", f"{root}/table", f"{root}/t.json", f"{root}/v.json", "--rows", "4", "--ratio", "0.5"])
    rows = [{"comment_id": "c1", "text_content": "t", R: 4}, {"comment_id": "c2", "text_content": "u", R: 2}]
    (tmp_path / "labelled.json").write_text(json.dumps(rows))
    model = ["--model", "cli_model:connect", "--topic", "x", "--tasks", "2"]
    sheet = f"{root}/labelled.json"
    main(["validate", sheet, sheet, f"{root}/va", f"{root}/rep", "--run", "r1", *model])
    gate = ["--passed-in", "r1", "--reports", f"{root}/rep"]
    main(["generate", f"{root}/table", sheet, f"{root}/answers", "--pilot", "3", *gate, *model])
    assert scoring.read_store(spark, f"{root}/answers").count() == 3
    main(["generate", f"{root}/table", sheet, f"{root}/answers", "--commits", "2", *model])
    main(["publish", f"{root}/answers", f"{root}/features"])
    main(["filter", f"{root}/table", f"{root}/features/{R}.parquet", f"{root}/relevant"])
    main(["join", f"{root}/table", f"{root}/features", f"{root}/wide"])
    assert spark.read.parquet(f"{root}/wide").filter(f"{R} = 3").count() == 8
    assert "relevant comments: 8" in capsys.readouterr().out
