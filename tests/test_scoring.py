import json

import pytest
from pyspark.sql import functions as F

from chorale.functions.lexicon import lexicon_scorer
from chorale.functions.responses import cast_label, with_value
from chorale.operators import metrics, scoring
from chorale.operators.prompts import example_list, few_shot_text, prompt_column, prompt_factory
from chorale.registry import FEATURES, RELEVANCE, SENTIMENT, STANCE, TONE, select_features

R, S, T = RELEVANCE.name, SENTIMENT.name, TONE.name


def values(spark, feature, answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, response string")
    rows = with_value(df, feature).orderBy("i").collect()
    return [r[feature.name] for r in rows], [r.is_error for r in rows], [r.out_of_domain for r in rows]


def of(feature, *raw):
    return [f'{{"{feature}": {x}}}' for x in raw]


def test_ordinal_answers(spark):
    good = of(R, "4", '"4"', '" 4 "', "3.7", "-3.7", "true", "7")
    bad = of(R, '"3.7"', "null", "[1]", '"abc"') + [None, "{}", "not json", "[1]", '{"other": 3}']
    got, errors, outside = values(spark, RELEVANCE, good + bad)
    assert got == [4, 4, 4, 3, -3, 1, 7] + [-1] * len(bad)
    assert errors == [False] * len(good) + [True] * len(bad)
    assert outside == [False] * 4 + [True, False, True] + [False] * len(bad)


def test_known_departures(spark):
    """Two equal keys, too large a number and trailing text; see the README."""
    got, _, _ = values(spark, RELEVANCE, [f'{{"{R}": 1, "{R}": 2}}', *of(R, "99999999999"), f'{{"{R}": 4}} trailing'])
    assert got == [-1, -1, 4]


def test_continuous_and_categorical_answers(spark):
    got, errors, outside = values(spark, SENTIMENT, of(S, "-0.45", '"0.5"', "1", "true", "2.5", '"x"', "null", "NaN", '"nan"', '"-inf"') + ["", "{}"])
    assert got == [-0.45, 0.5, 1.0, 1.0, 2.5] + [0.0] * 7
    assert errors == [False] * 5 + [True] * 7 and outside == [False] * 4 + [True] + [False] * 7
    got, errors, outside = values(spark, TONE, of(T, '"Hostile"', '"Angry"', "3", "null") + ["{}"])
    assert got == ["Hostile", "Angry", "3", "ERROR", "ERROR"]
    assert errors == [False] * 3 + [True] * 2 and outside == [False, True, True, False, False]


def test_labels_are_cast_like_numbers(spark):
    df = spark.createDataFrame([("3",), ("3.0",), (" 2 ",), ("x",), ("NaN",), (None,)], "y string")
    assert [r[0] for r in df.select(cast_label(F.col("y"), RELEVANCE)).collect()] == [3, 3, 2, None, None, None]


def test_lexicon_scorers(spark):
    df = spark.createDataFrame([("War, war and PEACE",), ("warfare",), ("",), ("love hate love love",)], "t string")
    ordinal = lexicon_scorer(RELEVANCE, {"topic": ("war", "peace")}, step=1)
    assert [json.loads(r[0])[R] for r in df.select(ordinal(F.col("t"))).collect()] == [3, 0, 0, 0]
    mood = lexicon_scorer(SENTIMENT, {"good": ("love",), "bad": ("hate",)})
    assert [json.loads(r[0])[S] for r in df.select(mood(F.col("t"))).collect()] == [0.0, 0.0, 0.0, 0.5]
    tone = lexicon_scorer(TONE, {"Emotional": ("peace", "love"), "Hostile": ("war", "hate")})
    assert [json.loads(r[0])[T] for r in df.select(tone(F.col("t"))).collect()] == ["Hostile", "Other", "Other", "Emotional"]


def test_few_shot_list_and_prompt(spark):
    train = spark.createDataFrame([("b", "two\n\"q\"", "2"), ("a", "one é", "5"), ("c", "none", None)],
                                  f"comment_id string, text_content string, {R} string")
    text = few_shot_text(train, RELEVANCE)
    assert json.loads(text) == [{"text_content": "one é", R: 5}, {"text_content": 'two\n"q"', R: 2}]
    assert "é" in text
    assert example_list(train.filter("false"), RELEVANCE).first()[0] == "[]"
    blank = train.withColumn("text_content", F.lit(None).cast("string")).filter("comment_id = 'a'")
    assert json.loads(few_shot_text(blank, RELEVANCE)) == [{"text_content": None, R: 5}]
    prompt = train.select(prompt_column(F.col("text_content"), RELEVANCE, "a topic", text)).first()[0]
    assert text in prompt and prompt.index(text) < prompt.index('two\n"q"\n'[-4:]) and "a topic" in prompt
    big = spark.range(501).select(F.col("id").cast("string").alias("comment_id"), F.lit("t").alias("text_content"), F.lit("1").alias(R))
    with pytest.raises(ValueError):
        few_shot_text(big, RELEVANCE, max_examples=500)
    assert len(json.loads(few_shot_text(big, RELEVANCE))) == 501


def flaky():
    """The factory is nested so that it travels to the workers by value."""
    def factory():
        def client(feature, text):
            if text == "boom":
                raise RuntimeError("down")
            if text == "junk":
                return "sorry, no"
            return json.dumps({feature: len(text)})
        return client
    return factory


def texts(spark, rows):
    return spark.createDataFrame(rows, "comment_id string, text_content string")


def test_client_failures_become_sentinels(spark):
    df = texts(spark, [("a", "xyz"), ("b", "boom"), ("c", "junk"), ("d", None)])
    answers = scoring.call_client(df, [RELEVANCE, STANCE], flaky(), tasks=2).withColumn("scored_at", F.current_timestamp())
    got = {r.comment_id: (r[R], r.is_error) for r in scoring.feature_table(answers, RELEVANCE).collect()}
    assert got == {"a": (3, False), "b": (-1, True), "c": (-1, True), "d": (-1, True)}
    assert answers.count() == 8
    with pytest.raises(ValueError, match="3 comments"):
        scoring.require_answers(scoring.feature_table(answers, RELEVANCE))
    good = scoring.feature_table(answers.filter("comment_id = 'a'"), RELEVANCE)
    assert scoring.require_answers(good) is good


def test_model_gets_rubric_examples_and_text(spark):
    def connect():
        return lambda prompt: json.dumps({R: 5 if "[1,2]" in prompt and prompt.endswith("hello\n") else 0})

    factory = prompt_factory(connect, [RELEVANCE], "a topic", {R: "[1,2]"})
    got = scoring.call_client(texts(spark, [("a", "hello"), ("b", "x")]), [RELEVANCE], factory).collect()
    assert {r.comment_id: r.response for r in got} == {"a": f'{{"{R}": 5}}', "b": f'{{"{R}": 0}}'}


def counting_ask(log):
    def ask(queue):
        log.append(queue.count())
        return scoring.call_columns(queue, scoring.each({R: lambda t: F.concat(F.lit(f'{{"{R}": '), F.length(t), F.lit("}"))}))
    return ask


def test_resume_pays_once(spark, tmp_path):
    store, log = str(tmp_path / "s"), []
    df = texts(spark, [("a", "x"), ("b", "xx"), ("b", "xx"), (None, "x")])
    for frame in (df, df, df.unionAll(texts(spark, [("c", "x"), ("d", "x"), ("e", "x")]))):
        scoring.score_into_store(frame, store, [RELEVANCE], counting_ask(log))
    assert log == [2, 0, 3]
    assert sorted(r.comment_id for r in scoring.read_store(spark, store).collect()) == list("abcde")


def test_unique_ids_skip_the_merge(spark, tmp_path):
    df = texts(spark, [("a", "x"), ("b", "x")])
    assert "Window" not in scoring.unique_texts(df, unique=True)._jdf.queryExecution().optimizedPlan().toString()
    store, log = str(tmp_path / "s"), []
    scoring.score_into_store(df, store, [RELEVANCE], counting_ask(log), unique=True)
    assert log == [2]


def test_shares_are_committed_one_by_one(spark, tmp_path):
    store, log = str(tmp_path / "s"), []
    df = spark.range(50).select(F.col("id").cast("string").alias("comment_id"), F.lit("x").alias("text_content"))
    scoring.score_into_store(df, store, [RELEVANCE], counting_ask(log), commits=3)
    assert len(log) == 3 and sum(log) == 50 and min(log) > 0
    assert scoring.read_store(spark, store).select("comment_id").distinct().count() == 50


def test_resume_per_feature(spark, tmp_path):
    df = texts(spark, [("a", "x"), ("b", "x"), ("c", "x")])
    done = spark.createDataFrame([("a", R), ("a", STANCE.name), ("b", R)], "comment_id string, feature string")
    queue = scoring.resume_queue(df, done, [RELEVANCE, STANCE])
    assert {r.comment_id: r.wanted for r in queue.collect()} == {"b": [STANCE.name], "c": [R, STANCE.name]}
    asked = scoring.call_client(queue, [RELEVANCE, STANCE], flaky()).collect()
    assert sorted((r.comment_id, r.feature) for r in asked) == [("b", STANCE.name), ("c", R), ("c", STANCE.name)]


def test_errors_are_retried_on_request(spark, tmp_path):
    store, df = str(tmp_path / "s"), texts(spark, [("a", "x"), ("b", "x")])

    def ask(response):
        return lambda queue: queue.select("comment_id", F.lit(R).alias("feature"),
                                          F.when(F.col("comment_id") == "a", f'{{"{R}": 1}}').otherwise(response).alias("response"))
    scoring.score_into_store(df, store, [RELEVANCE], ask("junk"))
    scoring.score_into_store(df, store, [RELEVANCE], ask(f'{{"{R}": 5}}'))
    assert scoring.read_store(spark, store).count() == 2
    scoring.score_into_store(df, store, [RELEVANCE], ask(f'{{"{R}": 5}}'), retry_errors=True)
    assert scoring.read_store(spark, store).count() == 3
    table = scoring.feature_table(scoring.read_store(spark, store), RELEVANCE, retried=True)
    assert {r.comment_id: r[R] for r in table.collect()} == {"a": 1, "b": 5}


def test_python_sees_only_needed_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    texts(spark, [("a", "x")]).withColumn("wide", F.lit("w")).write.parquet(path)
    text = scoring.call_client(spark.read.parquet(path), [RELEVANCE], flaky())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<comment_id:string,text_content:string>" in text


def test_human_label_wins(spark):
    predicted = spark.createDataFrame([("a", 1), ("b", 2)], f"comment_id string, {R} int")
    human = spark.createDataFrame([("a", 5), ("a", 6), ("c", 4), ("d", None)], f"comment_id string, {R} int")
    got = {(r.comment_id, r[R], r.origin) for r in scoring.labels_and_predictions(predicted, human, RELEVANCE).collect()}
    assert got == {("a", 5, "human"), ("c", 4, "human"), ("b", 2, "predicted")}


def test_embedding_column(spark):
    def factory():
        return lambda batch: [[float(len(t)), 1.0] for t in batch]
    got = scoring.embed(texts(spark, [("a", "xyz")]), factory).first()
    assert got.embedding == [3.0, 1.0]


# --- metrics

def report(spark, feature, rows):
    """rows: (id, label text, value, is_error)"""
    truth = spark.createDataFrame([(r[0], r[1]) for r in rows], f"comment_id string, {feature.name} string")
    guess = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None],
                                  f"comment_id string, {feature.name} {feature.spark_type}, is_error boolean")
    pairs = metrics.compare(truth, {feature.name: guess}, [feature])
    return metrics.report(pairs, [feature]).first()


def test_sentinel_bias(spark):
    got = report(spark, RELEVANCE, [("a", "0", -1, True), ("b", "4", 3, False), ("c", "2", 5, False), ("d", None, 1, False)])
    assert (got.n_rows, got.n_errors) == (3, 1)
    assert got.adjacent_sentinel == pytest.approx(2 / 3) and got.adjacent_strict == pytest.approx(1 / 3)
    assert got.binary_sentinel == pytest.approx(2 / 3) and got.binary_strict == pytest.approx(1 / 3)


def test_missing_prediction_is_an_error(spark):
    got = report(spark, TONE, [("a", "Hostile", "Hostile", False), ("b", "Other", None, None)])
    assert (got.n_errors, got.exact_strict) == (1, 0.5)


def test_mae_over_valid_rows(spark):
    got = report(spark, SENTIMENT, [("a", "0.0", 0.0, True), ("b", "-0.5", 0.1, False)])
    assert got.mae_sentinel == pytest.approx(0.3) and got.mae_strict == pytest.approx(0.6)
    assert (got.verdict_sentinel, got.verdict_strict) == ("FAILURE", "FAILURE")


@pytest.mark.parametrize("kind,metric,threshold,want", [
    ("ordinal", 0.85, 0.8, "SUCCESS"), ("ordinal", 0.75, 0.8, "FAILURE"), ("continuous", 0.30, 0.25, "FAILURE"),
    ("continuous", 0.20, 0.25, "SUCCESS"), ("categorical", 0.8, 0.8, "SUCCESS"), ("categorical", None, 0.8, "NO_DATA")])
def test_verdict_direction(spark, kind, metric, threshold, want):
    df = spark.createDataFrame([(kind, metric, threshold)], "k string, m double, t double")
    assert df.select(metrics.verdict(F.col("k"), F.col("m"), F.col("t"))).first()[0] == want


def test_no_labels_no_data_and_gate(spark):
    empty = report(spark, RELEVANCE, [("a", None, 3, False)])
    assert (empty.n_rows, empty.verdict_strict, empty.metric_strict) == (0, "NO_DATA", None)
    truth = spark.createDataFrame([("a", "3", "Other")], f"comment_id string, {R} string, {T} string")
    guesses = {R: spark.createDataFrame([("a", 3, False)], f"comment_id string, {R} int, is_error boolean"),
               T: spark.createDataFrame([("a", "Hostile", False)], f"comment_id string, {T} string, is_error boolean")}
    features = [RELEVANCE, TONE]
    full = metrics.report(metrics.compare(truth, guesses, features), features)
    assert metrics.passed_features(full, features) == [RELEVANCE]


def test_registry():
    assert select_features([R]) == [RELEVANCE] and len(FEATURES) == 6
    with pytest.raises(KeyError):
        select_features(["nope"])
