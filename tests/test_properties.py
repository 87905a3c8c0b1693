"""Generated inputs against the plain Python meaning of the same operation."""

import json
import math
import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.functions.responses import parse_response
from chorale.functions.terms import any_of, phrase, prefix, term
from chorale.registry import RELEVANCE, SENTIMENT

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

numbers = st.one_of(st.integers(-10**6, 10**6), st.floats(-1000, 1000, allow_nan=False).map(lambda x: round(x, 3)))
scalars = st.one_of(st.none(), st.booleans(), numbers, numbers.map(str), st.text(string.ascii_letters + " ", max_size=5))
answers = st.lists(st.one_of(
    scalars.map(lambda v: json.dumps({RELEVANCE.name: v, SENTIMENT.name: v})),
    st.lists(scalars, max_size=2).map(json.dumps), st.just("{}"), st.just("no json"), st.none()), min_size=60, max_size=120)


def python_value(answer, name, kind):
    try:
        value = kind(json.loads(answer).get(name))
        return value if math.isfinite(value) else None  # ours: only finite numbers are values
    except Exception:
        return None


@FEW
@given(answers)
def test_answers_read_as_python_reads_them(spark, batch):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(batch)], "i int, response string")
    rows = df.select("response", parse_response(F.col("response"), RELEVANCE).alias("o"),
                     parse_response(F.col("response"), SENTIMENT).alias("c")).collect()
    for r in rows:
        assert r.o == python_value(r.response, RELEVANCE.name, int), r
        want = python_value(r.response, SENTIMENT.name, float)
        assert (r.c is None) == (want is None) and (want is None or abs(r.c - want) < 1e-9), r


words = st.lists(st.sampled_from(["war", "wars", "warn", "un", "hate", "speech", "é", "x_war", "war-un", "1war", "\n"]), max_size=6)


@FEW
@given(st.lists(words.map(" ".join), min_size=40, max_size=80))
def test_words_match_as_tokens(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", term("war").matches(F.col("t")).alias("w"), prefix("war").matches(F.col("t")).alias("p"),
                    phrase("hate speech").matches(F.col("t")).alias("h"), any_of("un", prefix("spee")).matches(F.col("t")).alias("a")).collect()
    for r in got:
        tokens = re.split("[^a-z0-9_]+", r.t)
        assert r.w == ("war" in tokens)
        assert r.p == any(x.startswith("war") for x in tokens)
        assert r.h == bool(re.search(r"(?<![a-z0-9_])hate\s+speech(?![a-z0-9_])", r.t))
        assert r.a == ("un" in tokens or any(x.startswith("spee") for x in tokens))
