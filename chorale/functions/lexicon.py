"""Word-list scorers: whole-text, deterministic, offline answers in the form a model would give.

They stand in wherever no model is at hand and keep the scoring path testable. One pattern pass
collects all listed words of a text; the lists are then counted on that short array. Nothing leaves
the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorale.functions.terms import whole_words
from chorale.registry import CATEGORICAL, CONTINUOUS, Feature

Scorer = Callable[[Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def listed_words(text: Column, words: Sequence[str]) -> Column:
    """Every occurrence of a listed word, in order. Lists hold lower-case words only.

    Texts that hold none of the words as a plain substring never reach the pattern.
    """
    bad = [w for w in words if not re.fullmatch(r"[a-z0-9_]+", w)]
    if bad:
        raise ValueError(f"not plain lower-case words: {bad}")

    def found(lower: Column) -> Column:
        held = reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
        hits = F.regexp_extract_all(lower, F.lit(whole_words(words)), F.lit(0))
        return F.when(held, hits).otherwise(F.array().cast("array<string>"))

    return _let(F.lower(text), found)


def _count(found: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def ordinal_level(hits: Column, feature: Feature, step: int) -> Column:
    """One level up the scale for every `step` hits, up to its end."""
    return F.least(F.lit(int(feature.high)), F.lit(int(feature.low)) + F.floor(hits / step)).cast("int")


def valence(good: Column, bad: Column) -> Column:
    """Balance of two counts on −1…1 in steps of 0.01; 0 without hits."""
    balance = F.floor((good - bad) * 100 / F.nullif(good + bad, F.lit(0)) + 0.5) / 100
    return F.coalesce(balance, F.lit(0.0))


Lists = Mapping[str, Sequence[str]]


def _answer(found: Column, feature: Feature, lists: Lists, step: int) -> Column:
    if feature.kind == CATEGORICAL:
        value = _top_label(found, feature, lists)
    elif feature.kind == CONTINUOUS:
        value = valence(_count(found, lists["good"]), _count(found, lists["bad"]))
    else:
        value = ordinal_level(_count(found, [w for ws in lists.values() for w in ws]), feature, step)
    return F.to_json(F.struct(value.alias(feature.name)))


def lexicon_answers(features: Sequence[Feature], lists: Mapping[str, Lists],
                    steps: Mapping[str, int] | None = None) -> Callable[[Column], Column]:
    """Answers for all given features from one pass over the text: array of (feature, response).

    `lists` per feature and kind: ordinal - any keys, all words count alike, a level per `step` hits;
    continuous - `good` and `bad`; categorical - one list per label, most hits wins, the earlier label
    on a tie, `Other` without hits.
    """
    words = sorted({w for f in features for ws in lists[f.name].values() for w in ws})

    def all_answers(found: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(f.name).alias("feature"),
                     _answer(found, f, lists[f.name], (steps or {}).get(f.name, 1)).alias("response"))
            for f in features
        ])

    return lambda text: _let(listed_words(text, words), all_answers)


def lexicon_scorer(feature: Feature, lists: Lists, step: int = 1) -> Scorer:
    """A Column scorer for one feature: text to `{"<feature>": value}`."""
    answers = lexicon_answers([feature], {feature.name: lists}, {feature.name: step})
    return lambda text: answers(text)[0]["response"]


def _top_label(found: Column, feature: Feature, lists: Mapping[str, Sequence[str]]) -> Column:
    labels = [label for label in feature.labels if label in lists]

    def choose(counts: Column) -> Column:
        best = F.array_max(counts)
        first = F.array_position(counts, best).cast("int")
        return F.when(best == 0, "Other").otherwise(F.get(F.array(*[F.lit(x) for x in labels]), first - 1))

    return _let(F.array(*[_count(found, lists[label]) for label in labels]), choose)
