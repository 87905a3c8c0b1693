"""How well a scorer agrees with human labels.

A failed answer has a sentinel value that can look like a hit (−1 is within one step of 0; 0.0 is
perfect for neutral text). Every metric is therefore given twice: `*_sentinel` counts the sentinel as
a value, `*_strict` counts a failure as a miss (accuracies) or leaves it out (mean absolute error,
next to the error rate).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.functions.responses import cast_label
from chorale.registry import CATEGORICAL, CONTINUOUS, ORDINAL, Feature

TOLERANCE = 1


def share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def adjacent_accuracy(truth: Column, guess: Column, tolerance: int = TOLERANCE) -> Column:
    return share(F.abs(truth - guess) <= tolerance)


def binary_accuracy(truth: Column, guess: Column, cutoff: int | Column) -> Column:
    return share((truth >= cutoff) == (guess >= cutoff))


def mean_absolute_error(truth: Column, guess: Column) -> Column:
    return F.avg(F.abs(truth - guess))


def exact_accuracy(truth: Column, guess: Column) -> Column:
    return share(truth == guess)


def compare(truth: DataFrame, predictions: dict[str, DataFrame], features: Sequence[Feature]) -> DataFrame:
    """Long table of labelled pairs: feature, kind, number and text form of truth and guess, is_error.

    `truth` holds the human labels (comment_id and feature columns), `predictions` a feature table per
    name. A labelled comment without prediction counts as an error with the sentinel.
    """
    def label(f: Feature) -> Column:
        return cast_label(F.col(f.name).cast("string"), f)

    known = truth.select("comment_id", *[label(f).alias(f"truth_{f.name}") for f in features])
    known = known.filter(F.coalesce(*[F.col(f"truth_{f.name}").cast("string") for f in features]).isNotNull())
    ids, wide = known.select("comment_id"), known
    # Features that come in one table are joined in one go.
    together: dict[int, list[Feature]] = {}
    for f in features:
        together.setdefault(id(predictions[f.name]), []).append(f)
    for group in together.values():
        guess = predictions[group[0].name].select("comment_id", *[c for f in group for c in (
            F.col(f.name).alias(f"guess_{f.name}"), F.col("is_error").alias(f"error_{f.name}"))])
        # Labels are few and predictions many: cut the many down before the outer join shuffles them.
        wide = wide.join(guess.join(ids, "comment_id", "left_semi"), "comment_id", "left")
    pairs = wide.select(F.explode(F.array(*[_pair(f) for f in features])).alias("p")).select("p.*")
    return pairs.filter(F.coalesce(F.col("truth_number").cast("string"), "truth_text").isNotNull())


def _pair(f: Feature) -> Column:
    truth, guess = F.col(f"truth_{f.name}"), F.coalesce(f"guess_{f.name}", F.lit(f.sentinel))
    text = f.kind == CATEGORICAL
    return F.struct(
        F.lit(f.name).alias("feature"), F.lit(f.kind).alias("kind"), F.lit(f.cutoff).cast("int").alias("cutoff"),
        F.lit(f.threshold).alias("threshold"), F.coalesce(f"error_{f.name}", F.lit(True)).alias("is_error"),
        (F.lit(None) if text else truth).cast("double").alias("truth_number"),
        (F.lit(None) if text else guess).cast("double").alias("guess_number"),
        (truth if text else F.lit(None)).cast("string").alias("truth_text"),
        (guess if text else F.lit(None)).cast("string").alias("guess_text"),
    )


def registry_frame(like: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """The registry as a table: feature, kind, cutoff, threshold."""
    return like.sparkSession.createDataFrame(pa.table({
        "feature": pa.array([f.name for f in features], pa.string()),
        "kind": pa.array([f.kind for f in features], pa.string()),
        "cutoff": pa.array([f.cutoff for f in features], pa.int32()),
        "threshold": pa.array([f.threshold for f in features], pa.float64()),
    }))


def report(pairs: DataFrame, features: Sequence[Feature], train: DataFrame | None = None) -> DataFrame:
    """One row per feature: counts, all metrics of its kind, the headline metric and the verdict.

    `train`: rows whose labels serve as examples; `n_train` counts them per feature, null without it. One grouped pass with map-side combine. A feature without labelled rows reports NO_DATA.
    """
    t, g, ok = F.col("truth_number"), F.col("guess_number"), ~F.col("is_error")
    near, side = F.abs(t - g) <= TOLERANCE, (t >= F.col("cutoff")) == (g >= F.col("cutoff"))
    same = F.col("truth_text") == F.col("guess_text")

    def when(kind: str, test: Column) -> Column:
        return F.avg(F.when(F.col("kind") == kind, F.when(test, 1.0).otherwise(0.0)))

    has_cutoff = F.col("cutoff").isNotNull()
    gap = F.when(F.col("kind") == CONTINUOUS, F.abs(t - g))
    measured = pairs.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.count_if("is_error").alias("n_errors"),
        when(ORDINAL, near).alias("adjacent_sentinel"), when(ORDINAL, near & ok).alias("adjacent_strict"),
        F.avg(F.when(has_cutoff, F.when(side, 1.0).otherwise(0.0))).alias("binary_sentinel"),
        F.avg(F.when(has_cutoff, F.when(side & ok, 1.0).otherwise(0.0))).alias("binary_strict"),
        F.avg(gap).alias("mae_sentinel"), F.avg(F.when(ok, gap)).alias("mae_strict"),
        when(CATEGORICAL, same).alias("exact_sentinel"), when(CATEGORICAL, same & ok).alias("exact_strict"),
    )
    full = registry_frame(pairs, features).join(measured, "feature", "left").fillna(0, ["n_rows", "n_errors"])
    full = full.join(_train_rows(train, features), "feature", "left") if train is not None else full.withColumn(
        "n_train", F.lit(None).cast("long"))
    for form in ("sentinel", "strict"):
        headline = (
            F.when(F.col("kind") == ORDINAL, F.col(f"adjacent_{form}"))
            .when(F.col("kind") == CONTINUOUS, F.col(f"mae_{form}"))
            .otherwise(F.col(f"exact_{form}"))
        )
        full = full.withColumn(f"metric_{form}", headline).withColumn(
            f"verdict_{form}", verdict(F.col("kind"), F.col(f"metric_{form}"), F.col("threshold")))
    return full


def _train_rows(train: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Usable labels per feature."""
    usable = [F.count_if(cast_label(F.col(f.name).cast("string"), f).isNotNull()) if f.name in train.columns
              else F.lit(0).cast("long") for f in features]
    counts = train.agg(F.array(*[F.struct(F.lit(f.name).alias("feature"), n.alias("n_train"))
                                 for f, n in zip(features, usable, strict=True)]).alias("c"))
    return counts.select(F.inline("c"))


def verdict(kind: Column, metric: Column, threshold: Column) -> Column:
    """An error must not exceed its threshold; an accuracy must reach it."""
    passed = F.when(kind == CONTINUOUS, metric <= threshold).otherwise(metric >= threshold)
    return F.when(metric.isNull(), "NO_DATA").when(passed, "SUCCESS").otherwise("FAILURE")


def passed_features(full_report: DataFrame, features: Sequence[Feature], form: str = "strict") -> list[Feature]:
    """Features whose validation passed; only those may be generated. The report has one row per feature."""
    good = full_report.filter(F.col(f"verdict_{form}") == "SUCCESS").select("feature")
    names = {row["feature"] for row in good.take(len(features))}
    return [f for f in features if f.name in names]
