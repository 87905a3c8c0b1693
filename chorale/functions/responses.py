"""From a scorer's JSON answer to a typed value, with built-in variant functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.registry import CATEGORICAL, CONTINUOUS, Feature


def parse_response(response: Column, feature: Feature) -> Column:
    """The value under the feature's name as its type; null for anything unreadable.

    A number cut to its integer part and a numeric string without fraction are integers;
    a string such as "3.7" is not. Only finite numbers are values.
    """
    value = F.try_variant_get(F.try_parse_json(response), f"$.{feature.name}", feature.spark_type)
    if feature.kind == CONTINUOUS:
        return F.nullif(F.nullif(F.nullif(value, F.lit(float("nan"))), F.lit(float("inf"))), F.lit(float("-inf")))
    return value


def out_of_domain(value: Column, feature: Feature) -> Column:
    """True for a readable value outside the feature's scale. The value itself is kept."""
    outside = ~value.isin(*feature.labels) if feature.kind == CATEGORICAL else ~value.between(feature.low, feature.high)
    return F.coalesce(outside, F.lit(False))


def with_value(df: DataFrame, feature: Feature, response: str = "response") -> DataFrame:
    """Adds the typed feature column (sentinel when unreadable), `is_error` and `out_of_domain`."""
    parsed = "__parsed"
    df = df.withColumn(parsed, parse_response(F.col(response), feature))
    return df.withColumns({
        feature.name: F.coalesce(F.col(parsed), F.lit(feature.sentinel)),
        "is_error": F.col(parsed).isNull(),
        "out_of_domain": out_of_domain(F.col(parsed), feature),
    }).drop(parsed)


def cast_label(label: Column, feature: Feature) -> Column:
    """A human label, read as text, as the feature's type; null when it is no such value."""
    if feature.kind == CATEGORICAL:
        return label
    number = label.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast(feature.spark_type)
