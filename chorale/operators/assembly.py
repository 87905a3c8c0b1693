"""Joining features back to the comments, and filtering on relevance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.sampling import ID
from chorale.registry import RELEVANCE


def join_feature(base: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Base rows with one feature column; comments without a value get null."""
    return base.join(table.select(ID, name), ID, "left")


def relevant_only(base: DataFrame, scores: DataFrame, cutoff: int = RELEVANCE.cutoff,
                  name: str = RELEVANCE.name) -> DataFrame:
    """Comments at or above the cutoff. Unscored ones and failures (−1) go.

    The null-rejecting filter turns the left join into an inner one and reaches the score scan.
    """
    return join_feature(base, scores, name).filter(F.col(name) >= cutoff)


def join_features(base: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Base with every feature it does not have yet; a second call changes nothing.

    Successive left joins on one key: the wide base is shuffled once and its partitioning serves all
    of them, each narrow feature table is shuffled once or broadcast. On bucketed tables nothing is.
    A frame given for several features is joined once. Feature tables have one row per id.
    """
    names_of: dict[int, list[str]] = {}
    for name, table in tables.items():
        if name not in base.columns:
            names_of.setdefault(id(table), []).append(name)
    for names in names_of.values():
        base = base.join(tables[names[0]].select(ID, *names), ID, "left")
    return base
