"""Combining scores over attributes and entities, and choosing entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_scores(*scores: str | Column) -> Column:
    """Mean of several scores of one row; NULL if any of them is."""
    columns = [F.col(s) if isinstance(s, str) else s for s in scores]
    return reduce(lambda a, b: a + b, columns) / F.lit(float(len(columns)))


def average_score(df: DataFrame, scores: Sequence[str], name: str = "avg") -> DataFrame:
    """One row: the mean over entities of each entity's combined score."""
    return df.agg(F.avg(combine_scores(*scores)).alias(name))


def entity_filter(df: DataFrame, key: str, equals: object = None, like: str | None = None) -> DataFrame:
    """Rows of one entity (``equals``) or of a cohort whose key matches ``like``."""
    if equals is not None:
        df = df.filter(F.col(key) == F.lit(equals))
    if like is not None:
        df = df.filter(F.col(key).cast("string").like(like))
    return df
