"""Whole analyses built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.functions import average_score, combine_scores, entity_filter
from tidemark.operators.determine import cvq, hsq
from tidemark.operators.repair import join_back, repair, repaired_cells
from tidemark.operators.rule_graph import RuleBook
from tidemark.sources import load_table, save_table

METRICS = {"cvq": cvq, "hsq": hsq}


def _scored(
    metric: str, df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> tuple[DataFrame, list[str]]:
    return METRICS[metric](df, keys, attributes, rules), [f"{a}_{metric}" for a in attributes]


def entity_score(
    metric: str,
    df: DataFrame,
    key: str,
    entity: object,
    attributes: Sequence[str],
    rules: RuleBook | DataFrame,
) -> DataFrame:
    """One row: the score of one entity, the mean over its attributes if several."""
    scores, columns = _scored(metric, entity_filter(df, key, equals=entity), [], attributes, rules)
    return scores.select(combine_scores(*columns).alias(metric))


def cohort_average(
    metric: str,
    df: DataFrame,
    key: str,
    like: str,
    attributes: Sequence[str],
    rules: RuleBook | DataFrame,
) -> DataFrame:
    """One row: mean score of the entities whose key matches a LIKE pattern."""
    return table_average(metric, entity_filter(df, key, like=like), key, attributes, rules)


def table_average(
    metric: str, df: DataFrame, key: str, attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """One row: mean score of all entities."""
    scores, columns = _scored(metric, df, [key], attributes, rules)
    return average_score(scores, columns)


def repair_text_file(
    spark: SparkSession,
    source: str,
    target: str,
    reference: str,
    repaired: str,
    rules: RuleBook | DataFrame,
    key: str = "eId",
    vid: str = "vId",
    files: int | None = None,
) -> None:
    """Repair a CSV table of text columns and write it back as CSV."""
    table = load_table(spark, source)
    save_table(repair(table, [key], vid, reference, repaired, rules), target, files)


def repair_coded_file(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType | str,
    reference: str,
    repaired: str,
    rules: RuleBook | DataFrame,
    key: str = "eId",
    vid: str = "vId",
    files: int | None = None,
) -> None:
    """Repair a CSV table with a fixed schema: one vote per run, cells joined back."""
    table = load_table(spark, source, schema)
    cells = repaired_cells(table, [key], vid, reference, repaired, rules, compress_runs=True)
    save_table(join_back(table, cells, [key], vid, repaired), target, files)
