"""Histograms that are kept: merged with those of new rows, scored without the old rows.

A kept histogram has one row per entity, attribute and value with the number of rows, nulls
included, so that an entity whose values are all null keeps its NULL score. Counts of disjoint sets of rows add
up, so histograms merge by one aggregate, whatever the number of rows behind them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.determine import (
    cvq_of_cells,
    cvq_of_latest,
    hsq_of_counts,
    hsq_of_masks,
)
from tidemark.operators.histogram import (
    code_bit,
    coded_tall,
    edge_table,
    latest_of_counts,
    maskable,
    tall,
    words_of,
)
from tidemark.operators.names import distinct_names, given, inner_keys, neutral
from tidemark.operators.rule_graph import RuleBook, rules_in_use
from tidemark.session import materialize

COLUMNS = ["attribute", "value", "cnt"]


def histogram(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Rows per entity, attribute and value (null included): ``keys, attribute, value, cnt``."""
    distinct_names([*keys, *COLUMNS])
    narrow = neutral(df, keys, **{a: a for a in dict.fromkeys(attributes)})
    inner = inner_keys(keys)
    counts = tall(narrow, inner, attributes).groupBy(*inner, "attribute", "value").agg(F.count("*").alias("cnt"))
    return given(counts, keys, {c: c for c in COLUMNS})


def merge_histograms(keys: Sequence[str], *histograms: DataFrame) -> DataFrame:
    """The histogram of all rows behind ``histograms``, which count disjoint sets of rows."""
    columns = [*keys, *COLUMNS]
    together = reduce(DataFrame.unionByName, [h.select(*[F.col(f"`{c}`") for c in columns]) for h in histograms])
    merged = _inner(together, keys).groupBy(*inner_keys(keys), "attribute", "value").agg(F.sum("cnt").alias("cnt"))
    return given(merged, keys, {c: c for c in COLUMNS})


def _inner(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    return neutral(histogram, keys, **{c: c for c in COLUMNS})


def _scored(
    metric: str, counts: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    columns = [f"{a}_{metric}" for a in attributes]
    distinct_names([*keys, *columns])
    inner = inner_keys(keys)
    wanted = _inner(counts, keys).filter(F.col("attribute").isin(list(attributes)))
    used = rules_in_use(rules, attributes, counts.sparkSession)
    if not maskable(used, attributes):
        edges = edge_table(used, counts)
        held = materialize(wanted)
        known = materialize(held.filter(F.col("value").isNotNull()))
        if metric == "cvq":
            scores = cvq_of_latest(held, latest_of_counts(known, inner, edges), inner, attributes)
        else:
            scores = hsq_of_counts(held, known, inner, attributes, edges)
    else:
        cells = coded_tall(wanted, inner, attributes, used, ["cnt"]).withColumnRenamed("cnt", "n")
        if metric == "cvq":
            scores = cvq_of_cells(cells, inner, attributes, used)
        else:
            scores = hsq_of_masks(_masks(cells, inner, attributes, used), inner, attributes, used)
    return scores.select(*[F.col(n).alias(k) for k, n in zip(keys, inner)], *columns)


def _masks(cells: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook) -> DataFrame:
    words = [(i, w) for i, a in enumerate(attributes) for w in range(words_of(book.order(a)))]
    return cells.groupBy(*keys).agg(
        *[F.expr(f"coalesce(bit_or(if(slot = {i}, {code_bit(w)}, 0L)), 0L) as p{i}_{w}") for i, w in words],
        *[F.expr(f"count_if(slot = {i} and code = 0) as odd{i}") for i in range(len(attributes))],
    )


def cvq_of(
    counts: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """:func:`~tidemark.cvq` from a histogram of :func:`histogram` or :func:`merge_histograms`."""
    return _scored("cvq", counts, keys, attributes, rules)


def hsq_of(
    counts: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """:func:`~tidemark.hsq` from a histogram."""
    return _scored("hsq", counts, keys, attributes, rules)
