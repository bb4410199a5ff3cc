"""Ranking versions by the topological order of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.names import distinct_names, fresh, given, inner_keys, neutral
from tidemark.operators.rule_graph import RuleBook, _distributed_ranks, rules_in_use, small
from tidemark.operators.skew import (
    MAX_GROUP_ROWS,
    hot_runs,
    join_runs,
    largest_group,
    row_numbers,
)
from tidemark.session import materialize


def value_ranks(used: RuleBook | DataFrame, attributes: Sequence[str], df: DataFrame) -> DataFrame:
    """``attribute, value, code`` of all ruled values, for use in :func:`with_rank`."""
    if isinstance(used, RuleBook):
        return F.broadcast(used.codes(df.sparkSession, attributes))
    return small(
        materialize(_distributed_ranks(used).select("attribute", "value", F.col("rank").alias("code")))
    )


def with_rank(df: DataFrame, column: str, attribute: str, ranks: DataFrame, name: str) -> DataFrame:
    """Add the rank of ``column`` under the rules of ``attribute``; 0 if it has none."""
    value, code = fresh(df, "_rv"), fresh(df, "_rc")
    ranks = ranks.filter(F.col("attribute") == attribute)
    ranks = ranks.select(F.col("value").alias(value), F.col("code").alias(code))
    return df.join(ranks, F.col(f"`{column}`").cast("string") == F.col(value), "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(code, F.lit(0)).alias(name)
    )


def static_rank(
    df: DataFrame, attribute: str, rules: RuleBook | DataFrame, name: str | None = None
) -> DataFrame:
    """Add the rank of each row's value; 0 for null and for values outside the rules.

    A map-side lookup, unless the ranked values measure too much for a broadcast.
    """
    name = name or f"{attribute}_rank"
    distinct_names([*df.columns, name])
    used = rules_in_use(rules, [attribute], df.sparkSession)
    return with_rank(df, attribute, attribute, value_ranks(used, [attribute], df), name)


def dense_topo_rank(
    df: DataFrame,
    keys: Sequence[str],
    attribute: str,
    rules: RuleBook | DataFrame,
    vid: str,
    name: str = "group_id",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Number the distinct values of each entity in topological order.

    Rows with the same value share a number. ``vid`` only serves to spread the
    rows of very frequent values.
    """
    distinct_names([*df.columns, name])
    rank = fresh(df, "_rank")
    ranked = static_rank(df, attribute, rules, rank)
    limit = max_group_rows or MAX_GROUP_ROWS
    if largest_group(df, keys) <= limit:
        window = Window.partitionBy(*keys).orderBy(rank, attribute)
        return ranked.withColumn(name, F.dense_rank().over(window).cast("long")).drop(rank)
    # Some entity is too large for one window: number its distinct values and
    # send the numbers back to the rows.
    count = fresh(ranked, "_rows")
    values = ranked.groupBy(*keys, rank, attribute).agg(F.count("*").alias(count))
    order = [F.col(rank), F.col(attribute)]
    numbered = materialize(row_numbers(values, keys, order, name, limit))
    size = numbered.agg(F.sum(count).alias("total"), F.max(count).alias("largest")).first()
    hot = hot_runs(numbered, count, size["total"], size["largest"], limit)
    runs = numbered.select(*keys, attribute, name)
    hot = None if hot is None else hot.select(*keys, attribute, name)
    return join_runs(df, runs, [*keys, attribute], vid, hot)


def topo_row_number(
    df: DataFrame,
    keys: Sequence[str],
    attribute: str,
    rules: RuleBook | DataFrame,
    vid: str,
    name: str = "sort_id",
    max_group_rows: int | None = None,
) -> DataFrame:
    """Consecutive numbers within ``keys`` by (rank, value, version).

    To number within reference groups, name the reference attribute itself among
    the keys rather than its ``group_id``: the groups are the same, and their sizes
    can then be checked on the stored columns alone.
    """
    distinct_names([*df.columns, name])
    rank = fresh(df, "_rank")
    ranked = static_rank(df, attribute, rules, rank)
    order = [F.col(rank), F.col(attribute), F.col(vid)]
    return row_numbers(ranked, keys, order, name, max_group_rows).drop(rank)


# --- runs: maximal stretches of equal (reference, repair) values --------------
#
# In repair order, (rank(reference), reference, rank(repair), repair, version),
# rows with equal values are adjacent. A run is therefore a group, found by a
# map-side aggregation, and an entity of any number of rows has few runs.


def repair_keys(
    df: DataFrame, reference: str, repair: str, ranks: DataFrame
) -> DataFrame:
    """Add the columns that define runs and their order to rows with working names.

    ``df`` has the reference value in ``_reference`` and the repair value in ``_repaired``;
    ``reference`` and ``repair`` name their rules. ``_ref``, ``_rep`` are ranks (0 for values
    outside the rules, and null); ``_ref_odd``, ``_rep_odd`` hold the value itself when the rank is 0.
    """
    out = with_rank(df, "_reference", reference, ranks, "_ref")
    out = with_rank(out, "_repaired", repair, ranks, "_rep")
    return out.withColumns(
        {
            "_ref_odd": F.when(F.col("_ref") == 0, F.col("_reference").cast("string")),
            "_rep_odd": F.when(F.col("_rep") == 0, F.col("_repaired").cast("string")),
        }
    )


def run_order() -> list[Column]:
    return [F.col(c) for c in ("_ref", "_ref_odd", "_rep", "_rep_odd")]


def run_compress(
    df: DataFrame,
    keys: Sequence[str],
    vid: str,
    reference: str,
    repair: str,
    rules: RuleBook | DataFrame,
    max_group_rows: int | None = None,
) -> DataFrame:
    """First row of every run, with its ``run_id`` in the entity and ``run_rows``."""
    out = {"_vid": vid, "_reference": reference, "_repaired": repair, "run_id": "run_id", "run_rows": "run_rows"}
    distinct_names([*keys, *out.values()])
    inner = inner_keys(keys)
    used = rules_in_use(rules, [reference, repair], df.sparkSession)
    rows = neutral(df, keys, _vid=vid, _reference=reference, _repaired=repair)
    runs = materialize(
        repair_keys(rows, reference, repair, value_ranks(used, [reference, repair], df))
        .groupBy(*inner, "_reference", "_repaired", "_ref", "_ref_odd", "_rep", "_rep_odd")
        .agg(F.min("_vid").alias("_vid"), F.count("*").alias("run_rows"))
    )
    return given(row_numbers(runs, inner, run_order(), "run_id", max_group_rows), keys, out)
