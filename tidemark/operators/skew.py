"""Ordered numbering and run joins that hold up when one group has most rows.

A window function puts a whole group in one task. The helpers here use a window
while every group is small and otherwise cut large groups into sorted slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

# A window partition above this many rows is cut into slices.
MAX_GROUP_ROWS = 5_000_000
# A run is hot when it holds more than 1/MAX_HOT_RUNS of all rows, so there are
# fewer than MAX_HOT_RUNS hot runs whatever the data: safe to broadcast.
MAX_HOT_RUNS = 1_000
MIN_HOT_ROWS = 1_000_000
HOT_SALTS = 1_000


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of each key with its prefixed twin."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return condition


def bytes_of(df: DataFrame) -> int:
    """Size of a materialized table: the lengths of texts and binaries, of other values without a
    fixed width the length of their JSON, and eight bytes per field."""
    row = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.DayTimeIntervalType)):
            row = row + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group. Reads only the key columns, counts map-side."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def split_groups(
    df: DataFrame, keys: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """``df`` as (rows of ordinary groups, rows of large groups or None, large row count).

    A group is large above ``limit`` rows, whatever the size of the table. The list of
    large groups is joined by key; Spark broadcasts it while it is short.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    stats = sizes.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    if (stats["largest"] or 0) <= limit:
        return df, None, 0
    if not keys:
        return df.limit(0), df, stats["total"]
    large = materialize(
        sizes.filter(F.col("_n") > limit).select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_n")
    )
    rows = large.agg(F.sum("_n")).first()[0]
    large = large.drop("_n")
    same = same_keys(keys, "_g_")
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi"), rows


def slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], total: int, rows: int
) -> DataFrame:
    """Range-partition ``total`` rows by (keys, order) into sorted slices of about ``rows`` rows.

    Adds ``_slice``, which grows along the order. The result is materialized, so
    slice numbers stay the same when tasks are retried.
    """
    parts = max(2, -(-total // max(1, rows)))
    by = [F.col(k) for k in keys] + list(order)
    cut = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialize(cut.withColumn("_slice", F.spark_partition_id()))


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    max_group_rows: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for groups of any size.

    The order must be total within a group.
    """
    limit = max_group_rows or MAX_GROUP_ROWS
    ordinary, large, total = split_groups(df, keys, limit)
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = ordinary.withColumn(name, F.row_number().over(window).cast("long"))
    if large is None:
        return numbered
    return numbered.unionByName(
        _number_slices(slices(large, keys, order, total, limit), keys, order, df.columns, name)
    )


def _number_slices(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], name: str
) -> DataFrame:
    # At most one row per slice and per large group: a short table, which Spark broadcasts.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(
            *[F.col(k).alias(f"_o_{k}") for k in keys],
            F.col("_slice").alias("_o_slice"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_inside", F.row_number().over(inside))
        .join(
            offsets, (F.col("_slice") == F.col("_o_slice")) & same_keys(keys, "_o_")
        )
        .select(*columns, (F.col("_inside") + F.col("_offset")).alias(name))
    )


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, str],
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add the next row's value of each column (``{source: new name}``) in group order."""
    limit = max_group_rows or MAX_GROUP_ROWS
    ordinary, large, total = split_groups(df, keys, limit)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = ordinary.select("*", *[F.lead(c, 1).over(window).alias(n) for c, n in columns.items()])
    if large is None:
        return out
    # (group, row number) is unique, so this self-join cannot be skewed
    sliced = slices(large, keys, order, total, limit)
    numbered = materialize(_number_slices(sliced, keys, order, df.columns, "_rn"))
    following = numbered.select(
        *[F.col(k).alias(f"_f_{k}") for k in keys],
        (F.col("_rn") - 1).alias("_f_rn"),
        *[F.col(c).alias(n) for c, n in columns.items()],
    )
    same = (F.col("_rn") == F.col("_f_rn")) & same_keys(keys, "_f_")
    joined = numbered.join(following, same, "left").select(*df.columns, *columns.values())
    return out.unionByName(joined)


def join_runs(
    rows: DataFrame,
    runs: DataFrame,
    on: Sequence[str],
    spread: str,
    hot: DataFrame | None,
) -> DataFrame:
    """Left join ``rows`` with at most one ``runs`` row each, null-safe on ``on``.

    ``hot`` holds the runs above the hot-run bound (see :func:`hot_runs`), with
    the columns of ``runs``. Their rows are answered by broadcast and then
    scattered by ``spread`` (a column with many values), so the shuffle join
    never sees them together.
    """
    payload = [c for c in runs.columns if c not in on]

    def twin(right: DataFrame, prefix: str) -> DataFrame:
        return right.select(*[F.col(c).alias(f"{prefix}{c}") for c in [*on, *payload]])

    def same(prefix: str) -> Column:
        # plain equality where the rows cannot be null: half the join keys
        condition = F.lit(True)
        for c in on:
            if rows.schema[c].nullable:
                condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
            else:
                condition = condition & (F.col(c) == F.col(f"{prefix}{c}"))
        return condition

    if hot is None:
        joined = rows.join(twin(runs, "_c_"), same("_c_"), "left")
        return joined.select(*rows.columns, *[F.col(f"_c_{c}").alias(c) for c in payload])

    is_hot = F.coalesce(F.col("_h_found"), F.lit(False))
    found = twin(hot, "_h_").withColumn("_h_found", F.lit(True))
    answered = rows.join(F.broadcast(found), same("_h_"), "left").withColumn(
        "_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS)) + 1).otherwise(0)
    )
    others = twin(runs, "_c_").withColumn("_c_salt", F.lit(0).cast("long"))
    joined = answered.join(
        others, (F.col("_salt") == F.col("_c_salt")) & same("_c_"), "left"
    )
    return joined.select(
        *rows.columns,
        *[F.when(is_hot, F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in payload],
    )


def hot_runs(
    runs: DataFrame, count: str, total: int, largest: int, min_rows: int | None = None
) -> DataFrame | None:
    """Runs that hold more than 1/MAX_HOT_RUNS of all rows, or None if there are none.

    ``total`` and ``largest`` are the sum and maximum of ``count`` over all runs.
    """
    floor = MIN_HOT_ROWS if min_rows is None else min_rows
    bound = max(floor, total // MAX_HOT_RUNS)
    return runs.filter(F.col(count) > bound) if largest > bound else None
