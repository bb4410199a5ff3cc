"""Currency scores in SQL: scalar SQL functions around Spark's own mergeable aggregates.

A score needs, of an entity, the distinct values (HSQ) or the number of rows of each (CVQ). Values that rules
name are bounded, so ``collect_set`` or ``collect_list`` may gather their codes; values outside the
rules only add to a count, a minimum and a sum. All of these are built-in aggregates with
map-side partial results, so an entity with most of the rows costs no more than another::

    register_scores(spark, rules, ["status"])

    SELECT eid, hsq('status', collect_set(ruled('status', status)), count(DISTINCT unruled('status', status)))
    FROM people GROUP BY eid

    SELECT eid, cvq('status', collect_list(ruled_cell('status', value, n)),
                    min(unruled_count('status', value, n)), sum(unruled_count('status', value, n)))
    FROM (SELECT eid, status AS value, count(*) AS n FROM people GROUP BY ALL) GROUP BY eid

Without GROUP BY the whole input is one entity. The inner query may also read a kept histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.determine import certainty, chain_length
from tidemark.operators.histogram import (
    MAX_MASK_VALUES,
    code_bit,
    maskable,
    sql_text,
    text_array,
    words_of,
)
from tidemark.operators.rule_graph import AttributeOrder, RuleBook, compile_rules

#: values looked up at once: the size of a bucket of the literal lookup table
BUCKET = 4


def _lookup(order: AttributeOrder) -> str:
    """SQL for the 1-based code of the text ``value``, null if no rule names it: a literal hash table."""
    buckets = max(1, len(order) // BUCKET)
    values: list[list[str]] = [[] for _ in range(buckets)]
    codes: list[list[int]] = [[] for _ in range(buckets)]
    for i, v in enumerate(order.values):
        at = zlib.crc32(v.encode()) % buckets
        values[at].append(v)
        codes[at].append(i + 1)
    at = f"cast(pmod(crc32(cast(value as binary)), {buckets}) as int)"
    texts = ", ".join(text_array(v) for v in values)
    numbers = ", ".join(f"cast(array({', '.join(map(str, c))}) as array<int>)" for c in codes)
    place = f"cast(array_position(get(array({texts}), {at}), value) as int)"
    return f"get(get(array({numbers}), {at}), {place} - 1)"


def _by_attribute(book: RuleBook, attributes: Sequence[str], body, other: str) -> str:
    cases = [f"WHEN '{sql_text(a)}' THEN {body(book.order(a))}" for a in attributes if len(book.order(a))]
    return f"CASE attribute {' '.join(cases)} ELSE {other} END" if cases else other


def _masked(order: AttributeOrder, codes: str, expression: str) -> str:
    """``expression`` over the mask words ``s.p0, s.p1, ...`` of an array of codes."""
    words = ", ".join(
        f"'p{w}', aggregate({codes}, 0L, (m, c) -> m | {code_bit(w, 'c')})" for w in range(words_of(order))
    )
    return f"get(transform(array(named_struct({words})), s -> {expression}), 0)"


def _present(order: AttributeOrder) -> list[str]:
    return [f"s.p{w}" for w in range(words_of(order))]


def _hsq_body(order: AttributeOrder) -> str:
    present = _present(order)
    known = " + ".join(f"bit_count({p})" for p in present)
    chain = f"greatest({chain_length(order, present)}, if(unruled > 0, 1, 0))"
    score = f"try_divide(cast({chain} as double), cast({known} + unruled as double))"
    return _masked(order, "codes", score)


def _cvq_body(order: AttributeOrder) -> str:
    score = certainty(order, "cells", _present(order), "least_unruled", "coalesce(total_unruled, 0L)")
    return _masked(order, "transform(cells, x -> x.code)", score)


def register_scores(
    spark: SparkSession, rules: RuleBook | DataFrame, attributes: Sequence[str], prefix: str = ""
) -> None:
    """Create the temporary SQL functions ``ruled, unruled, ruled_cell, unruled_count, hsq, cvq``.

    Each takes the attribute's name first; they know the rules of ``attributes``, all other attributes have none.
    ``prefix`` goes before every name. At most 512 ruled values an attribute (beyond that use the functions
    on DataFrames), else ValueError. Null values are ignored; an entity with no value scores NULL.
    """
    book = compile_rules(rules, attributes)
    if book is None or not maskable(book, attributes):
        raise ValueError(f"SQL functions take up to {MAX_MASK_VALUES} ruled values an attribute; use cvq and hsq on DataFrames")
    code = _by_attribute(book, attributes, _lookup, "cast(null as int)")
    alone = "try_divide(if(unruled > 0, 1.0D, 0.0D), cast(unruled as double))"
    functions = {
        "ruled(attribute STRING, value STRING) RETURNS INT": code,
        "unruled(attribute STRING, value STRING) RETURNS STRING": f"if(({code}) is null, value, null)",
        "ruled_cell(attribute STRING, value STRING, n BIGINT) RETURNS STRUCT<code: INT, n: BIGINT>": (
            f"if(({code}) is null, null, named_struct('code', ({code}), 'n', n))"
        ),
        "unruled_count(attribute STRING, value STRING, n BIGINT) RETURNS BIGINT": (
            f"if(value is not null and ({code}) is null, n, null)"
        ),
        "hsq(attribute STRING, codes ARRAY<INT>, unruled BIGINT) RETURNS DOUBLE": _by_attribute(
            book, attributes, _hsq_body, alone
        ),
        "cvq(attribute STRING, cells ARRAY<STRUCT<code: INT, n: BIGINT>>, least_unruled BIGINT, total_unruled BIGINT)"
        " RETURNS DOUBLE": _by_attribute(
            book, attributes, _cvq_body, "try_divide(cast(least_unruled as double), cast(total_unruled as double))"
        ),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}")
