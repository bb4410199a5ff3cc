"""Currency scores: how certain the latest value is, how complete the history is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bridging import longest_chains
from tidemark.operators.histogram import (
    _latest_by_joins,
    _value_counts,
    code_bit,
    coded,
    coded_wide,
    edge_table,
    long_array,
    long_text,
    maskable,
    presence,
    shares,
    word,
    words_of,
)
from tidemark.operators.names import distinct_names, inner_keys, neutral
from tidemark.operators.rule_graph import AttributeOrder, RuleBook, rules_in_use
from tidemark.session import materialize

# Attributes with at most this many ruled values are counted in plain columns,
# and their chains unrolled into plain columns. At 50 values the compiled code
# gets so long that collecting a histogram is faster.
MAX_COUNTED_VALUES = 16


def cvq(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """``<attribute>_cvq`` per entity: rarest latest value over all latest values.

    With no keys the whole table is one entity. Null values are ignored; an
    entity with no value at all scores NULL.
    """
    return _scored(_cvq, "cvq", df, keys, attributes, rules)


def hsq(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """``<attribute>_hsq`` per entity: longest chain of present values over present values."""
    return _scored(_hsq, "hsq", df, keys, attributes, rules)


def _scored(score, metric: str, df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules) -> DataFrame:
    # Neutral key names, so that keys cannot collide with working columns.
    columns = [f"{a}_{metric}" for a in attributes]
    distinct_names([*keys, *columns])
    inner = inner_keys(keys)
    narrow = neutral(df, keys, **{a: a for a in dict.fromkeys(attributes)})
    scores = score(narrow, inner, attributes, rules_in_use(rules, attributes, df.sparkSession))
    return scores.select(*[F.col(n).alias(k) for k, n in zip(keys, inner)], *columns)


def _cvq(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook | DataFrame
) -> DataFrame:
    if not maskable(book, attributes):
        return _cvq_by_joins(df, keys, attributes, edge_table(book, df))
    if max(len(book.order(a)) for a in attributes) <= MAX_COUNTED_VALUES:
        return _cvq_counted(df, keys, attributes, book)
    cells = coded(df, keys, attributes, book).groupBy(*keys, "slot", "code", "odd").agg(F.count("*").alias("n"))
    return cvq_of_cells(cells, keys, attributes, book)


def _cvq_counted(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook) -> DataFrame:
    # One counter column per ruled value: every exchange carries one fixed-width
    # row per entity (plus the odd values), and no arrays are built.
    rows = coded_wide(df, keys, attributes, book)
    counters = [(i, v) for i, a in enumerate(attributes) for v in range(1, len(book.order(a)) + 1)]
    first = rows.groupBy(*keys, "slot", "odd").agg(
        F.count("*").alias("n"), *[F.expr(f"count_if(code{i} = {v}) as c{i}_{v}") for i, v in counters]
    )
    aggs = [F.expr(f"sum(c{i}_{v}) as c{i}_{v}") for i, v in counters]
    for i in range(len(attributes)):
        aggs += _odd_aggs(i, f"slot = {i} and odd is not null")
    counted = first.groupBy(*keys).agg(*aggs)

    present, latest, scores = [], [], []
    for i, a in enumerate(attributes):
        order = book.order(a)
        bits = [f"if(c{i}_{v + 1} > 0, {long_text(word(1 << v, 0))}, 0L)" for v in range(len(order))]
        present.append(f"{' | '.join(bits) or '0L'} as p{i}")
        candidates = [f"l{i}_{v}" for v in range(len(order))]
        for v, name in enumerate(candidates):
            newest = f"c{i}_{v + 1} > 0 and p{i} & {long_text(word(order.newer[v], 0))} = 0"
            latest.append(f"if({newest}, c{i}_{v + 1}, null) as {name}")
        rarest = f"least({', '.join([*candidates, f'odd_min{i}'])})" if candidates else f"odd_min{i}"
        total = " + ".join([f"odd_sum{i}", *[f"coalesce({c}, 0)" for c in candidates]])
        scores.append(_ratio(F.expr(rarest), F.expr(total)).alias(f"{a}_cvq"))
    marked = counted.select("*", *map(F.expr, present)).select("*", *map(F.expr, latest))
    return marked.select(*keys, *scores)


def cvq_of_cells(cells: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook) -> DataFrame:
    """Scores from ``keys, slot, code, odd, n``, one row per value of an entity.

    An entity holds at most one array item per ruled value. Odd values are never collected: they
    only add to a minimum and a sum.
    """
    aggs: list[Column] = []
    for i, a in enumerate(attributes):
        item = f"if(slot = {i} and code > 0, named_struct('code', code, 'n', n), null)"
        aggs.append(F.expr(f"collect_list({item}) as known{i}"))
        aggs += [
            F.expr(f"bit_or(if(slot = {i}, {code_bit(w)}, 0L)) as p{i}_{w}")
            for w in range(words_of(book.order(a)))
        ]
        aggs += _odd_aggs(i, f"slot = {i} and code = 0")
    gathered = cells.groupBy(*keys).agg(*aggs)

    scores = []
    for i, a in enumerate(attributes):
        present = [f"p{i}_{w}" for w in range(words_of(book.order(a)))]
        score = certainty(book.order(a), f"known{i}", present, f"odd_min{i}", f"odd_sum{i}")
        scores.append(F.expr(score).alias(f"{a}_cvq"))
    return gathered.select(*keys, *scores)


def certainty(order: AttributeOrder, known: str, present: Sequence[str], odd_min: str, odd_sum: str) -> str:
    """SQL for the score of an array ``known`` of (code, n) and the least and total count of odd values.
    ``present`` are the words of the mask of all codes."""
    newer = [f"get({long_array([word(m, w) for m in order.newer])}, x.code - 1)" for w in range(len(present))]
    return f"""aggregate(
      filter({known}, x -> not {shares(newer, present)}),
      named_struct('rarest', {odd_min}, 'total', {odd_sum}),
      (s, x) -> named_struct('rarest', least(s.rarest, x.n), 'total', s.total + x.n),
      s -> try_divide(cast(s.rarest as double), cast(s.total as double)))"""


def _odd_aggs(i: int, odd: str) -> list[Column]:
    return [
        F.expr(f"min(if({odd}, n, null)) as odd_min{i}"),
        F.expr(f"coalesce(sum(if({odd}, n, null)), 0) as odd_sum{i}"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _cvq_by_joins(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], edges: DataFrame
) -> DataFrame:
    return cvq_of_latest(df, _latest_by_joins(df, keys, attributes, edges), keys, attributes)


def cvq_of_latest(df: DataFrame, latest: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Scores of the entities of ``df`` from their latest values."""
    long = latest.groupBy(*keys, "attribute").agg(_ratio(F.min("cnt"), F.sum("cnt")).alias("score"))
    return _widen(df, long, keys, attributes, "cvq")


def _widen(df: DataFrame, long: DataFrame, keys: Sequence[str], attributes: Sequence[str], metric: str) -> DataFrame:
    # Entities whose values are all null have no row in ``long`` but keep their NULL score.
    blank = df.select(*keys).distinct() if keys else df.limit(0)
    if keys:
        long = long.unionByName(
            blank.select(*keys, F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("double").alias("score"))
        )
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("attribute") == a, F.col("score"))).alias(f"{a}_{metric}") for a in attributes]
    )


def _hsq(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook | DataFrame
) -> DataFrame:
    if not maskable(book, attributes):
        return _hsq_by_joins(df, keys, attributes, edge_table(book, df))
    return hsq_of_masks(presence(df, keys, attributes, book), keys, attributes, book)


def hsq_of_masks(masks: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook) -> DataFrame:
    """Scores from the columns of :func:`presence`."""
    scores = []
    for i, a in enumerate(attributes):
        order = book.order(a)
        present = [f"p{i}_{w}" for w in range(words_of(order))]
        known = " + ".join(f"bit_count({p})" for p in present)
        if 0 < len(order) <= MAX_COUNTED_VALUES:
            masks, longest = _with_depths(masks, i, order)
        else:
            longest = chain_length(order, present)
        chain = f"greatest({longest}, if(odd{i} > 0, 1, 0))"
        scores.append(_ratio(F.expr(chain), F.expr(f"{known} + odd{i}")).alias(f"{a}_hsq"))
    return masks.select(*keys, *scores)


def _with_depths(masks: DataFrame, i: int, order: AttributeOrder) -> tuple[DataFrame, str]:
    """One column per value: the longest chain that ends in it, 0 if it is absent.

    A select per level of the rule graph, all compiled into the same stage.
    """
    for level in range(max(order.levels) + 1):
        columns = []
        for v in range(len(order)):
            if order.levels[v] == level:
                below = ["0", "0", *[f"d{i}_{u}" for u in range(len(order)) if order.older[v] >> u & 1]]
                here = f"p{i}_0 & {1 << v}L <> 0"
                columns.append(F.expr(f"if({here}, 1 + greatest({', '.join(below)}), 0) as d{i}_{v}"))
        masks = masks.select("*", *columns)
    ends = ["0", "0", *[f"d{i}_{v}" for v in range(len(order))]]
    return masks, f"greatest({', '.join(ends)})"


def chain_length(order: AttributeOrder, present: Sequence[str]) -> str:
    """SQL for the longest chain among the present values.

    Folds the values in rank order into one mask per chain length. If some older
    value ends a chain of length d, then by transitivity another one ends a chain
    of every shorter length, so the longest is the number of masks hit.
    """
    if not len(order):
        return "0"
    words = range(len(present))

    def mask(name: str, bits: int) -> str:
        return ", ".join(f"'{name}{w}', {long_text(word(bits, w))}" for w in words)

    values = ", ".join(
        f"named_struct({mask('b', 1 << i)}, {mask('o', order.older[i])})" for i in range(len(order))
    )
    level = ", ".join(f"l{w}: bigint" for w in words)
    here = shares([f"x.b{w}" for w in words], present)
    below = shares([f"l.l{w}" for w in words], [f"x.o{w}" for w in words])
    alone = "named_struct(" + ", ".join(f"'l{w}', x.b{w}" for w in words) + ")"
    joined = "named_struct(" + ", ".join(f"'l{w}', l.l{w} | x.b{w}" for w in words) + ")"
    return f"""size(aggregate(array({values}), cast(array() as array<struct<{level}>>), (levels, x) ->
      if({here},
        get(transform(array(size(filter(levels, l -> {below}))), d ->
          if(d = size(levels), concat(levels, array({alone})),
            transform(levels, (l, i) -> if(i = d, {joined}, l)))), 0),
        levels)))"""


def _hsq_by_joins(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], edges: DataFrame
) -> DataFrame:
    counts = materialize(_value_counts(df, keys, attributes))
    return hsq_of_counts(df, counts, keys, attributes, edges)


def hsq_of_counts(
    df: DataFrame, counts: DataFrame, keys: Sequence[str], attributes: Sequence[str], edges: DataFrame
) -> DataFrame:
    """Scores of the entities of ``df`` from their materialized ``counts``.

    A chain of present values is a path of bridged edges, so the closure, which may be far larger,
    is not needed.
    """
    longest = longest_chains(counts, keys, edges)
    present = counts.groupBy(*keys, "attribute").agg(F.count("*").alias("n"), F.lit(1).alias("longest"))
    long = (
        present.unionByName(longest.select(*keys, "attribute", F.lit(0).cast("long").alias("n"), "longest"))
        .groupBy(*keys, "attribute")
        .agg(_ratio(F.max("longest"), F.sum("n")).alias("score"))
    )
    return _widen(df, long, keys, attributes, "hsq")
