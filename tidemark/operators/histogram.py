"""Value histograms per entity and the values that survive in each entity.

``rules`` below is a RuleBook, or a rule DataFrame for sets of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bridging import bridged_edges as graph_edges
from tidemark.operators.bridging import dominated_values
from tidemark.operators.names import distinct_names, entity, given, inner_keys, neutral, unpacked
from tidemark.operators.rule_graph import (
    MAX_TASK_PAIRS,
    AttributeOrder,
    RuleBook,
    _bits,
    _by_size,
    _closure_of,
    rule_edges,
    rules_in_use,
    small,
)
from tidemark.session import materialize

WORD = 64
# Above this many ruled values per attribute, bit masks in the plan get too wide
# and the same relations are computed by joins with the closure.
MAX_MASK_VALUES = 512


def tall(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per (version, attribute): ``keys, carry, attribute, value`` (text)."""
    if len(attributes) == 1:
        a = attributes[0]
        return df.select(*keys, *carry, F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
    ids = [*keys, *carry]
    texts = [F.col(a).cast("string").alias(f"_t_{i}") for i, a in enumerate(attributes)]
    names = F.create_map(*[x for i, a in enumerate(attributes) for x in (F.lit(f"_t_{i}"), F.lit(a))])
    melted = df.select(*ids, *texts).unpivot(
        ids, [f"_t_{i}" for i in range(len(attributes))], "_slot", "value"
    )
    return melted.select(*ids, names[F.col("_slot")].alias("attribute"), "value")


def _narrow(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], vid: str | None = None) -> DataFrame:
    return neutral(df, keys, **{a: a for a in dict.fromkeys(attributes)}, _vid=vid)


def value_counts(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], vid: str | None = None
) -> DataFrame:
    """Rows per (entity, attribute, value), with one sample version if ``vid`` is given."""
    out = ["attribute", "value", "cnt", *(["sample_vid"] if vid else [])]
    distinct_names([*keys, *out])
    counts = _value_counts(_narrow(df, keys, attributes, vid), inner_keys(keys), attributes, "_vid" if vid else None)
    return given(counts, keys, {c: c for c in out})


def _value_counts(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], vid: str | None = None
) -> DataFrame:
    sample = [F.min(vid).alias("sample_vid")] if vid else []
    return (
        tall(df, keys, attributes, [vid] if vid else [])
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "attribute", "value")
        .agg(F.count("*").alias("cnt"), *sample)
    )


def value_versions(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], vid: str) -> DataFrame:
    """The versions behind each value, as distinct rows.

    A value may be held by any number of versions, so the set stays a relation
    rather than one array.
    """
    distinct_names([*keys, "attribute", "value", vid])
    inner = inner_keys(keys)
    rows = (
        tall(_narrow(df, keys, attributes, vid), inner, attributes, ["_vid"])
        .filter(F.col("value").isNotNull())
        .select(*inner, "attribute", "value", "_vid")
        .distinct()
    )
    return given(rows, keys, {"attribute": "attribute", "value": "value", "_vid": vid})


# --- bit masks over the values of one attribute ------------------------------
#
# Mask expressions are SQL text: a wide rule set needs hundreds of terms, and one
# parsed text builds much faster than as many Column objects.


def words_of(order: AttributeOrder) -> int:
    return max(1, -(-len(order) // WORD))


def word(mask: int, w: int) -> int:
    """64-bit word ``w`` of a mask as a signed long."""
    bits = (mask >> (WORD * w)) & (2**WORD - 1)
    return bits - 2**WORD if bits >= 2 ** (WORD - 1) else bits


def long_text(value: int) -> str:
    return f"{value}L" if value > -(2**63) else "(-9223372036854775807L - 1L)"


def long_array(values: Sequence[int]) -> str:
    """A literal array of longs."""
    if not values:
        return "cast(array() as array<bigint>)"
    return "array(" + ", ".join(map(long_text, values)) + ")"


def code_bit(w: int, code: str = "code") -> str:
    """The bit of a 1-based code in word ``w``, else 0."""
    low = WORD * w
    return f"if({code} > {low} and {code} <= {low + WORD}, shiftleft(1L, {code} - {low + 1}), 0L)"


def shares(left: Sequence[str], right: Sequence[str]) -> str:
    """True if two masks, given as words, share a bit."""
    return "((" + " | ".join(f"({a} & {b})" for a, b in zip(left, right)) + ") <> 0)"


def maskable(book: RuleBook | DataFrame, attributes: Sequence[str]) -> bool:
    return isinstance(book, RuleBook) and all(len(book.order(a)) <= MAX_MASK_VALUES for a in attributes)


def coded(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook) -> DataFrame:
    """Tall rows as numbers: ``keys, slot`` (attribute index), ``code, odd``.

    ``code`` is the 1-based rank of a ruled value, 0 for a value no rule names
    (kept in ``odd``) and -1 for null. The lookup table has at most two rows per
    rule edge, and a RuleBook is bounded, so it is broadcast.
    """
    return coded_tall(tall(df, keys, attributes), keys, attributes, book)


def coded_tall(
    rows: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook, carry: Sequence[str] = ()
) -> DataFrame:
    """The same of rows ``keys, attribute, value``, which may carry further columns."""
    codes = book.codes(rows.sparkSession, attributes).select(
        F.col("attribute").alias("_ra"), F.col("value").alias("_rv"), "code"
    )
    slot = F.expr(
        "case attribute "
        + " ".join(f"when '{sql_text(a)}' then {i}" for i, a in enumerate(attributes))
        + " end"
    )
    joined = rows.join(
        F.broadcast(codes),
        (F.col("attribute") == F.col("_ra")) & (F.col("value") == F.col("_rv")),
        "left",
    )
    return joined.select(
        *keys,
        *carry,
        slot.cast("int").alias("slot"),
        F.when(F.col("value").isNull(), -1).otherwise(F.coalesce("code", F.lit(0))).alias("code"),
        F.when(F.col("code").isNull(), F.col("value")).alias("odd"),
    )


def coded_wide(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook
) -> DataFrame:
    """One row per version with ``code0, code1, ...``, plus one per value no rule names.

    The row of a version has slot -1. A value outside the rules of attribute i
    gets a row of its own with slot i and the value in ``odd``; its codes are null.
    Codes are null for values that have none.
    """
    spark = df.sparkSession
    out = df.select(*keys, *[F.col(a).cast("string").alias(f"_v{i}") for i, a in enumerate(attributes)])
    for i, a in enumerate(attributes):
        codes = book.codes(spark, [a]).select(F.col("value").alias(f"_r{i}"), F.col("code").alias(f"_c{i}"))
        out = out.join(F.broadcast(codes), F.col(f"_v{i}") == F.col(f"_r{i}"), "left")
    slots = range(len(attributes))
    odds = [f"if(_c{i} is null, _v{i}, null)" for i in slots]
    out = out.select(*keys, *[f"_c{i}" for i in slots], *[F.expr(f"{o} as _o{i}") for i, o in zip(slots, odds)])
    if len(attributes) == 1:
        return out.select(
            *keys, F.expr("if(_o0 is null, -1, 0) as slot"), F.col("_o0").alias("odd"), F.col("_c0").alias("code0")
        )
    own = "named_struct('slot', -1, 'odd', cast(null as string))"
    none = " and ".join(f"_o{i} is null" for i in slots)
    each = ", ".join(f"named_struct('slot', {i}, 'odd', _o{i})" for i in slots)
    spread = f"inline(if({none}, array({own}), filter(array({own}, {each}), x -> x.slot = -1 or x.odd is not null)))"
    return out.select(*keys, *[f"_c{i}" for i in slots], F.expr(spread)).select(
        *keys, "slot", "odd", *[F.expr(f"if(slot = -1, _c{i}, null) as code{i}") for i in slots]
    )


def sql_text(text: str) -> str:
    """Text for use inside a single-quoted SQL literal; ``$`` would start a substitution."""
    return text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")


def text_array(values: Sequence[str]) -> str:
    """A literal array of strings."""
    return "cast(array(" + ", ".join(f"'{sql_text(v)}'" for v in values) + ") as array<string>)"


# --- latest values and pruned graphs -----------------------------------------


def latest_values(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """Values with no newer value in the same entity: ``keys, attribute, value, cnt``."""
    distinct_names([*keys, "attribute", "value", "cnt"])
    used = rules_in_use(rules, attributes, df.sparkSession)
    latest = _latest_values(_narrow(df, keys, attributes), inner_keys(keys), attributes, used)
    return given(latest, keys, {c: c for c in ("attribute", "value", "cnt")})


def _latest_values(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook | DataFrame
) -> DataFrame:
    if not maskable(book, attributes):
        return _latest_by_joins(df, keys, attributes, edge_table(book, df))

    # A window per (entity, attribute, odd value): at most one row per ruled value,
    # and values outside the rules stay alone, so no window is large.
    cells = coded(df, keys, attributes, book).filter("code >= 0")
    cells = cells.groupBy(*keys, "slot", "code", "odd").agg(F.count("*").alias("cnt"))
    width = max(words_of(book.order(a)) for a in attributes)
    older = []
    for w in range(width):
        lists = [long_array([word(m, w) for m in book.order(a).older]) for a in attributes]
        older.append(f"coalesce(get(get(array({', '.join(lists)}), slot), code - 1), 0L)")
    group = Window.partitionBy(*keys, "slot", "odd")
    marked = cells.select("*", *[F.expr(o).alias(f"older{w}") for w, o in enumerate(older)]).select(
        "*", *[F.bit_or(f"older{w}").over(group).alias(f"dominated{w}") for w in range(width)]
    )
    is_old = shares([code_bit(w) for w in range(width)], [f"dominated{w}" for w in range(width)])
    names = [text_array(book.order(a).values) for a in attributes]
    attribute = f"{text_array(attributes)}[slot]"
    return marked.filter(f"code = 0 or not {is_old}").select(
        *keys,
        F.expr(attribute).alias("attribute"),
        F.expr(f"if(code = 0, odd, get(get(array({', '.join(names)}), slot), code - 1))").alias("value"),
        "cnt",
    )


def edge_table(rules: RuleBook | DataFrame, df: DataFrame) -> DataFrame:
    return rules if isinstance(rules, DataFrame) else materialize(rule_edges(rules.frame(df.sparkSession)))


def _latest_by_joins(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], edges: DataFrame
) -> DataFrame:
    return latest_of_counts(materialize(_value_counts(df, keys, attributes)), keys, edges)


def latest_of_counts(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """The rows of materialized ``counts`` whose value has no newer one in its entity.

    A value has a newer one exactly if a bridged edge leaves it, so only edges next to present
    values are walked and no closure is needed.
    """
    old = dominated_values(counts, keys, edges).select(entity(keys).alias("_e"), "attribute", "value")
    return (
        counts.withColumn("_e", entity(keys))
        .join(old, ["_e", "attribute", "value"], "left_anti")
        .select(*keys, "attribute", "value", "cnt")
    )


def present_edges(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], rules: RuleBook | DataFrame
) -> DataFrame:
    """Each entity's rule graph after absent values are bridged.

    An edge joins two present values connected by a rule path on which every
    value in between is absent. Columns ``keys, attribute, src, dst``.
    """
    distinct_names([*keys, "attribute", "src", "dst"])
    used = rules_in_use(rules, attributes, df.sparkSession)
    edges = _present_edges(_narrow(df, keys, attributes), inner_keys(keys), attributes, used)
    return given(edges, keys, {c: c for c in ("attribute", "src", "dst")})


def _present_edges(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook | DataFrame
) -> DataFrame:
    if not maskable(book, attributes):
        return graph_edges(materialize(_value_counts(df, keys, attributes)), keys, edge_table(book, df))
    masks = presence(df, keys, attributes, book)
    orders = [(a, book.order(a)) for a in attributes]
    schema = T.StructType(
        [masks.schema[k] for k in keys]
        + [T.StructField(c, T.StringType()) for c in ("attribute", "src", "dst")]
    )
    keys = list(keys)

    def expand(batches):
        for batch in batches:
            for i, (a, order) in enumerate(orders):
                words = [batch.column(f"p{i}_{w}").to_numpy(False) for w in range(words_of(order))]
                names = pa.array(order.values, pa.string())
                for part in _in_chunks(bridged_edges(order, words)):
                    rows, src, dst = (pa.array(np.concatenate(x)) for x in zip(*part))
                    columns = [batch.column(k).take(rows) for k in keys]
                    columns += [pa.array([a] * len(rows), pa.string()), names.take(src), names.take(dst)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "attribute", "src", "dst"])

    return masks.mapInArrow(expand, schema)


def _in_chunks(edges, rows: int = 100_000):
    chunk, size = [], 0
    for edge in edges:
        chunk.append(edge)
        size += len(edge[0])
        if size >= rows:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def bridged_edges(order: AttributeOrder, words: Sequence[np.ndarray]):
    """Bridged edges of many entities at once, given their present values as mask words.

    Yields arrays (row numbers, src index, dst index). Values are visited in rank order; the sources
    of a value are its present parents, and the sources of its absent parents.
    """

    def bit(v: int, masks: Sequence[np.ndarray]) -> np.ndarray:
        return (masks[v // WORD] >> np.int64(v % WORD)) & 1 == 1

    sources: list[list[np.ndarray]] = []
    present = [bit(v, words) for v in range(len(order))]
    for v in range(len(order)):
        reach = [np.zeros_like(w) for w in words]
        for p in _bits(order.parents[v]):
            for w in range(len(words)):
                own = np.int64(word(1 << p, w))
                reach[w] |= np.where(present[p], own, sources[p][w])
        sources.append(reach)
        for u in _bits(order.older[v]):
            rows = np.flatnonzero(bit(u, reach) & present[v])
            if len(rows):
                yield rows, np.full(len(rows), u), np.full(len(rows), v)


def presence(
    df: DataFrame, keys: Sequence[str], attributes: Sequence[str], book: RuleBook
) -> DataFrame:
    """Present values of each entity as bit masks, one row per entity.

    Columns ``p<i>_<w>`` (word ``w`` of attribute ``i``) and ``odd<i>`` (number of
    distinct values no rule names). Masks are or-ed map-side, so the first
    exchange carries one small row per entity and map task plus the odd values,
    and the second one row per entity.
    """
    rows = coded_wide(df, keys, attributes, book)
    words = [(i, w) for i, a in enumerate(attributes) for w in range(words_of(book.order(a)))]
    first = rows.groupBy(*keys, "slot", "odd").agg(
        *[F.expr(f"bit_or({code_bit(w, f'code{i}')}) as p{i}_{w}") for i, w in words]
    )
    return first.groupBy(*keys).agg(
        *[F.expr(f"coalesce(bit_or(p{i}_{w}), 0L) as p{i}_{w}") for i, w in words],
        *[F.expr(f"count_if(slot = {i} and odd is not null) as odd{i}") for i in range(len(attributes))],
    )


def related_pairs(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """Pairs of present values of an entity that fix the order among all of them: those in the closure, if it
    measures small, else bridged edges. ``counts`` and ``edges`` are materialized."""
    ordinary, large = _by_size(edges, F.count_distinct("src") * F.count_distinct("dst"), MAX_TASK_PAIRS)
    if large is not None:
        return graph_edges(counts, keys, edges)
    closure = small(materialize(_closure_of(ordinary)).select("attribute", "src", "dst"))
    here = counts.select(entity(keys).alias("_e"), "attribute", F.col("value").alias("src"))
    there = here.withColumnRenamed("src", "dst")
    pairs = here.join(closure, ["attribute", "src"]).join(there, ["_e", "attribute", "dst"], "left_semi")
    return pairs.select(*unpacked(keys), "attribute", "src", "dst")
