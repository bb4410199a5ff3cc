"""Each entity's rule graph after absent values are bridged, under rules too many for the driver.

An attribute whose edges fit a task is walked there: its edges go to the tasks that hold its entities,
under as many salts as its entities need, and every entity's values follow, sorted. A task builds
the graph once and walks it from the present values of one entity after another, so there is one
exchange and no loop of jobs. An attribute with more edges is walked in the same way in its connected
parts. A part with more edges is contracted to the values that are present anywhere and walked by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import rule_graph
from tidemark.operators.contraction import contract
from tidemark.operators.names import entity, unpacked
from tidemark.operators.parts import part_of_values
from tidemark.operators.rule_graph import _by_size, _distributed_ranks, _levels_of, in_parts, small, units
from tidemark.session import materialize

#: values of entities that meet an attribute's edges in one task, about
TASK_VALUES = 50_000


class Graph:
    """The edges of one attribute: successors of each value, values as numbers in topological order."""

    def __init__(self, pairs: list[tuple[str, str]]):
        level, successors = _levels_of("", pairs)
        self.values = sorted(level, key=lambda v: (level[v], v))
        self.number = {v: i for i, v in enumerate(self.values)}
        self.after = [sorted(self.number[d] for d in successors[v]) for v in self.values]

    def bridged(self, present: Sequence[int]) -> Iterator[tuple[int, list[int]]]:
        """(value, present values next to it through absent ones) for each present value, in order."""
        here = set(present)
        for v in sorted(here):
            found, seen, todo = [], set(), [v]
            while todo:
                for w in self.after[todo.pop()]:
                    if w not in seen:
                        seen.add(w)
                        (found if w in here else todo).append(w)
            yield v, found


def _links(graph: Graph, present: list[int]) -> Iterator[tuple]:
    for v, found in graph.bridged(present):
        for w in found:
            yield graph.values[v], graph.values[w]


def _old(graph: Graph, present: list[int]) -> Iterator[tuple]:
    for v, found in graph.bridged(present):
        if found:
            yield (graph.values[v],)


def _longest(graph: Graph, present: list[int]) -> Iterator[tuple]:
    depth = dict.fromkeys(present, 1)
    for v, found in graph.bridged(present):
        for w in found:
            depth[w] = max(depth[w], depth[v] + 1)
    if depth:
        yield (max(depth.values()),)


def _per_entity(keys: list[str], emit: Callable, fields: list[T.StructField], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def same(a, b):
        return a == b or (a != a and b != b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def finished(graph, group, who, values):
            known = [graph.number[v] for v in values if v in graph.number]
            out.extend((*who, group[0], *row) for row in emit(graph, known))

        def flushed():
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], names=arrow.names)
            out.clear()
            return batch

        group = graph = pairs = who = None
        values: list[str] = []
        for batch in batches:
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("attribute", "_part", "_salt", "_kind", "_a", "_b", *keys)]
            for attribute, part, salt, kind, a, b, *key in zip(*columns):
                if (attribute, part, salt) != group:
                    if graph is not None and values:
                        finished(graph, group, who, values)
                    group, graph, pairs, who, values = (attribute, part, salt), None, [], None, []
                if kind == 0:
                    pairs.append((a, b))
                    continue
                if graph is None:
                    graph, pairs, who = Graph(pairs), None, key
                if not all(map(same, key, who)):
                    finished(graph, group, who, values)
                    who, values = key, []
                values.append(a)
                if len(out) >= 50_000:
                    yield flushed()
        if graph is not None and values:
            finished(graph, group, who, values)
        if out:
            yield flushed()

    return run


def _in_tasks(
    counts: DataFrame, keys: Sequence[str], edges: DataFrame, emit: Callable, fields: list[T.StructField]
) -> DataFrame:
    """``keys, attribute`` and what ``emit`` yields for each entity, over attributes or parts that fit a task.
    ``counts`` has the column ``_part`` if ``edges`` has it."""
    if "_part" not in edges.columns:
        edges, counts = (x.withColumn("_part", F.lit(0).cast("long")) for x in (edges, counts))
    by = units(edges)
    sizes = counts.groupBy(*by).agg(F.ceil(F.count("*") / TASK_VALUES).cast("long").alias("_salts"))
    salts = materialize(sizes.join(edges.select(*by).distinct(), by, "left_semi"))
    blank = [F.lit(None).cast(counts.schema[k].dataType).alias(k) for k in keys]
    copies = edges.join(salts, by).select(
        *by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_salt"),
        F.lit(0).alias("_kind"), F.col("src").alias("_a"), F.col("dst").alias("_b"), *blank,
    )
    # broadcast if small, else by attribute and part, whose hot ones adaptive execution splits
    rows = counts.join(small(salts), by).select(
        *by, F.pmod(F.xxhash64(entity(keys)), F.col("_salts")).alias("_salt"),
        F.lit(1).alias("_kind"), F.col("value").alias("_a"), F.lit(None).cast("string").alias("_b"), *keys,
    )
    schema = T.StructType([*[counts.schema[k] for k in keys], T.StructField("attribute", T.StringType()), *fields])
    return (
        copies.unionByName(rows)
        .repartition(*by, "_salt")
        .sortWithinPartitions(*by, "_salt", "_kind", *keys)
        .mapInArrow(_per_entity(list(keys), emit, fields, schema), schema)
    )


def _split(counts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(counts and edges of attributes or parts that fit a task, counts of the others, edges of the others or
    None). Where edges have parts, counts are those of ruled values, with their parts."""
    edges = in_parts(edges)
    ordinary, large = _by_size(edges, F.count("*"), rule_graph.MAX_TASK_EDGES)
    if "_part" in edges.columns:
        counts = materialize(counts.join(part_of_values(edges), ["attribute", "value"]))
    if large is None:
        return counts, ordinary, counts.limit(0), None
    by = units(edges)
    return counts, ordinary, counts.join(F.broadcast(large.select(*by).distinct()), by, "left_semi"), large


def bridged_edges(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """``keys, attribute, src, dst`` for materialized ``counts`` and ``edges``."""
    counts, ordinary, rest, large = _split(counts, edges)
    ends = [T.StructField(c, T.StringType()) for c in ("src", "dst")]
    found = _in_tasks(counts, keys, ordinary, _links, ends)
    return found if large is None else found.unionByName(_by_frontier(rest, keys, large))


def dominated_values(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """``keys, attribute, value`` of the present values with a newer present one: those that a bridged edge leaves."""
    counts, ordinary, rest, large = _split(counts, edges)
    found = _in_tasks(counts, keys, ordinary, _old, [T.StructField("value", T.StringType())])
    if large is None:
        return found
    links = _by_frontier(rest, keys, large)
    return found.unionByName(links.select(*keys, "attribute", F.col("src").alias("value")).distinct())


def longest_chains(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """``keys, attribute, longest``: values on the longest chain of present ones, of entities with a ruled value.
    An entity has a row for each part of the rules that its values are in."""
    counts, ordinary, rest, large = _split(counts, edges)
    found = _in_tasks(counts, keys, ordinary, _longest, [T.StructField("longest", T.IntegerType())])
    if large is None:
        return found
    ranks = _distributed_ranks(large.drop("_part")).select("attribute", F.col("value").alias("dst"), "level")
    links = _by_frontier(rest, keys, large).join(small(materialize(ranks)), ["attribute", "dst"])
    schema = T.StructType([*[counts.schema[k] for k in keys], T.StructField("attribute", T.StringType()), T.StructField("longest", T.IntegerType())])
    chains = (
        links.repartition("attribute", *keys)
        .sortWithinPartitions("attribute", *keys, "level")
        .select(*keys, "attribute", "src", "dst")
        .mapInArrow(_chain_stream(list(keys), schema), schema)
    )
    return found.unionByName(chains)


def _chain_stream(keys: list[str], schema: T.StructType):
    """Longest path over the edges of each entity, which come sorted by the level of their end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, depth = None, {}

        def row():
            return pa.record_batch([pa.array([x], t) for x, t in zip((*who, max(depth.values())), arrow.types)], names=arrow.names)

        for batch in batches:
            for *key, src, dst in zip(*(c.to_pylist() for c in batch.columns)):
                if key != who:
                    if depth:
                        yield row()
                    who, depth = key, {}
                depth[dst] = max(depth.get(dst, 1), depth.get(src, 1) + 1)
        if depth:
            yield row()

    return run


def _by_frontier(counts: DataFrame, keys: Sequence[str], edges: DataFrame) -> DataFrame:
    """Leave a present value, pass through absent ones, stop at present ones: a join each step.

    The graph is first contracted to the values present anywhere. A round looks at what the last
    one reached only; without cycles it ends after the longest absent path that is left.
    """
    steps = small(contract(edges, counts).select("attribute", F.col("src").alias("at"), "dst"))
    here = counts.select(entity(keys).alias("_e"), "attribute", "value")
    at = here.withColumnRenamed("value", "dst")
    frontier = here.select("_e", "attribute", F.col("value").alias("src"), F.col("value").alias("at"))
    found: list[DataFrame] = []
    while True:
        reached = frontier.join(steps, ["attribute", "at"]).select("_e", "attribute", "src", "dst").distinct()
        present = at.withColumn("_here", F.lit(True))
        reached = materialize(reached.join(present, ["_e", "attribute", "dst"], "left"))
        found.append(reached.filter("_here").drop("_here"))
        frontier = reached.filter("_here is null").select("_e", "attribute", "src", F.col("dst").alias("at"))
        if frontier.isEmpty():
            break
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    return together.distinct().select(*unpacked(keys), "attribute", "src", "dst")
