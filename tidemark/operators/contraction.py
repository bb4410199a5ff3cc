"""Rule graphs too large for a task, made smaller in rounds that grow with the logarithm of their paths.

A vertex with a single way on, or a single way back, is a pointer. Pointer jumping doubles the length of
all pointers in one join, so a path of a million edges is one edge after some twenty rounds. What is left,
where paths branch and meet, is walked edge by edge or, once small enough, handed to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.session import materialize

#: contraction goes on while it removes at least one edge in so many
WORTHWHILE = 8


#: values of a cycle that an error names
NAMED = 32


class Cycle(ValueError):
    """Pointers that never end."""


def cycle_text(attribute: str, values: Sequence[str], whole: bool = True) -> str:
    way = [*map(repr, values[:NAMED]), repr(values[0]) if whole and len(values) <= NAMED else "..."]
    return f"rules of attribute {attribute!r} form a cycle: {' -> '.join(way)}"


def _cycle_of(pointers: DataFrame, inside: Row, back: bool) -> Cycle:
    """The cycle that ``inside.next`` lies on. ``back``: pointers lead to older values."""
    start, way = inside["next"], [inside["next"]]
    while len(way) <= NAMED:
        here = pointers.filter((F.col("attribute") == inside["attribute"]) & (F.col("node") == way[-1])).first()
        if here["next"] == start:
            break
        way.append(here["next"])
    whole = len(way) <= NAMED
    return Cycle(cycle_text(inside["attribute"], [way[0], *reversed(way[1:])] if back and whole else way, whole))


def jump(pointers: DataFrame, back: bool = False) -> DataFrame:
    """(attribute, node, end, hops) of materialized ``pointers`` (attribute, node, next, hops): where each
    node's pointers lead in the end, and the sum of hops on the way. A node has one pointer. Pointers that
    form a cycle raise :class:`Cycle`, which names it; ``back`` says that they lead to older values."""
    most = pointers.count().bit_length() + 1
    ended, going = None, pointers
    for _ in range(most):
        known = going if ended is None else going.unionByName(ended.withColumnRenamed("end", "next"))
        on = known.select(
            F.col("attribute").alias("_a"), F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("hops").alias("_hops")
        )
        moved = materialize(
            going.join(on, (F.col("attribute") == F.col("_a")) & (F.col("next") == F.col("_n")), "left").select(
                "attribute", "node", F.coalesce("_next", "next").alias("next"),
                (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_n").isNull().alias("_ended"),
            )
        )
        here = moved.filter("_ended").select("attribute", "node", F.col("next").alias("end"), "hops")
        ended = here if ended is None else ended.unionByName(here)
        going = moved.filter("not _ended").drop("_ended")
        if going.isEmpty():
            return ended
    # after as many steps as there are pointers, every one of the rest leads to a value on a cycle
    raise _cycle_of(pointers, going.first(), back)


def _without(edges: DataFrame, side: str, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select("attribute", F.col("node").alias(side)), ["attribute", side], "left_anti")


def _moved(edges: DataFrame, side: str, ends: DataFrame) -> DataFrame:
    """``edges`` with the values of ``side`` that have an end replaced by it."""
    to = ends.select("attribute", F.col("node").alias(side), F.col("end").alias("_end"))
    joined = edges.join(to, ["attribute", side], "left")
    return joined.select("attribute", *[F.coalesce("_end", c).alias(c) if c == side else F.col(c) for c in ("src", "dst")])


def contract(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``edges`` (attribute, src, dst) with the same ways between the ``kept`` values (attribute, value).

    Two kept values are joined by a path through values that are not kept before exactly if they are
    after. Values that are not kept go if they have a single successor or predecessor, or lead nowhere;
    the result is materialized.
    """
    kept = materialize(kept.select("attribute", "value").distinct())
    edges = materialize(edges.select("attribute", "src", "dst").distinct())
    size = edges.count()
    while size:
        for here, there in (("src", "dst"), ("dst", "src")):
            single = edges.groupBy("attribute", F.col(here).alias("node")).agg(
                F.count("*").alias("_n"), F.max(there).alias("next")
            )
            names = kept.withColumnRenamed("value", "node")
            free = single.filter("_n = 1").join(names, ["attribute", "node"], "left_anti")
            pointers = materialize(free.select("attribute", "node", "next", F.lit(1).cast("long").alias("hops")))
            if not pointers.isEmpty():
                edges = _moved(_without(edges, here, pointers), there, jump(pointers, back=here == "dst")).distinct()
            # what is not kept and has no way on (or back) leads nowhere
            ends = edges.select("attribute", F.col(here).alias("node")).unionByName(names).distinct()
            edges = edges.join(ends.withColumnRenamed("node", there), ["attribute", there], "left_semi")
            edges = materialize(edges)
        before, size = size, edges.count()
        if before - size < max(1, before // WORTHWHILE):
            break
    return edges


def levels(edges: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(attribute, value, level) of materialized acyclic ``edges`` (attribute, src, dst): the longest path that ends in a value.

    A value with one predecessor is one level above it, so these hang on the others as trees and are
    jumped over. Edges between the others carry the length of what they replace. ``finish`` gets
    edges (attribute, src, dst, weight), at most ``most`` an attribute, a null source standing for a lower
    bound, and returns the levels. Raises ValueError on cycles.
    """
    values = edges.select("attribute", F.col("src").alias("value")).union(edges.select("attribute", "dst")).distinct()
    weighted = edges.select("attribute", "src", "dst", F.lit(1).cast("long").alias("weight"))
    hanging: list[DataFrame] = []
    known: list[DataFrame] = []
    while (weighted.groupBy("attribute").count().agg(F.max("count")).first()[0] or 0) > most:
        parents = weighted.groupBy("attribute", F.col("dst").alias("node")).agg(
            F.count("*").alias("_n"), F.max("src").alias("next"), F.max("weight").alias("hops")
        )
        pointers = materialize(parents.filter("_n = 1 and next is not null").drop("_n"))
        if not pointers.isEmpty():
            ends = materialize(jump(pointers, back=True))
            hanging.append(ends)
            to = ends.select("attribute", F.col("node").alias("src"), F.col("end").alias("_end"), F.col("hops").alias("_hops"))
            weighted = (
                _without(weighted, "dst", pointers).join(to, ["attribute", "src"], "left")
                .select(
                    "attribute", F.coalesce("_end", "src").alias("src"), "dst",
                    (F.col("weight") + F.coalesce("_hops", F.lit(0))).alias("weight"),
                )
            )
        else:
            weighted = _peeled(weighted, known)
        weighted = materialize(weighted.groupBy("attribute", "src", "dst").agg(F.max("weight").alias("weight")))
    found = finish(weighted).select("attribute", "value", F.col("level").cast("long").alias("level"))
    for table in known:
        found = found.unionByName(table)
    for ends in reversed(hanging):  # what hangs on a value that was taken out later finds it first
        roots = found.select("attribute", F.col("value").alias("end"), "level")
        below = ends.join(roots, ["attribute", "end"], "left").select(
            "attribute", F.col("node").alias("value"), (F.coalesce("level", F.lit(0)) + F.col("hops")).alias("level")
        )
        found = materialize(found.unionByName(below))
    return values.join(found, ["attribute", "value"], "left").select(
        "attribute", "value", F.coalesce("level", F.lit(0)).cast("int").alias("level")
    )


def _peeled(weighted: DataFrame, known: list[DataFrame]) -> DataFrame:
    """``weighted`` without the values that wait for none; their levels are added to ``known``, and what they
    mean for their successors becomes edges without a source."""
    waiting = weighted.filter("src is not null").select("attribute", F.col("dst").alias("node")).distinct()
    ends = weighted.filter("src is not null").select("attribute", F.col("src").alias("node")).union(weighted.select("attribute", "dst"))
    free = ends.distinct().join(waiting, ["attribute", "node"], "left_anti")
    bounds = weighted.filter("src is null").select("attribute", F.col("dst").alias("node"), F.col("weight").alias("_least"))
    free = free.join(bounds, ["attribute", "node"], "left").select(
        "attribute", "node", F.coalesce("_least", F.lit(0)).alias("level")
    )
    free = materialize(free)
    if free.isEmpty():  # every value waits for another: any way back ends in a cycle
        one = F.max("src").alias("next"), F.lit(1).cast("long").alias("hops")
        pointers = weighted.filter("src is not null").groupBy("attribute", F.col("dst").alias("node")).agg(*one)
        jump(materialize(pointers), back=True)
    known.append(free.withColumnRenamed("node", "value"))
    rest = _without(weighted, "dst", free)
    on = free.select("attribute", F.col("node").alias("src"), F.col("level").alias("_level"))
    joined = rest.join(on, ["attribute", "src"], "left")
    return joined.select(
        "attribute", F.when(F.col("_level").isNull(), F.col("src")).alias("src"), "dst",
        (F.col("weight") + F.coalesce("_level", F.lit(0))).alias("weight"),
    )
