"""The order of one attribute with more rules than the driver compiles, made by the tasks that repair.

The edges are broadcast, at a measured size, and every task makes the bit sets of the window from them: all at
once for a moderate number of values, else those of a value when it is first met, from an index.
Entities are then repaired exactly as under compiled rules, slices of long ones included.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators import rule_graph
from tidemark.operators.reach import Index
from tidemark.operators.repair_scan import Relations, relations_of
from tidemark.operators.rule_graph import _order_of
from tidemark.operators.skew import bytes_of

#: values up to which all bit sets are made at once: their square bits, three times
FULL_VALUES = 10_000
#: bits of the sets that a task keeps otherwise
KEPT_BITS = 2_000_000_000


class Masks:
    """Bit sets by code, made when asked for; those not used for longest go."""

    def __init__(self, make: Callable[[int], int], values: int):
        self.make, self.most = make, max(16, KEPT_BITS // (3 * max(1, values)))
        self.held: OrderedDict[int, int] = OrderedDict()

    def __getitem__(self, code: int) -> int:
        if code in self.held:
            self.held.move_to_end(code)
        else:
            self.held[code] = self.make(code) if code else 0
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[code]


def relations_from(pairs: list[tuple[str, str]], full_values: int) -> Relations:
    """The relations among the codes (ranks) of the values of ``pairs``."""
    values = len({v for p in pairs for v in p})
    if values <= full_values:
        return relations_of(_order_of("", pairs))
    index, everyone = Index(pairs), np.arange(values)

    def bits(hits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(hits, bitorder="little").tobytes(), "little") << 1

    newer = Masks(lambda c: bits(index.reaches(np.full(values, c - 1), everyone)), values)
    older = Masks(lambda c: bits(index.reaches(everyone, np.full(values, c - 1))), values)
    whole = (1 << values + 1) - 1
    apart = Masks(lambda c: whole & ~(older[c] | newer[c]), values)
    apart.held[0] = whole
    return Relations(older, newer, apart)


class SentRules:
    """Broadcast edges of one attribute; ``relations()`` is called once in a task."""

    def __init__(self, broadcast, full_values: int):
        self.broadcast, self.full_values = broadcast, full_values

    def relations(self) -> Relations:
        table = self.broadcast.value
        return relations_from(list(zip(table["src"].to_pylist(), table["dst"].to_pylist())), self.full_values)


def sent_rules(edges: DataFrame) -> SentRules | None:
    """The materialized ``edges`` of one attribute for tasks, None if they are too many."""
    if edges.count() > rule_graph.MAX_TASK_EDGES or bytes_of(edges) > rule_graph.MAX_BROADCAST_BYTES:
        return None
    table = edges.select("src", "dst").toArrow()
    return SentRules(edges.sparkSession.sparkContext.broadcast(table), FULL_VALUES)


def made(relations: Relations | SentRules) -> Relations:
    return relations.relations() if isinstance(relations, SentRules) else relations
