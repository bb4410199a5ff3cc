"""The order test: which of two values is older, without listing all ordered pairs.

Up to a closure of ``MAX_DRIVER_PAIRS`` the pairs are listed and broadcast. Beyond it, the distinct pairs of the
rows are tested. If the attribute's edges fit a task, they go to the tasks that hold the pairs, under as many salts
as the pairs need, and each task builds an index (:class:`Index`). Otherwise the attribute's connected parts do so,
and pairs of two parts are not ordered. In a part that does not fit a task, pairs whose levels leave the
question open are searched by joins, over the rules contracted to the values of these pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rule_graph
from tidemark.operators.contraction import contract
from tidemark.operators.parts import part_of_values
from tidemark.operators.rule_graph import (
    RuleBook,
    _by_size,
    _distributed_ranks,
    _levels_of,
    in_parts,
    rule_edges,
    rules_in_use,
    small,
)
from tidemark.session import materialize

#: pairs that meet the edges in one task, about
TASK_PAIRS = 100_000
#: numbers a table of chains may hold; wider graphs get interval labels and a search
CHAIN_CELLS = 20_000_000
INTERVALS = 3
#: edges up to which a task makes the set of all values that a value reaches
FEW_EDGES = 2_000


class Index:
    """Reachability in one acyclic graph.

    A graph of few chains (paths that together hold all values) has a table with, for each value and chain, the first
    place of the chain that the value reaches: an exact answer by one look-up. A wide graph has, for each
    value, its level and intervals of several depth-first orders. A value reaches only values whose
    intervals lie in its own, and all values below it in the first order's tree. Pairs that neither
    decides are searched, along values that the labels do not rule out.
    """

    def __init__(self, pairs: list[tuple[str, str]], cells: int | None = None):
        level, successors = _levels_of("", pairs)
        values = sorted(level, key=lambda v: (level[v], v))
        self.number = {v: i for i, v in enumerate(values)}
        self.level = np.array([level[v] for v in values])
        self.after = [sorted(self.number[d] for d in successors[v]) for v in values]
        self._chains()
        if len(values) * self.chains <= (CHAIN_CELLS if cells is None else cells):
            self._fill_table()
        else:
            self.table = None
            self._label()

    def _chains(self) -> None:
        """Each value goes on the end of a chain whose last value precedes it, or begins one."""
        n = len(self.after)
        self.chain, self.place = np.full(n, -1), np.zeros(n, int)
        last: list[int] = []  # the last value of each chain
        for v in range(n):
            if self.chain[v] < 0:
                self.chain[v] = len(last)
                last.append(v)
            c = self.chain[v]
            if last[c] == v:  # give the chain on to a successor that has none
                for w in self.after[v]:
                    if self.chain[w] < 0:
                        self.chain[w], self.place[w], last[c] = c, self.place[v] + 1, w
                        break
        self.chains = len(last)

    def _fill_table(self) -> None:
        n = len(self.after)
        self.table = np.full((n, self.chains), n, np.int32)
        for v in range(n - 1, -1, -1):
            if self.after[v]:
                self.table[self.after[v]].min(axis=0, out=self.table[v])
            self.table[v, self.chain[v]] = self.place[v]

    def _label(self) -> None:
        n, random = len(self.after), np.random.default_rng(7)
        roots = np.setdiff1d(np.arange(n), np.concatenate([np.array(a, int) for a in self.after if a] or [np.zeros(0, int)]))
        self.low, self.post = np.zeros((INTERVALS, n), int), np.zeros((INTERVALS, n), int)
        for k in range(INTERVALS):
            seen, clock = np.zeros(n, bool), 0
            entered = np.zeros(n, int)
            for root in random.permutation(roots).tolist():
                todo = [(root, False)]
                while todo:
                    v, done = todo.pop()
                    if done:
                        own = [self.low[k, w] for w in self.after[v]]
                        self.post[k, v] = clock
                        self.low[k, v] = min(own, default=clock)
                        clock += 1
                    elif not seen[v]:
                        seen[v], entered[v] = True, clock
                        todo.append((v, True))
                        following = [w for w in self.after[v] if not seen[w]]
                        todo += [(w, False) for w in random.permutation(following).tolist()]
            if k == 0:  # the tree below a value: what was entered after it and left before it
                self.entered = entered

    def _may(self, u, v):
        inside = self.level[u] < self.level[v]
        for k in range(INTERVALS):
            inside &= (self.low[k, u] <= self.low[k, v]) & (self.post[k, v] <= self.post[k, u])
        return inside

    def _below(self, u, v):
        return (self.entered[u] <= self.post[0, v]) & (self.post[0, v] < self.post[0, u])

    def reaches(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For arrays of value numbers: is there a path of at least one edge from u to v?"""
        if self.table is not None:
            return (u != v) & (self.table[u, self.chain[v]] <= self.place[v])
        out = self._below(u, v)
        for k in np.flatnonzero(self._may(u, v) & ~out).tolist():
            out[k] = self._search(int(u[k]), int(v[k]))
        return out

    def _search(self, u: int, v: int) -> bool:
        seen, todo = {u}, [u]
        while todo:
            for w in self.after[todo.pop()]:
                if w == v or self._below(w, v):
                    return True
                if w not in seen and self._may(w, v):
                    seen.add(w)
                    todo.append(w)
        return False


def _below(pairs: list[tuple[str, str]]) -> tuple[dict[str, int], list[int]]:
    """Numbers of the values of a small graph, and the values that each reaches, as bits."""
    level, successors = _levels_of("", pairs)
    values = sorted(level, key=level.__getitem__, reverse=True)
    number = {v: i for i, v in enumerate(values)}
    below = []
    for v in values:
        mask = 0
        for w in successors[v]:
            mask |= below[number[w]] | 1 << number[w]
        below.append(mask)
    return number, below


def _ordered(edges: list[tuple[str, str]], pairs: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(a, b, relation) of the ``pairs`` that ``edges`` order."""
    if len(edges) <= FEW_EDGES:
        number, below = _below(edges)
        for a, b in pairs:
            u, v = number.get(a), number.get(b)
            if u is not None and v is not None and u != v:
                if below[u] >> v & 1:
                    yield a, b, "<"
                elif below[v] >> u & 1:
                    yield a, b, ">"
        return
    index = Index(edges)
    known = [(a, b) for a, b in pairs if a in index.number and b in index.number]
    if not known:
        return
    u, v = np.array([(index.number[a], index.number[b]) for a, b in known]).T
    forward = index.reaches(u, v)
    backward = np.zeros(len(u), bool)
    backward[~forward] = index.reaches(v[~forward], u[~forward])
    for k in np.flatnonzero(forward | backward).tolist():
        yield *known[k], "<" if forward[k] else ">"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a part and salt, then its pairs: the pairs that are ordered, with their relation."""
    at, edges, pairs, out = None, [], [], []

    def flushed():
        batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*out)], ["_a", "_b", "_rel"])
        out.clear()
        return batch

    for batch in batches:
        parts, salts, kinds, a, b = (batch.column(c).to_pylist() for c in range(5))
        for here, kind, pair in zip(zip(parts, salts), kinds, zip(a, b)):
            if here != at:
                if edges and pairs:
                    out.extend(_ordered(edges, pairs))
                    if len(out) >= 50_000:
                        yield flushed()
                at, edges, pairs = here, [], []
            (pairs if kind else edges).append(pair)
    if edges and pairs:
        out.extend(_ordered(edges, pairs))
    if out:
        yield flushed()


def ordered_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(_a, _b, _rel) of the distinct materialized ``pairs`` (_a, _b) that the materialized acyclic ``edges``
    (attribute, src, dst; one attribute) order; ``_rel`` is < or >."""
    edges = in_parts(edges)
    ordinary, large = _by_size(edges, F.count("*"), rule_graph.MAX_TASK_EDGES)
    if "_part" in edges.columns:
        values = part_of_values(edges).select(F.col("value").alias("_v"), "_part")
        ends = [values.select(F.col("_v").alias(c), F.col("_part").alias(f"_part{c}")) for c in ("_a", "_b")]
        pairs = pairs.join(ends[0], "_a").join(ends[1], "_b").filter("_part_a = _part_b")
        pairs = materialize(pairs.select("_a", "_b", F.col("_part_a").alias("_part")))
    else:
        ordinary, pairs = (x.withColumn("_part", F.lit(0).cast("long")) for x in (ordinary, pairs))
    salts = pairs.groupBy("_part").agg(F.ceil(F.count("*") / TASK_PAIRS).cast("int").alias("_salts"))
    salts = materialize(salts.join(ordinary.select("_part").distinct(), "_part", "left_semi"))
    copies = ordinary.join(salts, "_part").select(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"),
        F.col("src").alias("_a"), F.col("dst").alias("_b"),
    )
    rows = pairs.join(small(salts), "_part").select(
        "_part", F.pmod(F.xxhash64("_a", "_b"), F.col("_salts")).cast("int").alias("_salt"), F.lit(1).alias("_kind"), "_a", "_b"
    )
    found = (
        copies.unionByName(rows).repartition("_part", "_salt").sortWithinPartitions("_part", "_salt", "_kind")
        .mapInArrow(_answer, "_a string, _b string, _rel string")
    )
    if large is None:
        return found
    rest = materialize(pairs.join(F.broadcast(large.select("_part").distinct()), "_part", "left_semi").select("_a", "_b"))
    return found.unionByName(_by_search(rest, large.drop("_part")))


def _by_search(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    ranks = _distributed_ranks(edges).select("value", "level")
    levels = small(materialize(ranks))
    levels = levels.select(F.col("value").alias("_v"), F.col("level").alias("_l"))

    def leveled(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(levels, F.col(column) == F.col("_v")).drop("_v").withColumnRenamed("_l", name)

    open_ = leveled(leveled(pairs, "_a", "_la"), "_b", "_lb").filter("_la <> _lb")
    older = F.col("_la") < F.col("_lb")
    asked = materialize(
        open_.select(
            F.when(older, F.col("_a")).otherwise(F.col("_b")).alias("_from"),
            F.when(older, F.col("_b")).otherwise(F.col("_a")).alias("_to"),
            F.greatest("_la", "_lb").alias("_end"),
        ).distinct()
    )
    ends = asked.select(F.col("_from").alias("value")).union(asked.select("_to")).distinct()
    attribute = edges.first()["attribute"]
    steps = contract(edges, ends.withColumn("attribute", F.lit(attribute)))
    steps = leveled(steps.select(F.col("src").alias("_at"), "dst"), "dst", "_here")
    steps = small(materialize(steps))
    frontier = asked.withColumn("_at", F.col("_from"))
    found: list[DataFrame] = []
    while True:
        reached = materialize(
            frontier.join(steps, "_at")
            .filter((F.col("dst") == F.col("_to")) | (F.col("_here") < F.col("_end")))
            .select("_from", "_to", "_end", F.col("dst").alias("_at")).distinct()
        )
        hits = reached.filter("_at = _to").select("_from", "_to")
        found.append(hits)
        frontier = reached.join(hits, ["_from", "_to"], "left_anti")
        if frontier.isEmpty():
            break
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    forward = together.select(F.col("_from").alias("_a"), F.col("_to").alias("_b"), F.lit("<").alias("_rel"))
    backward = together.select(F.col("_to").alias("_a"), F.col("_from").alias("_b"), F.lit(">").alias("_rel"))
    return forward.unionByName(backward).join(pairs, ["_a", "_b"], "left_semi")


def relation(
    df: DataFrame, left: str, right: str, attribute: str, rules: RuleBook | DataFrame, name: str = "relation"
) -> DataFrame:
    """Add ``<``, ``>`` or ``<>``: is ``left`` older than, newer than or incomparable to ``right``."""
    spark = df.sparkSession
    used = rules_in_use(rules, [attribute], spark)
    lhs, rhs = F.col(left).cast("string"), F.col(right).cast("string")
    if isinstance(used, RuleBook) and used.closure_pairs() <= rule_graph.MAX_DRIVER_PAIRS:
        closure = used.closure(spark).filter(F.col("attribute") == attribute)
        forward = closure.select(F.col("src").alias("_ra"), F.col("dst").alias("_rb"), F.lit("<").alias("_rel"))
        backward = closure.select(F.col("dst").alias("_ra"), F.col("src").alias("_rb"), F.lit(">").alias("_rel"))
        related = F.broadcast(forward.unionByName(backward))
    else:
        edges = used if isinstance(used, DataFrame) else materialize(rule_edges(used.frame(spark)))
        pairs = df.select(lhs.alias("_a"), rhs.alias("_b")).filter("_a <> _b").distinct()
        related = small(materialize(ordered_pairs(materialize(pairs), edges)))
        related = related.withColumnsRenamed({"_a": "_ra", "_b": "_rb"})
    joined = df.join(related, (lhs == F.col("_ra")) & (rhs == F.col("_rb")), "left")
    return joined.withColumn(name, F.coalesce("_rel", F.lit("<>"))).drop("_ra", "_rb", "_rel")
