"""Currency rules as a graph: edges, reachability, ranks.

A rule table has the columns ``attribute, src, dst, kind``; ``src`` is the older
value. ``kind`` is ``state`` (an edge of the graph) or ``monotone`` (a declared
direction that orders no values, so it contributes no edge).

Rules of the attributes in use, if of ordinary size, become a :class:`RuleBook`, compiled
on the driver once and shipped to tasks. Larger ones stay DataFrames: attributes are then
compiled one by one in tasks, an attribute too large for a task in its connected parts, and a part too large
for a task is walked by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.contraction import cycle_text, levels
from tidemark.operators.parts import with_parts
from tidemark.operators.skew import bytes_of, row_numbers
from tidemark.session import materialize, small_frame

RULE_SCHEMA = T.StructType(
    [
        T.StructField("attribute", T.StringType(), False),
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
    ]
)
CLOSURE_SCHEMA = "attribute string, src string, dst string, hops int"
RANK_SCHEMA = "attribute string, value string, level int, rank int"

# Largest edge count compiled on the driver, and largest closure listed there;
# they also bound every broadcast of rules.
MAX_DRIVER_EDGES = 10_000
MAX_DRIVER_PAIRS = 200_000
# Largest edge count of one attribute that a task sorts, and largest number of pairs (older values
# times newer values) that bounds a closure listed in a task.
MAX_TASK_EDGES = 500_000
MAX_TASK_PAIRS = 4_000_000
# A rule frame of this measured size is broadcast to the rows.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


class RuleSetTooLarge(ValueError):
    """The rule table has more edges than the driver compiles."""


@dataclass(frozen=True)
class AttributeOrder:
    """The partial order of one attribute, values in rank order.

    ``older[i]``, ``newer[i]`` and ``parents[i]`` are bit sets over value indexes:
    everything below value ``i``, everything above it, and its direct predecessors.
    """

    values: tuple[str, ...]
    levels: tuple[int, ...]
    older: tuple[int, ...]
    newer: tuple[int, ...]
    parents: tuple[int, ...]

    def __len__(self) -> int:
        return len(self.values)


def _bits(mask: int) -> Iterable[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _levels_of(attribute: str, pairs: Iterable[tuple[str, str]]) -> tuple[dict[str, int], dict[str, set[str]]]:
    """Longest path that ends in each value, and the successors of each value."""
    successors: dict[str, set[str]] = {}
    waiting: dict[str, int] = {}
    for src, dst in set(pairs):
        successors.setdefault(src, set()).add(dst)
        successors.setdefault(dst, set())
        waiting[dst] = waiting.get(dst, 0) + 1
    level = {v: 0 for v in successors if not waiting.get(v)}
    ready = list(level)
    placed = 0
    while ready:
        value = ready.pop()
        placed += 1
        for nxt in successors[value]:
            level[nxt] = max(level.get(nxt, 0), level[value] + 1)
            waiting[nxt] -= 1
            if not waiting[nxt]:
                ready.append(nxt)
    if placed != len(successors):
        raise ValueError(cycle_text(attribute, _cycle(successors, {v for v, n in waiting.items() if n})))
    return level, successors


def _cycle(successors: Mapping[str, Iterable[str]], left: set[str]) -> list[str]:
    """One cycle among the values ``left``, each of which has a predecessor among them."""
    before = {dst: src for src in sorted(left) for dst in successors[src] if dst in left}
    value, seen = min(left), {}
    while value not in seen:
        seen[value] = len(seen)
        value = before[value]
    back = list(seen)[seen[value]:]
    return [back[0], *reversed(back[1:])]


def _order_of(attribute: str, pairs: Iterable[tuple[str, str]]) -> AttributeOrder:
    level, successors = _levels_of(attribute, pairs)
    values = tuple(sorted(level, key=lambda v: (level[v], v)))
    index = {v: i for i, v in enumerate(values)}
    parents = [0] * len(values)
    for src, dsts in successors.items():
        for dst in dsts:
            parents[index[dst]] |= 1 << index[src]
    older = [0] * len(values)
    newer = [0] * len(values)
    for i in range(len(values)):  # every parent precedes its child in rank order
        for p in _bits(parents[i]):
            older[i] |= older[p] | (1 << p)
    for i in reversed(range(len(values))):
        for p in _bits(parents[i]):
            newer[p] |= newer[i] | (1 << i)
    return AttributeOrder(
        values, tuple(level[v] for v in values), tuple(older), tuple(newer), tuple(parents)
    )


def _longest_paths(order: AttributeOrder) -> Iterable[tuple[int, int, int]]:
    """(older index, newer index, edges on the longest path between them)."""
    hops: list[dict[int, int]] = []
    for i in range(len(order)):
        best: dict[int, int] = {}
        for p in _bits(order.parents[i]):
            best[p] = max(best.get(p, 1), 1)
            for o, n in hops[p].items():
                best[o] = max(best.get(o, 0), n + 1)
        hops.append(best)
        yield from ((o, i, n) for o, n in best.items())


class RuleBook:
    """Rules of any number of attributes, held by the driver and checked for cycles.

    Books of up to ``MAX_DRIVER_EDGES`` edges are compiled at once; of larger ones the
    attributes in use may still be (see :meth:`only`).
    """

    def __init__(
        self,
        states: Mapping[str, Iterable[tuple[str, str]]],
        monotone: Mapping[str, tuple[str, str]] | None = None,
    ):
        self.states = {a: tuple(dict.fromkeys(map(tuple, p))) for a, p in states.items()}
        self.monotone = dict(monotone or {})
        self.edges = sum(map(len, self.states.values()))
        self._orders: dict[str, AttributeOrder] = {}
        for attribute, pairs in self.states.items():
            if self.edges <= MAX_DRIVER_EDGES:
                self._orders[attribute] = _order_of(attribute, pairs)
            else:
                _levels_of(attribute, pairs)

    @classmethod
    def from_frame(cls, rules: DataFrame, attributes: Sequence[str] | None = None) -> RuleBook:
        """Collect a rule table, or its rules of some attributes; no more than ``MAX_DRIVER_EDGES`` edges."""
        table = _with_kind(rules)
        if attributes is not None:
            table = table.filter(F.col("attribute").isin(list(attributes)))
        rows = table.distinct().limit(MAX_DRIVER_EDGES + 1).collect()
        if len(rows) > MAX_DRIVER_EDGES:
            raise RuleSetTooLarge(f"more than {MAX_DRIVER_EDGES} rule edges")
        states: dict[str, list[tuple[str, str]]] = {}
        monotone = {}
        for r in rows:
            if r["kind"] == "monotone":
                monotone[r["attribute"]] = (r["src"], r["dst"])
            else:
                states.setdefault(r["attribute"], []).append((r["src"], r["dst"]))
        return cls(states, monotone)

    def only(self, attributes: Sequence[str]) -> RuleBook:
        """The rules of some attributes."""
        if set(self.states) <= set(attributes):
            return self
        return RuleBook(
            {a: p for a, p in self.states.items() if a in attributes},
            {a: p for a, p in self.monotone.items() if a in attributes},
        )

    def order(self, attribute: str) -> AttributeOrder:
        """Order of an attribute; empty (nothing comparable) without state rules."""
        if attribute not in self._orders:
            self._orders[attribute] = _order_of(attribute, self.states.get(attribute, ()))
        return self._orders[attribute]

    def closure_pairs(self) -> int:
        return sum(mask.bit_count() for a in self.states for mask in self.order(a).older)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(a, s, d, "state") for a, pairs in self.states.items() for s, d in pairs]
        rows += [(a, s, d, "monotone") for a, (s, d) in self.monotone.items()]
        return small_frame(spark, rows, RULE_SCHEMA)

    def codes(self, spark: SparkSession, attributes: Iterable[str]) -> DataFrame:
        """``attribute, value, code``: 1-based rank of every ruled value."""
        rows = [
            (a, v, i + 1) for a in dict.fromkeys(attributes) for i, v in enumerate(self.order(a).values)
        ]
        return small_frame(spark, rows, "attribute string, value string, code int")

    def closure(self, spark: SparkSession) -> DataFrame:
        rows = []
        for a in self.states:
            order = self.order(a)
            rows += [(a, order.values[o], order.values[i], n) for o, i, n in _longest_paths(order)]
        return small_frame(spark, rows, CLOSURE_SCHEMA)

    def ranks(self, spark: SparkSession) -> DataFrame:
        rows = [
            (a, v, order.levels[i], i + 1)
            for a, order in ((a, self.order(a)) for a in self.states)
            for i, v in enumerate(order.values)
        ]
        return small_frame(spark, rows, RANK_SCHEMA)


def _with_kind(rules: DataFrame) -> DataFrame:
    kind = F.col("kind") if "kind" in rules.columns else F.lit("state")
    return rules.select("attribute", "src", "dst", F.coalesce(kind, F.lit("state")).alias("kind"))


def rule_edges(rules: DataFrame, attribute: str | None = None) -> DataFrame:
    """Distinct state edges, of one attribute if named. Monotone rules have none."""
    edges = _with_kind(rules).filter(F.col("kind") == "state")
    if attribute is not None:
        edges = edges.filter(F.col("attribute") == attribute)
    return edges.select("attribute", "src", "dst").distinct()


def compile_rules(
    rules: RuleBook | DataFrame | Mapping, attributes: Sequence[str] | None = None
) -> RuleBook | None:
    """A RuleBook for driver-sized rules (of ``attributes``, if given), None when they must stay distributed."""
    if isinstance(rules, DataFrame):
        try:
            return RuleBook.from_frame(rules, attributes)
        except RuleSetTooLarge:
            return None
    book = rules if isinstance(rules, RuleBook) else RuleBook(rules)
    book = book if attributes is None else book.only(attributes)
    return book if book.edges <= MAX_DRIVER_EDGES else None


def rules_in_use(
    rules: RuleBook | DataFrame, attributes: Sequence[str], spark: SparkSession
) -> RuleBook | DataFrame:
    """The rules of some attributes, compiled, or as a materialized table of state edges if there
    are too many (see :func:`in_parts`). Cyclic rules raise ValueError either way."""
    if isinstance(rules, DataFrame):  # computed once, to be counted and used
        rules = materialize(_with_kind(rules).filter(F.col("attribute").isin(list(attributes))).distinct())
    if not isinstance(rules, DataFrame) or rules.count() <= MAX_DRIVER_EDGES:
        book = compile_rules(rules, attributes)
        if book is not None:
            return book
    if isinstance(rules, RuleBook):
        edges = materialize(rule_edges(rules.only(attributes).frame(spark)))
    else:
        edges = rules.filter(F.col("kind") == "state").select("attribute", "src", "dst")
    edges = in_parts(edges)
    check_acyclic(edges)
    return edges


def in_parts(edges: DataFrame) -> DataFrame:
    """Materialized ``edges`` (attribute, src, dst) as they are if every attribute fits a task; else with the
    column ``_part``, which tells the connected parts of the others (0 in those that fit)."""
    if "_part" in edges.columns:
        return edges
    ordinary, large = _by_size(edges, F.count("*"), MAX_TASK_EDGES)
    if large is None:
        return edges
    return materialize(with_parts(large).unionByName(ordinary.withColumn("_part", F.lit(0).cast("long"))))


def units(edges: DataFrame) -> list[str]:
    """The columns that tell graphs apart."""
    return [c for c in ("attribute", "_part") if c in edges.columns]


def small(frame: DataFrame) -> DataFrame:
    """``frame``, marked for a broadcast if its measured size allows it."""
    return F.broadcast(frame) if bytes_of(frame) <= MAX_BROADCAST_BYTES else frame


def _by_size(edges: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the attributes, or of their parts, with a ``size`` of up to ``most``, and of the others (None if
    there are none)."""
    by = units(edges)
    sizes = edges.groupBy(*by).agg(size.alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        return edges, None
    # few, as each has so many edges: broadcast, since one attribute may have all rows
    large = F.broadcast(sizes.filter(F.col("_n") > most).select(*by))
    return edges.join(large, by, "left_anti"), materialize(edges.join(large, by, "left_semi"))


def per_attribute(edges: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Rows that ``work(attribute, pairs)`` yields for the edges of each attribute, or part of one, many a task.
    ``edges`` has the columns ``attribute, src, dst`` and perhaps more, which the pairs then carry."""
    by = units(edges)
    names = [c for c in edges.columns if c not in by]
    part = F.col("_part") if "_part" in by else F.lit(0)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), arrow.types)]
            out.clear()
            return pa.record_batch(columns, names=arrow.names)

        def worked(attribute: str, pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
            for row in work(attribute, pairs):
                out.append(row)
                if len(out) >= 50_000:
                    yield flushed()

        at, pairs = None, []
        for batch in batches:
            attributes, parts, *columns = (batch.column(c).to_pylist() for c in range(batch.num_columns))
            for here, pair in zip(zip(attributes, parts), zip(*columns)):
                if here != at:
                    if pairs:
                        yield from worked(at[0], pairs)
                    at, pairs = here, []
                pairs.append(pair)
        if pairs:
            yield from worked(at[0], pairs)
        if out:
            yield flushed()

    sorted_edges = edges.repartition(*by).sortWithinPartitions(*by).select("attribute", part.alias("_part"), *names)
    return sorted_edges.mapInArrow(run, schema)


def _task_ranks(attribute: str, pairs: list[tuple[str, str]]) -> Iterator[tuple]:
    try:
        level, _ = _levels_of(attribute, pairs)
    except ValueError as cycle:  # told by a row, so that the driver raises it
        yield attribute, str(cycle), -1, -1
        return
    for i, v in enumerate(sorted(level, key=lambda v: (level[v], v)), 1):
        yield attribute, v, level[v], i


def _task_closure(attribute: str, pairs: list[tuple[str, str]]) -> Iterator[tuple]:
    try:
        order = _order_of(attribute, pairs)
    except ValueError as cycle:
        yield attribute, str(cycle), None, -1
        return
    for o, i, n in _longest_paths(order):
        yield attribute, order.values[o], order.values[i], n


def _task_levels(attribute: str, edges: list[tuple[str | None, str, int]]) -> Iterator[tuple]:
    """Longest weighted path that ends in each value; an edge without a source is a lower bound."""
    successors: dict[str, list[tuple[str, int]]] = {}
    waiting: dict[str, int] = {}
    level: dict[str, int] = {}
    for src, dst, weight in edges:
        successors.setdefault(dst, [])
        if src is None:
            level[dst] = max(level.get(dst, 0), weight)
        else:
            successors.setdefault(src, []).append((dst, weight))
            waiting[dst] = waiting.get(dst, 0) + 1
    ready = [v for v in successors if not waiting.get(v)]
    placed = 0
    while ready:
        value = ready.pop()
        placed += 1
        for dst, weight in successors[value]:
            level[dst] = max(level.get(dst, 0), level.get(value, 0) + weight)
            waiting[dst] -= 1
            if not waiting[dst]:
                ready.append(dst)
    if placed != len(successors):
        names = {v: [d for d, _ in to] for v, to in successors.items()}
        yield attribute, cycle_text(attribute, _cycle(names, {v for v, n in waiting.items() if n})), -1
        return
    for v in successors:
        yield attribute, v, level.get(v, 0)


def _told(rows: DataFrame, number: str, text: str) -> DataFrame:
    """``rows``, once no task has told a cycle."""
    bad = rows.filter(F.col(number) < 0).first()
    if bad is not None:
        raise ValueError(bad[text])
    return rows


def _task_cycle(attribute: str, pairs: list[tuple[str, str]]) -> Iterator[tuple]:
    try:
        _levels_of(attribute, pairs)
    except ValueError as cycle:
        yield (str(cycle),)


def _levels_by_joins(edges: DataFrame) -> DataFrame:
    """Levels of the values of materialized ``edges`` too large for a task; raises ValueError on cycles."""

    def finish(weighted: DataFrame) -> DataFrame:
        return _told(materialize(per_attribute(weighted, _task_levels, "attribute string, value string, level long")), "level", "value")

    return materialize(levels(edges.drop("_part"), MAX_TASK_EDGES, finish))


def _distributed_ranks(edges: DataFrame) -> DataFrame:
    """Ranks of a materialized edge table; raises ValueError on cycles."""
    edges = in_parts(edges)
    ordinary, large = _by_size(edges, F.count("*"), MAX_TASK_EDGES)
    ranks = _told(materialize(per_attribute(ordinary, _task_ranks, RANK_SCHEMA)), "rank", "value")
    if "_part" not in ordinary.columns:
        return ranks
    parted = F.broadcast(edges.filter("_part <> 0").select("attribute").distinct())
    leveled = ranks.join(parted, "attribute", "left_semi").select("attribute", "value", "level")
    if large is not None:
        leveled = leveled.unionByName(_levels_by_joins(large))
    ranked = row_numbers(leveled, ["attribute"], [F.col("level"), F.col("value")], "rank")
    return ranks.join(parted, "attribute", "left_anti").unionByName(
        ranked.select("attribute", "value", F.col("level").cast("int"), F.col("rank").cast("int"))
    )


def check_acyclic(edges: DataFrame) -> None:
    """Raise ValueError if an edge table of any size has a cycle."""
    ordinary, large = _by_size(in_parts(edges), F.count("*"), MAX_TASK_EDGES)
    cycle = per_attribute(ordinary, _task_cycle, "cycle string").agg(F.min("cycle")).first()[0]
    if cycle is not None:
        raise ValueError(cycle)
    if large is not None:
        _levels_by_joins(large)


def rule_closure(rules: RuleBook | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Transitive closure with the longest path length of each pair.

    Columns ``attribute, src, dst, hops``. Raises ValueError on cyclic rules.
    """
    book = compile_rules(rules)
    if book is not None:
        spark = spark or rules.sparkSession
        if book.closure_pairs() <= MAX_DRIVER_PAIRS:
            return book.closure(spark)
        rules = book
    if not isinstance(rules, DataFrame):
        rules = rules.frame(spark)
    return _closure_of(materialize(rule_edges(rules)))


def _closure_of(edges: DataFrame) -> DataFrame:
    """Closure of a materialized edge table; raises ValueError on cycles."""
    ordinary, large = _by_size(edges, F.count_distinct("src") * F.count_distinct("dst"), MAX_TASK_PAIRS)
    pairs = _told(materialize(per_attribute(ordinary, _task_closure, CLOSURE_SCHEMA)), "hops", "src")
    if large is None:
        return pairs
    check_acyclic(large)
    return pairs.unionByName(_closure_by_joins(large.drop("_part")))


def _closure_by_joins(edges: DataFrame) -> DataFrame:
    # Path doubling: round k knows every path of up to 2^k edges, so the number
    # of rounds is the logarithm of the longest path. Only pairs of which one half
    # was found or lengthened in the last round can give something new.
    paths = materialize(edges.withColumns({"hops": F.lit(1), "round": F.lit(0)}))
    current = 0
    while True:
        news = paths.agg(
            F.count_if(F.col("round") == current).alias("pairs"),
            F.count_if(F.col("src") == F.col("dst")).alias("loops"),
        ).first()
        if news["loops"]:
            raise ValueError("rules form a cycle")
        if not news["pairs"]:
            return paths.drop("round")
        left = paths.select(
            "attribute", "src", F.col("dst").alias("mid"), "hops", F.col("round").alias("left_round")
        )
        right = paths.select(
            "attribute", F.col("src").alias("mid"), "dst", F.col("hops").alias("more"), "round"
        )
        longer = (
            left.join(right, ["attribute", "mid"])
            .filter((F.col("left_round") == current) | (F.col("round") == current))
            .select("attribute", "src", "dst", (F.col("hops") + F.col("more")).alias("hops"))
        )
        current += 1
        # Longest first; on a tie the older round stays. Packed into one number
        # so that the maximum is a hash aggregate; 64 rounds cover 2^64 edges.
        best = F.max(F.col("hops").cast("long") * 64 - F.col("round"))
        paths = materialize(
            paths.unionByName(longer.withColumn("round", F.lit(current)))
            .groupBy("attribute", "src", "dst")
            .agg(best.alias("best"))
            .withColumn("hops", F.ceil(F.col("best") / 64).cast("int"))
            .select("attribute", "src", "dst", "hops", (F.col("hops") * 64 - F.col("best")).cast("int").alias("round"))
        )


def rule_rank(
    rules: RuleBook | DataFrame, spark: SparkSession | None = None
) -> DataFrame:
    """Linear extension of each attribute: ``attribute, value, level, rank``.

    ``level`` is the longest path that ends in the value, ``rank`` the 1-based
    position by (level, value).
    """
    book = compile_rules(rules)
    if book is not None:
        return book.ranks(spark or rules.sparkSession)
    if not isinstance(rules, DataFrame):
        rules = rules.frame(spark)
    return _distributed_ranks(materialize(rule_edges(rules)))
