"""Temporal error detection and repair.

A reference attribute orders the versions of an entity; wrong values of a repair
attribute show as steps backwards in that order and are corrected by a sliding
window. Rows are first aggregated to runs (see ``ordering``), the window scans
runs (see ``repair_scan``), and only changed runs are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.histogram import MAX_MASK_VALUES, related_pairs, text_array
from tidemark.operators.names import distinct_names, given, inner_keys, neutral
from tidemark.operators.ordering import repair_keys, run_order, value_ranks
from tidemark.operators.reach import relation
from tidemark.operators.repair_scan import (
    NONE,
    Relations,
    State,
    relations_of,
    scan_stream,
    slice_summaries,
)
from tidemark.operators.rule_graph import RuleBook, _order_of, rules_in_use
from tidemark.operators.sent_rules import SentRules, made, sent_rules
from tidemark.operators.skew import bytes_of, hot_runs, join_runs, slices, split_groups, with_next
from tidemark.session import materialize

# An entity with more runs than this is cut into slices that are scanned in parallel.
MAX_ENTITY_RUNS = 1_000_000

# Changed runs up to this size are broadcast to the rows; more are shuffled.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

RUN = ["_ref", "_ref_odd", "_rep"]


def detect_errors(
    df: DataFrame,
    keys: Sequence[str],
    vid: str,
    reference: str,
    repair: str,
    rules: RuleBook | DataFrame,
    max_group_rows: int | None = None,
    names: tuple[str, str, str] = ("next_vid", "value", "next_value"),
) -> DataFrame:
    """Neighbouring versions, in repair order, whose repair value goes backwards.

    Columns ``keys, vid`` and ``names``: the next version and both values. Neighbours
    inside a run are equal, so only the ends of runs are compared.
    """
    distinct_names([*keys, vid, *names])
    inner = inner_keys(keys)
    used = rules_in_use(rules, [reference, repair], df.sparkSession)
    rows = neutral(df, keys, _vid=vid, _reference=reference, _repaired=repair)
    runs = materialize(
        repair_keys(rows, reference, repair, value_ranks(used, [reference, repair], df))
        .withColumn("_value", F.col("_repaired").cast("string"))
        .groupBy(*inner, "_ref", "_ref_odd", "_rep", "_rep_odd", "_value")
        .agg(F.min("_vid").alias("_first"), F.max("_vid").alias("_vid"))
    )
    pairs = with_next(
        runs, inner, run_order(), {"_first": "_next_vid", "_value": "_next_value"}, max_group_rows
    )
    related = relation(pairs, "_value", "_next_value", repair, used, "_relation")
    out = {"_vid": vid, "_next_vid": names[0], "_value": names[1], "_next_value": names[2]}
    return given(related.filter(F.col("_relation") == ">"), keys, out)


def repair(
    df: DataFrame,
    keys: Sequence[str],
    vid: str,
    reference: str,
    repair: str,
    rules: RuleBook | DataFrame,
    compress_runs: bool = False,
    max_entity_runs: int | None = None,
    min_hot_rows: int | None = None,
) -> DataFrame:
    """``df`` with the ``repair`` column corrected; every row is kept.

    ``keys`` identify an entity and ``(keys, vid)`` a row. With ``compress_runs``
    a run has one vote however many rows it has, and all its rows take the
    repaired value; this is a different algorithm, not a faster form of the
    default. If the rules of the two attributes are too many for the driver, tasks make the order from
    broadcast edges; if they are too many for that, too, each entity is scanned with the order of its own
    values only.

    When many runs change, the rows are shuffled whole. Where they are wide, repair the
    narrow columns with :func:`repaired_cells` and put them back with :func:`join_back`,
    or keep the table bucketed by entity.
    """
    inner = inner_keys(keys)
    used = rules_in_use(rules, [reference, repair], df.sparkSession)
    ranks = value_ranks(used, [reference, repair], df)
    named = {"_vid": vid, "_reference": reference, "_repaired": repair}
    wide = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keys, inner)],
        *[F.col(f"`{c}`").alias(n) for n, c in named.items()],
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
    )
    rows = repair_keys(wide, reference, repair, ranks)
    runs = materialize(_runs(rows, inner, "_vid", compress_runs))
    limit = max_entity_runs or MAX_ENTITY_RUNS
    votes = runs.drop("_rows")
    if isinstance(used, RuleBook):
        relations = relations_of(used.order(repair))
    else:
        relations = sent_rules(materialize(used.filter(F.col("attribute") == repair)))
    if relations is not None:
        ordinary, large, total = split_groups(votes, inner, limit)
        scanned = _scan_by_entity(ordinary, inner, relations)
        if large is not None:
            scanned = scanned.unionByName(_scan_by_slice(large, inner, relations, total, limit))
    else:
        scanned = _scan_with_own_rules(votes, inner, repair, used, ranks)
    if compress_runs:
        scanned = scanned.withColumn("_body", F.col("_last"))

    on = [*inner, *RUN]
    changed = scanned.filter((F.col("_body") != F.col("_rep")) | (F.col("_last") != F.col("_rep"))).select(
        *on, "_body", "_last", "_last_vid"
    )
    texts = ranks.filter(F.col("attribute") == repair)
    listed = isinstance(used, RuleBook) and len(used.order(repair)) <= MAX_MASK_VALUES
    for code in ("_body", "_last"):
        if listed:
            value = f"get({text_array(used.order(repair).values)}, {code} - 1)"
            changed = changed.withColumn(f"{code}_text", F.expr(value))
            continue
        text = texts.select(F.col("code").alias(f"_c{code}"), F.col("value").alias(f"{code}_text"))
        changed = changed.join(text, F.col(code) == F.col(f"_c{code}"), "left").drop(f"_c{code}")
    changed = materialize(changed)
    if bytes_of(changed) <= MAX_BROADCAST_BYTES:
        joined = join_runs(rows, F.broadcast(changed), on, "_vid", None)
    else:
        size = runs.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("largest")).first()
        hot = hot_runs(runs, "_rows", size["total"] or 0, size["largest"] or 0, min_hot_rows)
        if hot is not None:  # unchanged hot runs too: their rows must be scattered as well
            keep = hot.select(*on, F.col("_rep").alias("_kept"), F.col("_last_vid").alias("_kept_vid"))
            hot = join_runs(keep, changed, on, "_kept_vid", None).select(
                *on,
                F.coalesce("_body", "_kept").alias("_body"),
                F.coalesce("_last", "_kept").alias("_last"),
                F.col("_kept_vid").alias("_last_vid"),
                "_body_text",
                "_last_text",
            )
        joined = join_runs(rows, changed, on, "_vid", hot)

    is_last = F.col("_vid") == F.col("_last_vid")
    code = F.when(is_last, F.col("_last")).otherwise(F.col("_body"))
    value = F.when(is_last, F.col("_last_text")).otherwise(F.col("_body_text")).cast(df.schema[repair].dataType)
    own = F.col("_row")[repair]
    fixed = F.when(F.col("_body").isNotNull() & (code != F.col("_rep")), value).otherwise(own)
    return joined.select(*[fixed.alias(c) if c == repair else F.col("_row")[c].alias(c) for c in df.columns])


def _runs(rows: DataFrame, keys: Sequence[str], vid: str, compress: bool) -> DataFrame:
    """Runs with ``_votes``, ``_rows`` and ``_last_vid``.

    Values outside the rules are all incomparable and never change, so they form
    one run per reference group. That bounds the runs of an entity by the rules,
    except for reference values outside them.
    """
    if not compress:
        return rows.groupBy(*keys, *RUN).agg(
            F.count("*").alias("_votes"), F.count("*").alias("_rows"), F.max(vid).alias("_last_vid")
        )
    single = rows.groupBy(*keys, *RUN, "_rep_odd").agg(
        F.count("*").alias("_rows"), F.max(vid).alias("_last_vid")
    )
    return single.groupBy(*keys, *RUN).agg(
        F.count("*").alias("_votes"), F.sum("_rows").alias("_rows"), F.max("_last_vid").alias("_last_vid")
    )


def _scan_schema(runs: DataFrame) -> T.StructType:
    return T.StructType(
        [
            *[f for f in runs.schema.fields if f.name != "_votes"],
            T.StructField("_body", T.IntegerType()),
            T.StructField("_last", T.IntegerType()),
        ]
    )


def _scan_by_entity(runs: DataFrame, keys: Sequence[str], relations: Relations | SentRules) -> DataFrame:
    keys = list(keys)

    def scan(batches):
        yield from scan_stream(batches, keys, made(relations), changed_only=True)

    placed = runs.repartition(*keys) if keys else runs.coalesce(1)
    return placed.sortWithinPartitions(*keys, *RUN).mapInArrow(scan, _scan_schema(runs))


def _scan_with_own_rules(
    runs: DataFrame, keys: Sequence[str], attribute: str, edges: DataFrame, ranks: DataFrame
) -> DataFrame:
    """Scan entities whose order is given by the rules among their own values.

    Every entity gets a first row that carries the order of its values as pairs of codes, so a
    task compiles the order of one entity at a time. Codes are then small local numbers.
    """
    keys = list(keys)
    edges = edges.filter(F.col("attribute") == attribute)
    codes = ranks.select("attribute", "value", F.col("code").cast("string").alias("text"))
    coded = materialize(
        edges.join(codes.withColumnsRenamed({"value": "src", "text": "s"}), ["attribute", "src"])
        .join(codes.withColumnsRenamed({"value": "dst", "text": "d"}), ["attribute", "dst"])
        .select("attribute", F.col("s").alias("src"), F.col("d").alias("dst"))
    )
    present = runs.filter("_rep > 0").select(
        *keys, F.lit(attribute).alias("attribute"), F.col("_rep").cast("string").alias("value")
    )
    counts = materialize(present.distinct())
    pairs = F.struct(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    own = related_pairs(counts, keys, coded).groupBy(*keys).agg(F.collect_list(pairs).alias("_edges"))
    blank = {f.name: F.lit(None).cast(f.dataType) for f in runs.schema if f.name not in keys}
    blank |= {"_ref": F.lit(-1), "_rep": F.lit(0), "_votes": F.lit(0).cast("long")}
    heads = own.select(*keys, *[c.alias(n) for n, c in blank.items()], "_edges")
    rows = runs.withColumn("_edges", F.lit(None).cast("array<struct<src:int,dst:int>>")).unionByName(heads)
    # entities without an edge among their values cannot change
    schema = _scan_schema(runs)

    def scan(batches):
        for edges, stream in _with_head(batches):
            order = _order_of("", [(str(a["src"]), str(a["dst"])) for a in edges])
            places = [0, *map(int, order.values)]
            for part in scan_stream(_recoded(stream, places), keys, relations_of(order), changed_only=True):
                names = part.schema.names
                restored = part.column(names.index("_code"))
                columns = {n: part.column(k) for k, n in enumerate(names) if n != "_code"}
                columns["_rep"] = restored
                for n in ("_body", "_last"):
                    local = np.asarray(columns[n])
                    # a local 0 is a run that keeps its own value
                    code = np.where(local > 0, np.array(places)[local], np.asarray(restored))
                    columns[n] = pa.array(code, pa.int32())
                yield pa.record_batch([columns[f.name] for f in schema], [f.name for f in schema])

    placed = rows.repartition(*keys) if keys else rows.coalesce(1)
    return placed.sortWithinPartitions(*keys, *RUN).mapInArrow(scan, schema)


def _with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[pa.RecordBatch]]]:
    """(edges, rows) of each entity whose rows begin with a head; the rows of an entity must be read
    before the next one is asked for. Entities without a head follow under the order of another, in
    which their values are unrelated too: values related anywhere are related wherever both are."""
    pending: list = []
    source = iter(batches)

    def pieces():
        for batch in source:
            edges = batch.column(batch.schema.get_field_index("_edges"))
            heads = np.flatnonzero(np.asarray(edges.is_valid()))
            cuts = [0, *heads, batch.num_rows]
            for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                head = edges[int(low)].as_py() if k else None
                low += bool(k)
                yield head, batch.slice(low, high - low).drop_columns(["_edges"])

    stream = pieces()

    def rest():
        for head, rows in stream:
            if head is not None:
                pending.append((head, rows))
                return
            yield rows

    def first(rows):
        yield rows
        yield from rest()

    for _ in rest():  # rows before the first head
        pass
    while pending:
        head, rows = pending.pop()
        here = first(rows)
        yield head, here
        for _ in here:
            pass


def _recoded(batches: Iterator[pa.RecordBatch], places: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Codes as places in ``places`` (0 if not there); the code itself stays in ``_code``."""
    known = np.sort(np.array(places[1:], np.int64))
    local = np.argsort(np.array(places[1:], np.int64), kind="stable") + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        where = batch.schema.get_field_index("_rep")
        codes = np.asarray(batch.column(where)).astype(np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        found = np.where(known[at] == codes, local[at], 0)
        out = batch.set_column(where, "_rep", pa.array(found, pa.int32()))
        yield out.append_column("_code", pa.array(codes, pa.int32()))


ENDS = "slice int, first_key string, last_key string, first_code int"
SUMMARY = "slice int, entry int, blame int, window string, lag boolean, previous int, current int"
#: frequent states tried on every slice, beside those that reach it
COMMON_STATES = 8


def _scan_by_slice(
    runs: DataFrame, keys: Sequence[str], relations: Relations | SentRules, total: int, limit: int
) -> DataFrame:
    """Scan sorted slices in parallel, although a slice depends on the one before.

    For each slice a table is filled that gives its exit state for an entry state. Every
    slice is scanned as if nothing came before it; then with the exit states found, those of
    the slice before and the most frequent of all, until the entry of every slice is in its
    table. States settle after a few values, so few rounds do, whatever the number of slices.
    The driver sees a few summary rows per slice; one more pass makes the result.
    """
    keys = list(keys)
    sliced = slices(runs, keys, [F.col(c) for c in RUN], total, limit)
    ends = {
        row["slice"]: row
        for row in sliced.mapInArrow(_ends(keys), ENDS).collect()
    }
    ids = sorted(ends)
    before = {
        b: a for a, b in zip(ids, ids[1:]) if ends[a]["last_key"] == ends[b]["first_key"]
    }
    coming = {a: ends[b]["first_code"] for b, a in before.items()}
    known: dict[int, dict[State | None, tuple[int, State]]] = {i: {} for i in ids}
    todo: dict[int, list[State | None]] = {i: [None] for i in ids}
    while todo:
        # summaries are small; the states of a round go out with its tasks
        part = sliced if len(todo) == len(ids) else sliced.filter(F.col("_slice").isin(list(todo)))
        for row in part.mapInArrow(_summarizer(keys, relations, todo, coming), SUMMARY).collect():
            exit_ = State(int(row["window"], 16), row["lag"], row["previous"], row["current"])
            known[row["slice"]][todo[row["slice"]][row["entry"]]] = (row["blame"], exit_)
        entries = _entries(ids, before, known)
        todo = {}
        if entries is None:
            often: dict[State, int] = {}
            for table in known.values():
                for _, exit_ in table.values():
                    often[exit_] = often.get(exit_, 0) + 1
            common = sorted(often, key=lambda x: (-often[x], x))[:COMMON_STATES]
            for here, previous in before.items():
                states = dict.fromkeys([*(e for _, e in known[previous].values()), *common])
                new = [x for x in states if x not in known[here]]
                if new:
                    todo[here] = new

    tail = {a: known[b][entries[b]][0] for b, a in before.items()}

    def scan(batches):
        for first, rest in _one_slice(batches):
            yield from scan_stream(
                (b.drop_columns(["_slice"]) for b in rest),
                keys,
                made(relations),
                entries.get(first),
                coming.get(first, NONE),
                tail.get(first, NONE),
                changed_only=True,
            )

    return sliced.mapInArrow(scan, _scan_schema(runs))


def _entries(ids: list[int], before: dict[int, int], known: dict) -> dict[int, State | None] | None:
    """The entry state of each slice, or None while one is not in a table."""
    entries: dict[int, State | None] = {}
    for i in ids:
        entry = known[before[i]][entries[before[i]]][1] if i in before else None
        if entry not in known[i]:
            return None
        entries[i] = entry
    return entries


def _ends(keys):
    def ends(batches):
        for number, rest in _one_slice(batches):
            first = last = None
            for batch in rest:
                if batch.num_rows:
                    edge = batch.select([*keys, "_rep"])
                    first = first or edge.slice(0, 1).to_pylist()[0]
                    last = edge.slice(batch.num_rows - 1).to_pylist()[0]
            row = {
                "slice": number,
                "first_key": repr([first[k] for k in keys]),
                "last_key": repr([last[k] for k in keys]),
                "first_code": first["_rep"],
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ENDS_ARROW)

    return ends


def _summarizer(keys, relations, todo, coming):
    def summarize(batches):
        for number, rest in _one_slice(batches):
            rows = slice_summaries(rest, keys, made(relations), todo[number], coming.get(number, NONE))
            out = [{"slice": number, "entry": k, **row} for k, row in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(out, schema=_SUMMARY_ARROW)

    return summarize


_ENDS_ARROW = pa.schema(
    [("slice", pa.int32()), ("first_key", pa.string()), ("last_key", pa.string()), ("first_code", pa.int32())]
)
_SUMMARY_ARROW = pa.schema(
    [
        ("slice", pa.int32()),
        ("entry", pa.int32()),
        ("blame", pa.int32()),
        ("window", pa.string()),
        ("lag", pa.bool_()),
        ("previous", pa.int32()),
        ("current", pa.int32()),
    ]
)


def _one_slice(batches):
    """The slice number of a task's rows together with all of them.

    Slices are partitions, so a task reads exactly one slice.
    """
    for batch in batches:
        if batch.num_rows:
            def again(first=batch):
                yield first
                yield from batches

            yield batch.column(batch.schema.get_field_index("_slice"))[0].as_py(), again()
            return


def repaired_cells(
    df: DataFrame,
    keys: Sequence[str],
    vid: str,
    reference: str,
    repair_column: str,
    rules: RuleBook | DataFrame,
    compress_runs: bool = False,
) -> DataFrame:
    """Only ``keys, vid`` and the repaired column, for :func:`join_back`."""
    narrow = df.select(*dict.fromkeys([*keys, vid, reference, repair_column]))
    fixed = repair(narrow, keys, vid, reference, repair_column, rules, compress_runs)
    return fixed.select(*keys, vid, repair_column)


def join_back(
    base: DataFrame,
    cells: DataFrame,
    keys: Sequence[str],
    vid: str,
    column: str,
    check: bool = True,
) -> DataFrame:
    """Replace ``column`` of ``base`` by the repaired cells; inner join on (keys, vid).

    With ``check`` a repeated (keys, vid) among the cells, which would multiply
    rows, makes the query fail. The check rides on the exchange of the join.
    """
    on = [*keys, vid]
    cells = cells.select(*on, column)
    if check:
        message = f"({', '.join(on)}) is not unique"
        once = F.when(F.count("*") > 1, F.raise_error(F.lit(message))).otherwise(F.first(column))
        # exchange first: (keys, vid) has nothing to combine map-side
        cells = cells.repartition(*on).groupBy(*on).agg(once.cast(cells.schema[column].dataType).alias(column))
    return base.drop(column).join(cells, on, "inner").select(*base.columns)
