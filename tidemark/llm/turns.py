"""Cheapest repair of conversations whose turns are lost, empty, repeated, cut off or out of role.

A repaired conversation has the role initials ``(s?(ua)+)?``. Repair is a weighted deduction: the
item (i, state) says that the first i rows are dealt with and the roles so far end in that state; the
edits Keep, Rerole, Delete and Insert lead from item to item. An item's weight is (cost, initials of
the edits). Both only grow along a deduction, and of two weights of one item the smaller stays the
smaller whatever follows: edits of the same rows at equal cost are never the beginning of one
another, since the longer ones would have paid for insertions. So the functions are superior, and
Knuth's agenda may finalise items in the order of their weights until the goal is popped.

Rows longer than a segment are dealt with segment by segment, from every state to every state; two
adjacent tables make one by a deduction with two antecedents. In this way a conversation too large for a task
is repaired slice by slice: only its tables meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import saved
from tidemark.operators.skew import same_keys, slices

# White space, ends of sentences, costs of the edits
WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5

#: a conversation with more rows or bytes than these is cut into slices of about so many rows
LARGE_ROWS, LARGE_BYTES, SLICE_ROWS = 20_000, 64 << 20, 10_000
#: rows that one agenda deals with
SEGMENT = 48

# states: nothing yet, after system, after user, after a pair
START, SYSTEM, USER, PAIR = range(4)
# roles by their initial, and faults; a row's code is 4 * role + fault
OTHER, S, U, A = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_AFTER = {(START, S): SYSTEM, (START, U): USER, (SYSTEM, U): USER, (USER, A): PAIR, (PAIR, U): USER}
_NEEDED = {START: U, SYSTEM: U, USER: A, PAIR: U}
_NAMES = {U: "user", A: "assistant"}
_LEGAL = {(S, U), (U, A), (A, U)}


def _agenda(codes: bytes, entry: int) -> Iterator[tuple[int, str, int, int]]:
    """Items (cost, audit, i, state) in the order in which they finalise."""
    agenda, final = [(0, "", 0, entry)], set()
    while agenda:
        item = cost, audit, i, state = heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        yield item
        needed = _NEEDED[state]
        heappush(agenda, (cost + INSERT, audit + "I", i, _AFTER[state, needed]))
        if i == len(codes):
            continue
        role, fault = divmod(codes[i], 4)
        heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        if fault == TRUNCATED:
            cost += CUT_OFF
        heappush(agenda, (cost + REROLE, audit + "R", i + 1, _AFTER[state, needed]))
        if (state, role) in _AFTER:
            heappush(agenda, (cost, audit + "K", i + 1, _AFTER[state, role]))


@lru_cache(maxsize=50_000)
def _goal(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of one segment."""
    return next((c, audit) for c, audit, i, state in _agenda(codes, START) if i == len(codes) and state in (START, PAIR))


@lru_cache(maxsize=20_000)
def _segment(codes: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    """Weight of the cheapest edits of the rows, by (state before, state after)."""
    return {
        (entry, state): (cost, audit)
        for entry in range(4)
        for cost, audit, i, state in _agenda(codes, entry)
        if i == len(codes)
    }


def _joined(left: dict, right: dict) -> dict:
    """The table of two adjacent stretches: (q, r) and (r, p) deduce (q, p)."""
    out: dict = {}
    for (q, r), (cost, audit) in left.items():
        for p in range(4):
            if (r, p) in right:
                weight = cost + right[r, p][0], audit + right[r, p][1]
                if (q, p) not in out or weight < out[q, p]:
                    out[q, p] = weight
    return out


def _table(tables: list[dict]) -> dict:
    """One table of adjacent ones, joined in pairs so that an audit is copied few times."""
    while len(tables) > 1:
        pairs = [_joined(a, b) for a, b in zip(tables[::2], tables[1::2])]
        tables = pairs + tables[len(pairs) * 2 :]
    return tables[0]


def transfers(codes: bytes) -> dict[tuple[int, int], tuple[int, str]]:
    return _table([_segment(codes[k : k + SEGMENT]) for k in range(0, len(codes), SEGMENT)] or [_segment(b"")])


def cheapest(table: dict) -> tuple[int, str]:
    return min(table[START, end] for end in (START, PAIR) if (START, end) in table)


def edits(codes: bytes, audit: str, state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(inserted before, edit, inserted after) for each row, and the state at the end. Inserted roles
    are initials; an edit is K, D, or the initial of the new role. Only the last row has roles after."""
    out, before = [], ""
    for letter in audit:
        if letter == "D":
            out.append([before, "D", ""])
            before = ""
            continue
        role = codes[len(out)] // 4 if letter == "K" else _NEEDED[state]
        state = _AFTER[state, role]
        if letter == "I":
            before += "ua"[role == A]
        else:
            out.append([before, "K" if letter == "K" else "ua"[role == A], ""])
            before = ""
    if out:
        out[-1][2] = before
    return [tuple(x) for x in out], state


def illegal_pairs(codes: bytes) -> int:
    return sum((a // 4, b // 4) not in _LEGAL for a, b in zip(codes, codes[1:]))


def repaired(rows: list[tuple], changes: list[tuple[str, str, str]]) -> Iterator[tuple]:
    """(edit, turn, role, text) of the repaired rows; ``rows`` are (turn, role, text)."""
    full = {"u": "user", "a": "assistant"}
    for (turn, role, text), (before, edit, after) in zip(rows, changes):
        yield from (("I", None, full[x], "") for x in before)
        if edit != "D":
            yield ("K" if edit == "K" else "R", turn, role if edit == "K" else full[edit], text)
        yield from (("I", None, full[x], "") for x in after)


def _conversations(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(conversation, rows) of batches sorted by ``_conv``."""
    at, held, some = None, [], False
    for batch in batches:
        names = batch.schema.names
        lists = [batch.column(names.index(c)).to_pylist() for c in ("_conv", *columns)]
        for conv, *row in zip(*lists):
            if some and conv != at:
                yield at, held
                held = []
            at, some = conv, True
            held.append(row)
    if some:
        yield at, held


def _whole(emit: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, held in _conversations(batches, ("_turn", "_role", "_text", "_code")):
            seen, codes = set(), bytearray()
            for turn, role, text, code in held:
                if code % 4 != BLANK:
                    if (role, text) in seen:
                        code += DUPLICATE - code % 4
                    seen.add((role, text))
                codes.append(code)
            codes = bytes(codes)
            cost, audit = _goal(codes) if len(codes) <= SEGMENT else cheapest(transfers(codes))
            rows = [row[:3] for row in held]
            out += emit(conv, rows, codes, cost, audit, repaired(rows, edits(codes, audit)[0]))
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _as_report(conv, rows, codes, cost, audit, fixed):
    turns = {r[0] for r in rows} - {None}
    faults = [c % 4 for c in codes]
    yield {
        "_conv": conv,
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": illegal_pairs(codes), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in fixed).encode()).hexdigest(),
    }


def _as_rows(conv, rows, codes, cost, audit, fixed):
    for k, (edit, turn, role, text) in enumerate(fixed):
        yield {"_conv": conv, "position": [k], "edit": edit, "turn": turn, "role": role, "text": text}


_REPORT = [
    *((c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", "string"), ("repaired_sha256", "string"),
]
_ROWS = [("position", "array<int>"), ("edit", "string"), ("turn", "bigint"), ("role", "string"), ("text", "string")]


def _typed(conv: T.DataType, fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField("_conv", conv), *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))])


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role = F.coalesce(turns[role_col].cast("string"), F.lit(" "))
    text = F.coalesce(turns[text_col].cast("string"), F.lit(" "))
    core = F.btrim(text, F.lit(WHITE))
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    fault = F.when(core == "", BLANK).when(~F.substring(core, -1, 1).isin(*ENDS), TRUNCATED).otherwise(SOUND)
    return turns.select(
        turns[conv_col].alias("_conv"), turns[turn_col].cast("long").alias("_turn"), role.alias("_role"),
        text.alias("_text"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("second"), text).alias("_h2"),
        (4 * kind + fault).alias("_code"),
    )


def _order() -> list[Column]:
    return [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_h1"), F.col("_h2"), F.col("_row")]


def _split(rows: DataFrame, large_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of conversations for one task, rows of the others or None, number of the latter)."""
    sizes = rows.groupBy("_conv").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_text")).alias("_bytes"))
    large = sizes.filter((F.col("_n") > large_rows) | (F.col("_bytes") > LARGE_BYTES))
    large = saved(large.select(F.col("_conv").alias("_l_conv"), "_n"))
    total = large.agg(F.sum("_n")).first()[0]
    if not total:
        return rows, None, 0
    large = large.drop("_n")
    same = same_keys(["_conv"], "_l")
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi"), total


def _repair(turns: DataFrame, columns: tuple[str, ...], as_rows: bool, large_rows: int, slice_rows: int) -> DataFrame:
    rows = _rows(turns, *columns).withColumn("_row", F.monotonically_increasing_id())
    kind = rows.schema["_conv"].dataType
    schema = _typed(kind, _ROWS if as_rows else _REPORT)
    from pyspark.sql.pandas.types import to_arrow_schema

    ordinary, large, total = _split(rows, large_rows)
    out = (
        ordinary.repartition("_conv")
        .sortWithinPartitions("_conv", *_order())
        .select("_conv", "_turn", "_role", "_text", "_code")
        .mapInArrow(_whole(_as_rows if as_rows else _as_report, to_arrow_schema(schema)), schema)
    )
    if large is not None:
        out = out.unionByName(_repair_large(large, kind, as_rows, total, slice_rows).select(*out.columns))
    return out


# --- conversations of many slices ---------------------------------------------------------


def _chain(kind: T.DataType):
    """Per conversation: its slices' codes to the edits of each slice; every slice also carries the report."""
    fields = [f for f in _REPORT if f[0] not in ("gaps", "repaired_sha256")]
    schema = _typed(kind, [("_slice", "int"), ("_edits", "array<struct<_before:string,_edit:string,_after:string>>"), *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, parts in _conversations(batches, ("_slice", "_codes", "_tables")):
            parts = [(number, bytes(codes), _unpacked(table)) for number, codes, table in parts]
            cost, audit = cheapest(_table([table for *_, table in parts]))
            faults = [sum(codes.count(4 * r + f) for _, codes, _ in parts for r in range(4)) for f in range(4)]
            ends = bytes(x for _, codes, _ in parts for x in (codes[0], codes[-1]))
            illegal = sum(illegal_pairs(codes) for _, codes, _ in parts) + sum(
                illegal_pairs(ends[k : k + 2]) for k in range(1, len(ends) - 1, 2)
            )
            report = [faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost]
            at, state = 0, START
            for k, (number, codes, _) in enumerate(parts):
                end, left = at, len(codes)
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if k == len(parts) - 1:
                    end = len(audit)
                changes, state = edits(codes, audit[at:end], state)
                at = end
                named = [{"_before": b, "_edit": e, "_after": a} for b, e, a in changes]
                row = [conv, number, named, *report, audit if k == 0 else None]
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row))], arrow)

    return run, schema


def _packed(table: dict) -> list[dict]:
    return [{"q": q, "p": p, "cost": cost, "audit": audit} for (q, p), (cost, audit) in table.items()]


def _unpacked(table: list[dict]) -> dict:
    return {(x["q"], x["p"]): (x["cost"], x["audit"]) for x in table}


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [bytes(x["_code"] for x in row) for row in batch.column(batch.schema.names.index("_ordered")).to_pylist()]
        entry = pa.struct([("q", pa.int32()), ("p", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        yield pa.record_batch(
            [
                batch.column(batch.schema.names.index("_conv")), batch.column(batch.schema.names.index("_slice")),
                pa.array(codes, pa.binary()), pa.array([_packed(transfers(c)) for c in codes], pa.list_(entry)),
            ],
            ["_conv", "_slice", "_codes", "_tables"],
        )


def _digests(conv_type: pa.DataType):
    """SHA-256 of each conversation's repaired rows, which come sorted and are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, digest):
            return pa.record_batch([pa.array([conv], conv_type), pa.array([digest.hexdigest()])], ["_conv", "repaired_sha256"])

        at, digest = None, None
        for batch in batches:
            convs, roles, texts = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_conv", "role", "text"))
            for conv, role, text in zip(convs, roles, texts):
                if digest is None or conv != at:
                    if digest is not None:
                        yield row(at, digest)
                    at, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield row(at, digest)

    return run


def _repair_large(large: DataFrame, kind: T.DataType, as_rows: bool, total: int, slice_rows: int) -> DataFrame:
    from pyspark.sql import Window
    from pyspark.sql.pandas.types import to_arrow_type

    sliced = slices(large, ["_conv"], _order(), total, slice_rows)
    numbered = sliced.withColumn("_at", F.row_number().over(Window.partitionBy("_conv", "_slice").orderBy(*_order())))
    # seen earlier: in the slice, by a window; in an earlier slice, by the first slice of each text
    text = ["_conv", "_role", "_h1", "_h2"]
    numbered = numbered.withColumn("_again", F.row_number().over(Window.partitionBy("_slice", *text).orderBy("_at")) > 1)
    numbered = saved(numbered.withColumn("_blank", F.col("_code") % 4 == BLANK))
    narrow = numbered.select(*text, "_slice", "_at", "_code", "_again", "_blank")
    firsts = narrow.filter("not _again").groupBy(*text).agg(F.min("_slice").alias("_first"))
    firsts = firsts.select(*[F.col(c).alias(f"_f{c}") for c in text], "_first")
    local = narrow.filter("not _again").join(firsts, same_keys(text, "_f"), "inner")
    marked = local.select("_conv", "_slice", "_at", "_code", "_blank", (F.col("_first") < F.col("_slice")).alias("_seen"))
    marked = marked.unionByName(narrow.filter("_again").select("_conv", "_slice", "_at", "_code", "_blank", F.lit(True).alias("_seen")))
    role = (F.col("_code") / 4).cast("int") * 4
    marked = marked.withColumn("_code", F.when(F.col("_seen") & ~F.col("_blank"), role + DUPLICATE).otherwise(F.col("_code")))
    packed = marked.groupBy("_conv", "_slice").agg(F.sort_array(F.collect_list(F.struct("_at", "_code"))).alias("_ordered"))
    tables = packed.mapInArrow(
        _tables,
        _typed(kind, [("_slice", "int"), ("_codes", "binary"), ("_tables", "array<struct<q:int,p:int,cost:bigint,audit:string>>")]),
    )
    run, schema = _chain(kind)
    chained = saved(tables.repartition("_conv").sortWithinPartitions("_conv", "_slice").mapInArrow(run, schema))

    one = chained.select("_conv", "_slice", F.posexplode("_edits").alias("_k", "_change"))
    one = one.select(F.col("_conv").alias("_e_conv"), F.col("_slice").alias("_e_slice"), (F.col("_k") + 1).alias("_e_at"), "_change.*")
    joined = numbered.join(one, same_keys(["_conv", "_slice", "_at"], "_e"))
    full = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))

    def inserted(letters: str) -> Column:
        return F.transform(
            F.filter(F.split(F.col(letters), ""), lambda x: x != ""),
            lambda x: F.struct(F.lit("I").alias("edit"), F.lit(None).cast("long").alias("turn"), full[x].alias("role"), F.lit("").alias("text")),
        )

    kept = F.col("_edit") == "K"
    own = F.struct(
        F.when(kept, "K").otherwise("R").alias("edit"), F.col("_turn").alias("turn"),
        F.when(kept, F.col("_role")).otherwise(full[F.col("_edit")]).alias("role"), F.col("_text").alias("text"),
    )
    nothing = F.filter(F.array(own), lambda x: F.lit(False))
    lines = F.concat(inserted("_before"), F.when(F.col("_edit") == "D", nothing).otherwise(F.array(own)), inserted("_after"))
    fixed = joined.select("_conv", "_slice", "_at", F.posexplode(lines).alias("_k", "_line")).select(
        "_conv", F.array("_slice", "_at", "_k").alias("position"), "_line.*"
    )
    if as_rows:
        return fixed
    digests = (
        fixed.repartition("_conv").sortWithinPartitions("_conv", "position").select("_conv", "role", "text")
        .mapInArrow(_digests(to_arrow_type(kind)), _typed(kind, [("repaired_sha256", "string")]))
    )
    span = F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")
    gaps = numbered.groupBy(F.col("_conv").alias("_g_conv")).agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    report = chained.filter("audit is not null").drop("_slice", "_edits")
    digests = digests.select(F.col("_conv").alias("_d_conv"), "repaired_sha256")
    empty = hashlib.sha256().hexdigest()
    return (
        report.join(gaps, same_keys(["_conv"], "_g"))
        .join(digests, same_keys(["_conv"], "_d"), "left")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
    )


# --- the operator -------------------------------------------------------------------------


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    large_rows: int = LARGE_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The repaired rows: conv_id, position (orders them), edit (K, R or I), turn (null: inserted), role, text.

    A conversation's rows are taken by turn, nulls first, ties by role and a hash of the text. A row
    without a character other than white space is blank, one with role and text of an
    earlier row a duplicate; both go. One whose last character ends no sentence is
    truncated. Edits: keep 0, rerole to user or assistant 1, delete 2, insert an empty user or
    assistant 5; a truncated row that stays adds 5. Of the cheapest edits those with the
    ASCII-least initials are taken. A null role or text is one space; null conversation ids are one
    conversation. Extra columns are left out; an empty table gives an empty result.
    """
    out = _repair(turns, (conv_col, turn_col, role_col, text_col), True, large_rows, slice_rows)
    return out.withColumnRenamed("_conv", "conv_id")


def repair_report(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    large_rows: int = LARGE_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per conversation of :func:`repair_conversations`: conv_id, gaps (turns missing between the first and
    the last), blank, duplicate, truncated (rows by their first fault), illegal (adjacent initials other than
    su, ua, au), cost, audit (initials of the edits) and repaired_sha256 (``role:text`` lines).

    The digest of a conversation of many slices is computed in one pass of one task over its sorted
    rows: SHA-256 can't be split. Nothing of them is held.
    """
    out = _repair(turns, (conv_col, turn_col, role_col, text_col), False, large_rows, slice_rows)
    return out.withColumnRenamed("_conv", "conv_id")


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a fifth of the rows damaged, by crc32 of ``conv_id:turn`` (nulls: a space) modulo 20: 0
    drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's."""
    one = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat(one["conv_id"], F.lit(":"), one["turn"]).cast("binary")) % 20
    rows = turns.select(
        "conv_id", "turn", draw.alias("_draw"),
        F.when(draw == 4, "user").otherwise(one["role"]).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(one["text"], ENDS, "")).otherwise(one["text"]).alias("text"),
    ).filter("_draw <> 0")
    times = F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("_time")).drop("_time")


def damage_report(turns: DataFrame, large_rows: int = LARGE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """:func:`repair_report` of the :func:`damaged` rows, with every conversation that had rows before."""
    report = repair_report(damaged(turns), large_rows=large_rows, slice_rows=slice_rows)
    known = turns.select(F.col("conv_id").alias("_k_conv_id")).distinct()
    joined = known.join(report, same_keys(["conv_id"], "_k_"), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select(
        F.col("_k_conv_id").alias("conv_id"),
        *[F.coalesce(F.col(c), F.lit(empty.get(c, 0))).alias(c) for c, _ in _REPORT],
    )
