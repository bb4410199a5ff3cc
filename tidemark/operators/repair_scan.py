"""The sliding-window repair of one entity, over runs instead of rows.

Input is the entity's runs in repair order, each with the code of its repair
value (1-based rank, 0 if outside the rules) and its number of votes (rows).
Per run the scan yields two codes: ``body`` for its rows and ``last`` for its
final row, the only one a later run can still change.

Why runs are enough. Stepping inside a run compares equal values, which only
lengthens the window. Stepping into a run either leaves it alone, changes the
last row of the run before, or out-votes its first row; in that case the window
keeps the value that out-voted it, so every row of the run is out-voted alike.
All window tests ask whether *some* row has a property, so the window is held as
the set of its values, and more than three votes make no further difference.

The state between runs is ``(window, lag, previous, current)``: the value set,
whether the window ends one row behind, the value of that row, and the value at
the current row. It has a fixed size however long the entity is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc

from tidemark.operators.rule_graph import AttributeOrder, _bits

NONE = -1  # no code


class State(NamedTuple):
    window: int
    lag: bool
    previous: int
    current: int


class Relations(NamedTuple):
    """Bit sets over codes: bit 0 is any value outside the rules."""

    older: tuple[int, ...]
    newer: tuple[int, ...]
    apart: tuple[int, ...]  # incomparable, including the value itself


def relations_of(order: AttributeOrder) -> Relations:
    older = (0, *[m << 1 for m in order.older])
    newer = (0, *[m << 1 for m in order.newer])
    everything = (1 << len(older)) - 1
    return Relations(older, newer, tuple(everything & ~(o | n) for o, n in zip(older, newer)))


def walk(
    codes: Sequence[int],
    votes: Sequence[int],
    starts: Sequence[bool],
    following: Sequence[int],
    relations: Relations,
    state: State,
) -> tuple[list[int], list[int], State]:
    """Scan runs; ``following`` is the next run's code in the same entity, or NONE.

    Returns per run its body code and the code forced on the last row of the run
    before it (or NONE), and the state after the final run.
    """
    older, newer, apart = relations
    window, lag, previous, current = state
    bodies: list[int] = []
    blames: list[int] = []
    for code, vote, start, coming in zip(codes, votes, starts, following):
        body, blame = code, NONE
        if start:
            window, lag, previous, current = 0, False, code, code
        elif newer[code] >> current & 1:  # values run backwards
            if window & newer[code]:
                body = code = current  # the run is out-voted
                window |= 1 << (previous if lag else current)
                previous = current
            else:
                blame = code
                if window & apart[current]:
                    window |= 1 << (previous if lag else code)
                else:
                    window, lag = 0, True
                previous = current = code
        elif older[code] >> current & 1 and not (
            window & apart[code] or (vote == 1 and coming != NONE and older[code] >> coming & 1)
        ):
            window, lag, previous, current = 0, False, code, code
        else:
            window |= 1 << (previous if lag else current)
            previous, current = current, code
        if vote > 1:
            window |= 1 << (previous if lag else code)
            previous = code
            if vote > 2:
                window |= 1 << code
        bodies.append(body)
        blames.append(blame)
    return bodies, blames, State(window, lag, previous, current)


def canonical(state: State, relations: Relations) -> State:
    """The simplest state that behaves the same from here on."""
    window = state.window
    if window & 1:
        # Every value is incomparable to one outside the rules, so only "is some
        # value newer" still depends on the rest: maximal values decide it.
        for code in _bits(window & ~1):
            if window & relations.newer[code]:
                window &= ~(1 << code)
    return State(window, state.lag, state.previous if state.lag else 0, state.current)


def entity_starts(table: pa.Table, keys: Sequence[str]) -> list[bool]:
    """Whether each row but the first begins another entity than the row above."""
    n = table.num_rows
    if not keys or n < 2:
        return [False] * max(0, n - 1)
    changed = None
    for k in keys:
        column = table.column(k).combine_chunks()
        above, below = column.slice(0, n - 1), column.slice(1)
        differs = pc.or_(
            pc.fill_null(pc.not_equal(above, below), False),
            pc.xor(pc.is_null(above), pc.is_null(below)),
        )
        changed = differs if changed is None else pc.or_(changed, differs)
    return changed.to_pylist()


def scan_stream(
    batches: Iterator[pa.RecordBatch],
    keys: Sequence[str],
    relations: Relations,
    entry: State | None = None,
    coming: int = NONE,
    tail_blame: int = NONE,
    changed_only: bool = False,
) -> Iterator[pa.RecordBatch]:
    """Append ``_body`` and ``_last`` to sorted runs, holding two rows at a time.

    With ``changed_only`` runs that keep their value are left out, and so are votes.

    ``entry``, ``coming`` and ``tail_blame`` connect a slice to its neighbours
    when an entity is cut: the state it starts from, the code that follows it and
    what the next slice decides about its last row.
    """
    state = entry or State(0, False, 0, 0)
    held: pa.Table | None = None  # last scanned run (if any) and the next, unscanned one
    held_bodies: list[int] = []
    held_start = [entry is None]

    def emit(table: pa.Table, bodies: list[int], blames: list[int]) -> Iterator[pa.RecordBatch]:
        lasts = [b if x == NONE else x for b, x in zip(bodies, blames)]
        out = table.append_column("_body", pa.array(bodies, pa.int32()))
        out = out.append_column("_last", pa.array(lasts, pa.int32()))
        if changed_only:
            kept = out.column("_rep")
            moved = pc.or_(pc.not_equal(out.column("_body"), kept), pc.not_equal(out.column("_last"), kept))
            out = out.filter(moved).drop_columns(["_votes"])
        yield from out.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        inner = entity_starts(table, keys)
        done = len(held_bodies)
        starts = (held_start if not done else [False]) + inner
        codes = table.column("_rep").to_pylist()
        votes = table.column("_votes").to_pylist()
        following = [NONE if s else c for c, s in zip(codes[1:], starts[1:])]
        end = table.num_rows - 1
        bodies, blames, state = walk(
            codes[done:end], votes[done:end], starts[done:end], following[done:end], relations, state
        )
        bodies = held_bodies + bodies
        blames = [NONE] * done + blames
        # Runs before the last scanned one are final: their successor was scanned.
        final = max(0, len(bodies) - 1)
        if final:
            yield from emit(table.slice(0, final), bodies[:final], blames[1 : final + 1])
        held = table.slice(final)
        held_bodies = bodies[final:]
        held_start = starts[:1] if not bodies else [False]

    if held is not None:
        n = held.num_rows
        inner = entity_starts(held, keys)
        done = len(held_bodies)
        starts = (held_start if not done else [False]) + inner
        codes = held.column("_rep").to_pylist()
        votes = held.column("_votes").to_pylist()
        bodies, blames, state = walk(
            codes[done:], votes[done:], starts[done:], [coming], relations, state
        )
        bodies = held_bodies + bodies
        yield from emit(held, bodies, ([NONE] * done + blames)[1:n] + [tail_blame])


def slice_summaries(
    batches: Iterator[pa.RecordBatch],
    keys: Sequence[str],
    relations: Relations,
    entries: Sequence[State | None],
    coming: int,
) -> list[dict]:
    """Per entry state what neighbours need to know about a slice: its exit and its first blame.

    The slice is read once; entries that have come to the same state go on as one.
    """
    states = [entry or State(0, False, 0, 0) for entry in entries]
    fresh = [entry is None for entry in entries]
    blames = [NONE] * len(entries)
    first = True
    held: tuple[int, int] | None = None  # code and votes of the last row read
    start = False
    last: pa.Table | None = None

    def scan(codes, votes, starts, following):
        nonlocal first
        done: dict[tuple[State, bool], tuple[int, State]] = {}
        for k, state in enumerate(states):
            begin = first and fresh[k]
            same = (canonical(state, relations), begin)
            if same not in done:
                _, found, after = walk(codes, votes, [begin or starts[0], *starts[1:]], following, relations, state)
                done[same] = (found[0], canonical(after, relations))
            blame, states[k] = done[same]
            if first:
                blames[k] = blame
        first = False

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        joined = table if last is None else pa.concat_tables([last, table])
        inner = entity_starts(joined, keys)
        codes, votes = table.column("_rep").to_pylist(), table.column("_votes").to_pylist()
        if held is None:
            starts = [False, *inner]
        else:
            codes, votes, starts = [held[0], *codes], [held[1], *votes], [start, *inner]
        following = [NONE if s else c for c, s in zip(codes[1:], starts[1:])]
        if len(codes) > 1:
            scan(codes[:-1], votes[:-1], starts[:-1], following)
        held, start, last = (codes[-1], votes[-1]), starts[-1], table.slice(table.num_rows - 1)
    if held is None:
        return []
    scan([held[0]], [held[1]], [start], [coming])
    return [
        {"blame": b, "window": f"{s.window:x}", "lag": s.lag, "previous": s.previous, "current": s.current}
        for b, s in zip(blames, states)
    ]
