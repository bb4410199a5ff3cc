"""The run scan against the row-by-row window, without Spark."""

import random
from itertools import groupby

import model
import pyarrow as pa
import pytest

from tidemark.operators.repair_scan import (
    NONE,
    State,
    canonical,
    relations_of,
    scan_stream,
    slice_summaries,
    walk,
)
from tidemark.operators.rule_graph import _order_of


def random_runs(rnd, size, groups=5, length=30):
    order = _order_of("x", model.random_pairs(rnd, size))
    values = [*order.values, "?"]
    code = {v: i + 1 for i, v in enumerate(order.values)}
    rows = [(rnd.randrange(groups), rnd.choice(values)) for _ in range(rnd.randint(1, length))]
    rows.sort(key=lambda r: (r[0], code.get(r[1], 0)))
    runs = [(c, len(list(g))) for (_, c), g in groupby(rows, key=lambda r: (r[0], code.get(r[1], 0)))]
    return order, [v for _, v in rows], runs


def expand(order, values, runs, bodies, lasts):
    out, at = [], 0
    for (code, votes), body, last in zip(runs, bodies, lasts):
        for k in range(votes):
            new = last if k == votes - 1 else body
            out.append(values[at] if new == code else order.values[new - 1])
            at += 1
    return out


def pairs_of(order):
    return {
        (order.values[o], order.values[i])
        for i, mask in enumerate(order.older)
        for o in range(len(order))
        if mask >> o & 1
    }


def test_walk_matches_the_row_window():
    rnd = random.Random(11)
    for _ in range(3000):
        order, values, runs = random_runs(rnd, rnd.randint(2, 7))
        codes, votes = zip(*runs)
        starts = [True] + [False] * (len(runs) - 1)
        bodies, blames, _ = walk(
            codes, votes, starts, [*codes[1:], NONE], relations_of(order), State(0, False, 0, 0)
        )
        lasts = [b if x == NONE else x for b, x in zip(bodies, [*blames[1:], NONE])]
        assert expand(order, values, runs, bodies, lasts) == model.slide(values, pairs_of(order))


@pytest.mark.parametrize("values, repaired", [(["b", "b", "a"], ["b", "b", "b"]), (["b", "a"], ["a", "a"])])
def test_votes_decide(values, repaired):
    assert model.slide(values, {("a", "b")}) == repaired
    order = _order_of("x", [("a", "b")])
    runs = [(order.values.index(v) + 1, len(list(g))) for v, g in groupby(values)]
    codes, votes = zip(*runs)
    bodies, blames, _ = walk(codes, votes, [True, False], [codes[1], NONE], relations_of(order), State(0, False, 0, 0))
    lasts = [b if x == NONE else x for b, x in zip(bodies, [*blames[1:], NONE])]
    assert expand(order, values, runs, bodies, lasts) == repaired


def batches_of(entities, sizes):
    rows = [(e, c, v, i) for e, runs in entities for i, (c, v) in enumerate(runs)]
    schema = pa.schema([("eid", pa.string()), ("_rep", pa.int32()), ("_votes", pa.int64()), ("n", pa.int32())])
    at = 0
    while at < len(rows):
        size = next(sizes)
        part = rows[at : at + size]
        at += size
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def test_stream_of_entities_in_small_batches():
    rnd = random.Random(5)
    order = _order_of("x", model.random_pairs(rnd, 6))
    relations = relations_of(order)
    for _ in range(100):
        entities = []
        for e in [None, "a", "b", "c", "d"]:
            runs = [(rnd.randint(0, len(order)), rnd.randint(1, 4)) for _ in range(rnd.randint(1, 9))]
            entities.append((e, runs))
        sizes = iter(lambda: rnd.randint(1, 5), 0)
        got = [r for b in scan_stream(batches_of(entities, sizes), ["eid"], relations) for r in b.to_pylist()]
        want = []
        for e, runs in entities:
            codes, votes = zip(*runs)
            starts = [True] + [False] * (len(runs) - 1)
            bodies, blames, _ = walk(codes, votes, starts, [*codes[1:], NONE], relations, State(0, False, 0, 0))
            lasts = [b if x == NONE else x for b, x in zip(bodies, [*blames[1:], NONE])]
            want += [(e, i, b, x) for i, (b, x) in enumerate(zip(bodies, lasts))]
        assert [(r["eid"], r["n"], r["_body"], r["_last"]) for r in got] == want


def test_canonical_states_behave_alike():
    rnd = random.Random(8)
    for _ in range(500):
        order = _order_of("x", model.random_pairs(rnd, rnd.randint(2, 6)))
        relations = relations_of(order)
        n = len(order)
        state = State(rnd.getrandbits(n + 1), rnd.random() < 0.5, rnd.randint(0, n), rnd.randint(0, n))
        codes = [rnd.randint(0, n) for _ in range(12)]
        votes = [rnd.randint(1, 3) for _ in range(12)]
        rest = (codes, votes, [False] * 12, [*codes[1:], NONE], relations)
        full, short = walk(*rest, state), walk(*rest, canonical(state, relations))
        assert full[:2] == short[:2]


def test_slices_chain_to_the_whole():
    rnd = random.Random(2)
    order = _order_of("x", model.random_pairs(rnd, 6))
    relations = relations_of(order)
    for _ in range(100):
        runs = [(rnd.randint(0, len(order)), rnd.randint(1, 3)) for _ in range(20)]
        whole = [(r["_body"], r["_last"]) for b in scan_stream(batches_of([("e", runs)], iter([20])), ["eid"], relations) for r in b.to_pylist()]
        cuts = [runs[:6], runs[6:7], runs[7:15], runs[15:]]
        state, got, blames, entries = None, [], [], []
        for k, part in enumerate(cuts):
            coming = cuts[k + 1][0][0] if k + 1 < len(cuts) else NONE
            entries.append((state, coming))
            tagged = (b.append_column("_slice", pa.array([k] * b.num_rows, pa.int32())) for b in batches_of([("e", part)], iter([3, 3, 3, 3])))
            summary = slice_summaries(tagged, ["eid"], relations, [State(0, True, 0, 0), state], coming)[1]
            blames.append(summary["blame"])
            state = State(int(summary["window"], 16), summary["lag"], summary["previous"], summary["current"])
        for k, part in enumerate(cuts):
            tail = blames[k + 1] if k + 1 < len(cuts) else NONE
            for b in scan_stream(batches_of([("e", part)], iter([2] * 9)), ["eid"], relations, *entries[k], tail):
                got += [(r["_body"], r["_last"]) for r in b.to_pylist()]
        assert got == whole
