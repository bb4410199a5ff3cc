"""Row-by-row Python models the Spark results are compared with."""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby


def closure(pairs):
    known = set(pairs)
    while True:
        more = known | {(a, d) for a, b in known for c, d in known if b == c}
        if more == known:
            return known
        known = more


def levels(pairs):
    values = {v for p in pairs for v in p}

    @lru_cache(None)
    def level(v):
        return max((level(a) + 1 for a, b in pairs if b == v), default=0)

    return {v: level(v) for v in values}


def ranks(pairs):
    lv = levels(pairs)
    return {v: i + 1 for i, v in enumerate(sorted(lv, key=lambda v: (lv[v], v)))}


def histogram(values):
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    return counts


def latest(values, pairs):
    order, counts = closure(pairs), histogram(values)
    return {v: n for v, n in counts.items() if not any((v, w) in order for w in counts)}


def cvq(values, pairs):
    top = latest(values, pairs)
    return min(top.values()) / sum(top.values()) if top else None


def hsq(values, pairs):
    order, present = closure(pairs), set(histogram(values))

    @lru_cache(None)
    def chain(v):
        return 1 + max((chain(u) for u in present if (u, v) in order), default=0)

    return max(map(chain, present)) / len(present) if present else None


def bridged(values, pairs):
    present = set(histogram(values))
    found = set()
    for u in present:
        front, seen = {u}, set()
        while front:
            step = {b for a, b in pairs if a in front} - seen
            seen |= step
            found |= {(u, v) for v in step & present}
            front = step - present
    return found


def repair_order(rows, reference_pairs, repair_pairs):
    """rows: (vid, reference, value); repair order with nulls first."""
    ref, rep = ranks(reference_pairs), ranks(repair_pairs)

    def text(v):
        return (v is not None, v or "")

    return sorted(rows, key=lambda r: (ref.get(r[1], 0), text(r[1]), rep.get(r[2], 0), text(r[2]), r[0]))


def slide(values, order):
    """The sliding window over single values; returns the repaired list."""
    s = list(values)
    n = len(s)
    lo = hi = 0

    def rel(a, b):
        return "<" if (a, b) in order else ">" if (b, a) in order else "<>"

    for i in range(n - 1):
        window = s[lo:hi]
        here = rel(s[i], s[i + 1])
        if here == "<>":
            hi += 1
        elif here == "<":
            hold = any(rel(w, s[i + 1]) == "<>" for w in window)
            if hold or (i < n - 2 and rel(s[i + 1], s[i + 2]) == ">"):
                hi += 1
            else:
                lo = hi = i + 1
        elif any(rel(w, s[i + 1]) == ">" for w in window):
            s[i + 1] = s[i]
            hi += 1
        else:
            old, s[i] = s[i], s[i + 1]
            if any(rel(w, old) == "<>" for w in window):
                hi += 1
            else:
                lo = hi = i
    return s


def repair(rows, reference_pairs, repair_pairs, compress=False):
    """{vid: repaired value} of one entity."""
    ordered = repair_order(rows, reference_pairs, repair_pairs)
    order = closure(repair_pairs)
    if not compress:
        fixed = slide([r[2] for r in ordered], order)
        return {r[0]: v for r, v in zip(ordered, fixed)}
    runs = [list(g) for _, g in groupby(ordered, key=lambda r: (r[1], r[2]))]
    fixed = slide([g[0][2] for g in runs], order)
    return {r[0]: v for g, v in zip(runs, fixed) for r in g}


def random_pairs(rnd, size, density=None):
    density = density or rnd.choice([0.2, 0.5, 0.8])
    values = [f"v{i}" for i in range(size)]
    return [
        (values[i], values[j])
        for i in range(size)
        for j in range(i + 1, size)
        if rnd.random() < density
    ] or [("v0", "v1")]
