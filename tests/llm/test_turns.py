"""Operator 11 against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from cases import bag

from tidemark.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, cost string"
NAMES = {"s": "system", "u": "user", "a": "assistant"}


def damage(rows):
    """(conversation, turn, role, text) of rows after damage."""
    out = []
    for r in rows:
        conv, turn, role, text = r[:4]
        space = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired (role, text) rows): all ways from the end, weights compared in full."""
    n = len(rows)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == n and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            role = "a" if state == "u" else "u"
            cost, audit, rest = best(i, after[state, role], inserted + 1)
            options.append((cost + 5, "I" + audit, ((NAMES[role], ""), *rest)))
        if i < n:
            cost, audit, rest = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                role, text = rows[i]
                if (state, role[:1]) in after:
                    cost, audit, rest = best(i + 1, after[state, role[:1]], 0)
                    options.append((cost + extra, "K" + audit, ((role, text), *rest)))
                new = "a" if state == "u" else "u"
                cost, audit, rest = best(i + 1, after[state, new], 0)
                options.append((cost + extra + 1, "R" + audit, ((NAMES[new], text), *rest)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 0)


def brute(original, rows, hashes):
    out = []
    for conv in {r[0] for r in original}:
        mine = [r[1:] for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1], *hashes[r[2]]))
        seen, faults = set(), []
        for _, role, text in mine:
            core = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        known = {r[0] for r in mine} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, fixed = cheapest([r[1:] for r in mine], faults)
        out.append((
            conv, max(known) - min(known) + 1 - len(known) if known else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(), fixed,
        ))
    return out


def conversations(seed, many=14, length=16):
    rnd = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "no end", "", " \n ", None, "Four. ", "Ünd 文字.", "Two!", "long. " * 40]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "Ares", "usher"]
    rows = []
    for conv in range(many):
        n = rnd.randint(1, length)
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"Turn {turn} of {conv}." if rnd.random() < 0.6 else rnd.choice(texts)
            rows.append((conv, turn if rnd.random() < 0.95 else rnd.choice([None, turn + 2]), role, text, "x", "y"))
    rows += [(None, t, "user", f"null {t}.", None, None) for t in range(3)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0)
    rows += [(99, dropped, "user", "gone.", None, None), rows[3], rows[3]]
    rnd.shuffle(rows)
    return rows


def hashes_of(spark, rows):
    texts = spark.createDataFrame([(t,) for t in {r[3] for r in rows}], "t string")
    return {r[0]: (r[1], r[2]) for r in texts.selectExpr("t", "xxhash64(t)", "xxhash64('second', t)").collect()}


@pytest.mark.parametrize("seed,sizes", [(1, {}), (2, {"large_rows": 3, "slice_rows": 4}), (3, {"large_rows": 0, "slice_rows": 9})])
def test_damage_report(spark, seed, sizes):
    rows = conversations(seed)
    rows += [(50, t, ["user", "assistant"][t % 2], f"Line {t % 11}.", "x", "y") for t in range(60)]
    after = damage(rows)
    want = brute(rows, after, hashes_of(spark, after))
    got = turns.damage_report(spark.createDataFrame(rows, SCHEMA), **sizes)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert bag(got.collect()) == bag(w[:-1] for w in want)


@pytest.mark.parametrize("sizes", [{}, {"large_rows": 2, "slice_rows": 5}])
def test_repaired_rows(spark, sizes):
    rows = [(c, t, " " if r is None else r, " " if x is None else x, "a", "b") for c, t, r, x, *_ in conversations(7)]
    want = brute(rows, [r[:4] for r in rows], hashes_of(spark, rows))
    got = turns.repair_conversations(spark.createDataFrame(rows, SCHEMA), **sizes)
    fixed = {}
    for r in sorted(got.collect(), key=lambda r: r["position"]):
        fixed.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert fixed == {w[0]: list(w[-1]) for w in want if w[-1]}


def test_segments_and_slices_agree_with_one_agenda(monkeypatch):
    rnd = random.Random(5)
    for _ in range(150):
        codes = bytes(rnd.choice([1, 4, 8, 9, 8, 12, 12, 11, 15, 2, 0, 3]) for _ in range(rnd.randint(0, 14)))
        whole = turns._goal(codes)
        for size in (1, 2, 5):
            monkeypatch.setattr(turns, "SEGMENT", size)
            assert turns.cheapest(turns.transfers(codes)) == whole
        changes, state = turns.edits(codes, whole[1])
        assert len(changes) == len(codes) and state in (turns.START, turns.PAIR)


def test_long_conversation_in_one_task(spark):
    rows = [(1, t, ["user", "assistant", "user"][t % 3], f"Line {t}.", "x", "y") for t in range(700)]
    got = turns.repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    small = turns.repair_report(spark.createDataFrame(rows, SCHEMA), large_rows=10, slice_rows=50).first()
    assert got == small and len(got["audit"].replace("I", "")) == 700


def test_empty_table(spark):
    assert turns.damage_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert turns.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
