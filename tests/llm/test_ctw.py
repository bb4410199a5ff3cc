"""Operator 3 against a plain context tree."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, frame, prose, words_of

from tidemark.llm import ctw


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Tree:
    """Nodes by (context, bit prefix), everything in dictionaries and logarithms."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        for t in texts:
            data = bytes(ctw.DEPTH) + (t or "").encode()
            for p in range(ctw.DEPTH, len(data)):
                for d in range(ctw.DEPTH + 1):
                    for k in range(8):
                        node = (1 << k) | data[p] >> (8 - k)
                        self.counts[data[p - d : p], node][data[p] >> (7 - k) & 1] += 1
        self.contexts = {c for c, _ in self.counts}
        children = defaultdict(list)
        for c in self.contexts:
            if c:
                children[c[1:]].append(c)
        self.stop = {}
        total = {}
        for c, node in sorted(self.counts, key=lambda x: -len(x[0])):
            a, b = self.counts[c, node]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(c) == ctw.DEPTH:
                own = whole = kt
            else:
                below = sum(total.get((x, node), 0.0) for x in children[c])
                own = math.log(0.5) + kt
                whole = max(own, below + math.log(0.5))
                whole += math.log(math.exp(own - whole) + math.exp(below + math.log(0.5) - whole))
            total[c, node] = whole
            self.stop[c, node] = math.exp(own - whole)

    def log10(self, text):
        data = bytes(ctw.DEPTH) + (text or "").encode()
        out = 0.0
        for p in range(ctw.DEPTH, len(data)):
            path = [data[p - d : p] for d in range(ctw.DEPTH + 1) if data[p - d : p] in self.contexts]
            for k in range(8):
                node = (1 << k) | data[p] >> (8 - k)
                one, free = 0.0, 1.0
                for n, c in enumerate(path):
                    a, b = self.counts.get((c, node), (0, 0))
                    stop = self.stop.get((c, node), 0.5) if n < len(path) - 1 else 1.0
                    one += free * stop * (b + 0.5) / (a + b + 1)
                    free *= 1 - stop
                bit = data[p] >> (7 - k) & 1
                out += math.log10((one if bit else 1 - one) if path else 0.5)
        return out


@pytest.mark.parametrize("heavy", [500_000, 20])
def test_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(ctw, "HEAVY", heavy)
    rows = awkward(5)
    train = [r for r in rows if not held_out(r[0])]
    assert 0 < len(train) < len(rows)
    tree = Tree([r[1] for r in train])
    counts = Counter()
    for r in train:
        counts.update([*words_of(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    got = sorted(ctw.lm_scores(frame(spark, rows)).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(rows, key=lambda r: (str(r[0]), len(words_of(r[1]))))
    assert len(got) == len(want)
    for g, r in zip(got, want):
        tokens = [*words_of(r[1]), None]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (g["doc_id"], g["held_out"], g["n_tokens"]) == (r[0], held_out(r[0]), len(tokens))
        assert (g["n_known"], g["train_tokens"]) == (sum(counts[t] > 0 for t in tokens), n)
        assert g["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert g["score"] == pytest.approx(tree.log10(r[1]), rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("held", [1_000_000, 50, 0])
def test_rare_contexts_count(spark, monkeypatch, held):
    """More training bytes than any bound on contexts there was, in tasks, groups and rows of all sizes."""
    monkeypatch.setattr(ctw, "HELD", held)
    monkeypatch.setattr(ctw, "_ROWS", 700)
    rnd = random.Random(6)
    rows = [(k, prose(rnd, 60) + f" {k:x}q \u4e0a" + chr(0x4E00 + k), *[None] * 7) for k in range(150)]
    train = [r for r in rows if not held_out(r[0])]
    assert sum(len(r[1].encode()) for r in train) > 33_000
    tree = Tree([r[1] for r in train])
    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0]] == pytest.approx(tree.log10(r[1]), rel=1e-5, abs=1e-5)


def test_bytes_of_a_context_sum_to_one(spark):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, 60), *[None] * 7) for k in range(30)]
    tables = [x.toArrow() for x in ctw.weighted_nodes(_grams(spark, rows), 3)]
    logs, _, _ = ctw.Model(tables).tables()
    assert abs((10.0**logs.astype(float)).sum(axis=1) - 1).max() < 1e-4


def _grams(spark, rows):
    counts = Counter()
    for r in rows:
        data = bytes(ctw.DEPTH) + r[1].encode()
        counts.update(int.from_bytes(data[p - ctw.DEPTH : p + 1], "big") for p in range(ctw.DEPTH, len(data)))
    return spark.createDataFrame(list(counts.items()), "_key long, _c long")


def test_fewer_contexts_still_learn(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(k, prose(rnd, 120), *[None] * 7) for k in range(60)]
    df = frame(spark, rows)
    bits = {}
    for contexts in (4, 32_768):
        monkeypatch.setattr(ctw, "CONTEXTS", contexts)
        scored = [r for r in ctw.lm_scores(df).collect() if r["held_out"]]
        n = sum(len(rows[r["doc_id"]][1].encode()) for r in scored)
        bits[contexts] = -sum(r["score"] for r in scored) / math.log10(2) / n
    assert bits[32_768] < bits[4] < 8


def test_empty_and_untrained(spark):
    assert ctw.lm_scores(frame(spark, [])).count() == 0
    held = next(k for k in range(100) if held_out(k))
    (row,) = ctw.lm_scores(frame(spark, [(held, "ab", *[None] * 7)])).collect()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0
    assert row["score"] == pytest.approx(-16 * math.log10(2), rel=1e-6)
