"""Operator 13 against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from cases import awkward, bag, frame, prose

from tidemark.llm import audit

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def failing(text, ids_of, doc_id):
    words = re.findall(r"[^ \t-\r]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return out + ("E" if doc_id is not None and any(x is not None and x < doc_id for x in ids_of[text]) else "")


def brute(rows, labels):
    ids_of = {}
    for r in rows:
        ids_of.setdefault(r[1] or "", set()).add(r[0])
    good = {x[0] for x in labels if x[1] == 1 and x[0] is not None}
    toxic = {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    docs = [(r[2] or "", failing(r[1] or "", ids_of, r[0]), r[0] in good, r[0] in toxic) for r in rows]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone += removed
                unique = sum(d[1] == f for d in docs if d[0] == part)
                lost = sum(d[2] for d in removed), sum(d[3] for d in removed)
                out[part, order, step] = (len(left), len(removed), redundant, unique, *lost)
                shapley[part, f] += len(removed)
    return bag((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def rows_of(seed):
    rnd = random.Random(seed)
    rows = awkward(seed)
    long = " ".join(prose(rnd, 300).split())
    shout = long.upper()[:400] + " # " + long
    for k in range(30):
        rows.append((100 + k, rnd.choice([long, shout, "x y " * 150, "", "same line"]), rnd.choice(["en", "de"]), *[None] * 6))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,spread", [(1, None), (2, 2)])
def test_audit(spark, seed, spread):
    rows = rows_of(seed)
    rnd = random.Random(seed)
    labels = [(r[0], rnd.choice([0, 1, None]), rnd.choice([0, 1]), "x", "y") for r in rows if rnd.random() < 0.6]
    got = audit.filter_audit(frame(spark, rows), spark.createDataFrame(labels, LABELS), spread=spread)
    assert got.columns == (
        "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    )
    assert bag(got.collect()) == brute(rows, labels)


def test_many_hashes_are_joined_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(audit, "HOT", 10**9)
    rows = rows_of(3)
    got = audit.filter_audit(frame(spark, rows), spark.createDataFrame([], LABELS), spread=3)
    assert bag(got.collect()) == brute(rows, [])


def test_equal_hash_of_other_text_is_no_copy(spark):
    rows = spark.createDataFrame([(1, 7, 7, "a"), (2, 7, 7, "b"), (3, 7, 7, "b")], "_id long, _h1 long, _h2 long, _text string")
    got = audit.repeated_texts(rows, rows.drop("_text"))
    assert [r[0] for r in got.collect()] == [3]


def test_pieces_of_a_long_text(monkeypatch):
    text = prose(random.Random(5), 400).encode()
    whole = audit.failed_filters(text)
    for piece in (1, 7, 1000):
        monkeypatch.setattr(audit, "PIECE", piece)
        assert audit.failed_filters(text) == whole


def test_empty_table(spark):
    got = audit.filter_audit(frame(spark, []), spark.createDataFrame([], LABELS))
    assert got.collect() == []
