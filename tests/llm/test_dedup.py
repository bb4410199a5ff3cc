"""Operators 2, 5 and 10 against brute force."""

import glob
import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, bag, frame, order, words_of

from tidemark.llm import blocks, edits, lines, near, repeats, scratch
from tidemark.llm.scratch import components


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates(spark, monkeypatch):
    rows = awkward()
    sets = defaultdict(set)
    for r in rows:
        sets[order(r[0])] |= shingle_set(r[1])
    nodes = sorted({(order(r[0]), r[1] or "") for r in rows})
    links = groups(nodes, lambda a, b: (lambda x, y: x and y and 100 * len(x & y) >= 85 * len(x | y))(shingle_set(a[1]), shingle_set(b[1])))
    want = bag(
        (r[0], len(shingle_set(r[1])), None if (c := links[order(r[0]), r[1] or ""][0]) == -(2**63) else c, c == order(r[0]))
        for r in rows
    )
    assert bag(near.near_duplicates(frame(spark)).collect()) == want
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 2)  # large buckets meet in pairs of blocks
    assert bag(near.near_duplicates(frame(spark)).collect()) == want


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b, c = (" ".join(f"{t}{k}" for k in range(120)) for t in "abc")
    texts = [(3, a), (9, a + " end"), (9, b), (None, c), (None, c + " end"), (None, b[:300])]
    df = frame(spark, [(i, t, *[None] * 7) for i, t in texts])
    got = bag((r["doc_id"], r["component_id"], r["n_shingles"]) for r in near.near_duplicates(df).collect())
    own = {t: len(shingle_set(t)) for _, t in texts}
    assert got == bag([(3, 3, own[a]), (9, 3, own[a + " end"]), (9, 9, own[b]), *[(None, None, own[t]) for _, t in texts[3:]]])
    kept = [(r["doc_id"], r["text"]) for r in near.keep_one_of_each(df).collect()]
    assert len(kept) == 4 and {(3, a), (9, b), (None, b[:300])} < set(kept)


def test_one_document_of_each_group_stays(spark):
    df = frame(spark)
    kept = near.keep_one_of_each(df)
    assert kept.schema == df.schema
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(out) == len(set(out))
    report = {(r["doc_id"], r["n_shingles"]) for r in near.near_duplicates(df).filter("kept").collect()}
    assert {(d, len(shingle_set(t))) for d, t in out} == report


def test_signatures_within_the_radius_share_a_key():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        a = rnd.integers(0, 1 << 16, (1, near.SYMBOLS), dtype=np.uint64)
        b = a.copy()
        at = rnd.choice(near.SYMBOLS, near.RADIUS, replace=False)
        b[0, at] ^= np.uint64(1)
        assert np.intersect1d(near.keys_of(a), near.keys_of(b)).size


def test_many_near_copies_of_one_text(spark):
    """A crowded bucket: copies with one to thirty words changed."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in rnd.sample(range(150), rnd.randint(0, 12)):
            w[p] = f"n{k}_{p}"
        rows.append((k, " ".join(w), None, None, None, None, None, None, None))
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    want = groups(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (40, 41), (41, 42), (42, 43), (43, 44), (10, 44)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, **{k: 10 for k in (10, 40, 41, 42, 43, 44)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows):
    docs = sorted({(order(r[0]), r[1] or "") for r in rows})
    tags = {}
    seen, out = set(), {}
    for key in docs:
        data = key[1].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), int(gone.sum()), len(re.findall(b"\x01+", gone.tobytes())), hashlib.sha256(kept).hexdigest())
    return out, tags


@pytest.mark.parametrize("segment", [1_000_000, 500])
def test_repeated_strings(spark, monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = awkward(2)
    want, _ = brute_repeats(rows)
    got = repeats.repeated_strings(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert bag(tuple(r)[:5] for r in got) == bag((r[0], *want[order(r[0]), r[1] or ""]) for r in rows)
    text = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert all(len(r["removed"]) == 2 * r["n_spans"] for r in text.values())
    assert sum(r["n_removed"] for r in got) > 1_000


def brute_lines(rows):
    occurrences = []
    for key in sorted({(order(r[0]), r[1] or "") for r in rows}):
        for n, line in enumerate(key[1].split("\n")):
            if w := words_of(line):
                occurrences.append((key, n, " ".join(w)))
    return occurrences


def naive_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(3)
    for _ in range(1_500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(14))) for _ in range(2))
        true = naive_distance(a, b)
        assert lines.edit_distance(a, b, 99) == true
        assert (lines.edit_distance(a, b, 3) <= 3) == (true <= 3)


@pytest.mark.parametrize("alone", [-1, 10**9])
def test_many_edit_distances_at_once(monkeypatch, alone):
    """Bounds met and missed by one, bands of one to four words, empty strings, pairs taken out on the way."""
    monkeypatch.setattr(edits, "ALONE", alone)
    monkeypatch.setattr(edits, "PAIRS", 50)
    rnd = random.Random(9)
    texts, most = [], []
    for k in range(400):
        a = [rnd.choice("abcd") for _ in range(rnd.choice([0, 3, 20, 64, 150] + [400] * (k % 20 == 0)))]
        b = list(a)
        for _ in range(rnd.randrange(len(a) // 3 + 2)):
            p = rnd.randrange(len(b) + 1)
            b[p : p + rnd.choice([0, 1, 1, 9])] = rnd.choice([["x"], [], ["a", "b"]])
        a, b = "".join(a), "".join(b)
        true = naive_distance(a, b)
        for bound in {0, true - 1, true, rnd.randrange(250)} - {-1}:
            texts += [a, b]
            most.append((bound, true))
    size = np.array([len(t) for t in texts])
    code = np.array(["abcdx".index(c) for c in "".join(texts)])
    first = np.arange(0, len(texts), 2)
    got = edits.within(code, np.cumsum(size) - size, size, first, first + 1, np.array([m for m, _ in most]))
    assert got.tolist() == [true <= bound for bound, true in most]


def test_many_blocks_of_lines_at_once(monkeypatch):
    """Blocks cut by batch borders give the groups of brute force, and lines that meet in a block of their own are not
    compared again where their block meets another."""
    monkeypatch.setattr(lines, "LINK_ROWS", 30)
    monkeypatch.setattr(lines, "PAIR_ROWS", 64)
    rnd = random.Random(12)
    rows = []
    for leader in range(12):
        base = "".join(rnd.choice("etaoin shrdlu\u00e9\u4e0a") for _ in range(rnd.choice([12, 40, 120])))
        for k in range(rnd.choice([1, 2, 3, 25])):
            line = list(base)
            for _ in range(rnd.randrange(len(base) // 8 + 1)):
                line[rnd.randrange(len(line))] = rnd.choice("qxz")
            rows.append((leader, 0, 0, 0, 1000 * leader + k, "".join(line)))
    many = [r for r in rows if r[0] == max(rows, key=lambda r: r[4] % 1000)[0]]
    cross = [(99, 0, 1, k % 2, 99000 + k, r[5]) for k, r in enumerate(many)]
    names = ["_leader", "_i", "_j", "_own", "_x", "_line_text"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, *cross)))))
    compared = []
    within = edits.within
    monkeypatch.setattr(lines, "within", lambda c, s, n, a, b, m: (compared.append(len(a)), within(c, s, n, a, b, m))[1])

    def root_of(edges):
        root = {x: x for x in table["_x"].to_pylist()}
        for a, b in edges:
            a, b = root[a], root[b]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
        return root

    def far(a, b):
        return naive_distance(a, b) > 0.1 * max(len(a), len(b))

    every = rows + cross
    want = root_of((a[4], b[4]) for k, a in enumerate(every) for b in every[:k] if a[0] == b[0] and (a[1] == a[2] or a[3] != b[3]) and not far(a[5], b[5]))
    for size in (1, 7, len(every)):
        compared.clear()
        out = lines.linked_lines(iter(table.to_batches(max_chunksize=size)))
        edges = [(r["a"], r["b"]) for batch in out for r in batch.to_pylist()]
        assert root_of(edges) == want
        assert len(edges) == len(every) - len(set(want.values()))
    assert len(set(want.values())) > 20 and max(compared) > 10
    pair = pa.table(dict(zip(names, map(list, zip((1, 0, 1, 0, 5, "the same line of text"), (1, 0, 1, 0, 6, "the same line of texts"))))))
    assert sum(b.num_rows for b in lines.linked_lines(iter(pair.to_batches()))) == 0


def test_line_dedup(spark):
    rows = awkward(3)
    long = " ".join(f"longword{k}" for k in range(80))
    rows += [(70, long, *[None] * 7), (71, "first\n" + long.replace("longword7 ", "longwordX "), *[None] * 7)]
    df = frame(spark, rows)
    report = lines.line_report(df).collect()
    assert len(report) == len(rows)
    exact = defaultdict(list)
    for key, n, text in brute_lines(rows):
        exact[text].append((key, n))
    drop = {(r["doc_id"], n) for r in report for n in r["dropped"]}
    for places in exact.values():  # every exact repeat goes, whatever the tie between texts of one id
        ids = [k for k, _ in places]
        if len(set(i for i, _ in ids)) == len(ids):
            for (i, _), n in places[1:]:
                assert (None if i == -(2**63) else i, n) in drop
    texts = {(r["doc_id"], r["text"]) for r in lines.drop_repeated_lines(df).collect()}
    for r in report:
        source = [x[1] for x in rows if x[0] == r["doc_id"]]
        cuts = ["\n".join(l for n, l in enumerate(t.split("\n")) if n not in r["dropped"]) for t in source if t]
        assert not source or not any(source) or any((r["doc_id"], c) in texts for c in cuts)
    assert lines.drop_repeated_lines(df).schema.simpleString() == df.schema.simpleString()
    kept_lines = [" ".join(words_of(l)) for _, t in texts for l in (t or "").split("\n")]
    kept_lines = [l for l in kept_lines if l]
    assert len(kept_lines) == len(set(kept_lines))


def test_fuzzy_lines_are_one_group(spark):
    """All pairs within the edit bound, by brute force."""
    rnd = random.Random(8)
    base = [" ".join(f"w{rnd.randrange(900)}xyz" for _ in range(90)) for _ in range(4)]
    rows = []
    for k in range(60):
        line = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(2)):
            line[rnd.randrange(90)] = f"e{k}zz"
        rows.append((k, " ".join(line), *[None] * 7))
    distinct = sorted({" ".join(words_of(r[1])) for r in rows})

    def linked(a, b):
        return naive_distance(a, b) <= 0.1 * max(len(a), len(b))

    root = groups(distinct, linked)
    want, seen = set(), set()
    for r in rows:
        g = root[" ".join(words_of(r[1]))]
        if g in seen:
            want.add(r[0])
        seen.add(g)
    got = {r["doc_id"] for r in lines.line_report(frame(spark, rows)).filter("n_dropped > 0").collect()}
    assert got == want and len(want) < 60


def edited(rnd, line, budget):
    """A line with changed words, or with single characters changed, put in or taken out, of edit similarity 0.9 or more."""
    out = list(line)
    if rnd.random() < 0.5:
        words = line.split(" ")
        k = rnd.randrange(len(words))
        words[k] = "".join(rnd.choice("qxzjv") for _ in range(min(budget, len(words[k]))))
        out = list(" ".join(words))
    else:
        for _ in range(rnd.randint(1, budget)):
            p = rnd.randrange(len(out))
            out[p : p + 1] = rnd.choice([["q"], [], [out[p], "x"]])
    new = "".join(out)
    return new if lines.similar(line, " ".join(words_of(new))) else line[:-1] + "q"


def test_similar_lines_are_found_by_edit_similarity_alone(spark):
    """Lines of 8 to 40 words and one edited copy of each, up to the whole edit bound."""
    rnd = random.Random(18)
    rows = []
    for k in range(600):
        words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(8, 40))]
        line = " ".join(words)
        rows += [(2 * k, line, *[None] * 7), (2 * k + 1, edited(rnd, line, len(line) // 10), *[None] * 7)]
    assert all(lines.similar(a[1], " ".join(words_of(b[1]))) for a, b in zip(rows[::2], rows[1::2]))
    got = {r["doc_id"] for r in lines.line_report(frame(spark, rows)).filter("n_dropped > 0").collect()}
    assert got <= {r[0] for r in rows[1::2]}
    assert len(got) >= 0.99 * 600


def test_repeats_of_short_lines_go(spark):
    texts = ["Terms of use Privacy\n\nown line 1", "\u4e0a\u6d77" * 20 + "\nTerms of  use privacy", "\u4e0a\u6d77" * 20 + "\n\n}\n}", "\u4e0a\u6d77" * 19 + "\u4e0a"]
    rows = [(k, t, *[None] * 7) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["dropped"] for r in lines.line_report(frame(spark, rows)).collect()}
    assert got == {0: [], 1: [1], 2: [0, 3], 3: [0]}


@pytest.mark.parametrize("empty", [True, False])
def test_empty_tables(spark, empty):
    rows = [] if empty else [(1, None, *[None] * 7)]
    df = frame(spark, rows)
    n = len(rows)
    assert near.near_duplicates(df).count() == n
    assert near.keep_one_of_each(df).count() == n
    assert repeats.repeated_strings(df).count() == n
    assert lines.line_report(df).count() == n
    assert lines.drop_repeated_lines(df).count() == n


def test_crowds_of_lines_over_salts(spark, monkeypatch):
    """Blocks larger than a task settles, with keys dealt over salts, give the same groups."""
    rnd = random.Random(21)
    body = " ".join(f"part{rnd.randrange(900)}" for _ in range(30))
    rows = [(k, f"{body} end{k:03}", *[None] * 7) for k in range(200)]
    rows += [(200 + k, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(9)), *[None] * 7) for k in range(40)]
    for name, value in (("BLOCK_ROWS", 24), ("HOT_ROWS", 20), ("HOT_BATCH", 2)):
        monkeypatch.setattr(lines, name, value)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 24)
    got = {r["doc_id"] for r in lines.line_report(frame(spark, rows).repartition(3)).filter("n_dropped > 0").collect()}
    assert got == set(range(1, 200))


def test_common_windows_at_other_places_make_no_candidates():
    """Rows of one key: lines whose common window cannot be one of similar lines stay apart, whatever their fingerprints."""
    n = np.array([100, 100, 104, 100, 300])
    step = np.array([100, 130, 480, lines.ANYWHERE, 100])
    x, none = np.arange(10, 15), np.zeros(5, lines.U)

    def groups_of(*rows):
        rows = np.array(rows)
        s2 = (step[rows] << lines.SALT_BITS).astype(np.int64).view(lines.U)
        leader, place = lines._parts(np.ones(len(rows), np.int64), n[rows], x[rows], none[rows], s2)
        return sorted(zip(leader.tolist(), x[rows][place].tolist()))

    assert groups_of(0, 1) == []  # six characters before it and six after it: twelve edits of ten
    assert groups_of(0, 2) == []
    assert groups_of(0, 3) == [(10, 10), (10, 13)]
    assert groups_of(0, 0) == [(10, 10), (10, 10)]
    assert groups_of(0, 4) == []


def test_places_of_keys():
    """A window at its place among the steps of the line, and ANYWHERE if the line has it again."""
    rnd = random.Random(5)
    for text in ["".join(rnd.choice("abcdefgh \u00e9") for _ in range(240)), "0123456789ab" * 9, "x" * 50, "short lines"]:
        data = np.frombuffer(text.encode(), np.uint8)
        _, key, place = lines.line_keys(data, np.array([0]), np.array([len(data)]))
        own = int(np.searchsorted(lines.EDGES, len(text), "right")) - 1
        width = int(lines.WIDTHS[own])
        windows = [text[k : k + width] for k in range(len(text) - width + 1)]
        once = {k * lines.ANYWHERE // len(text) for k, w in enumerate(windows) if windows.count(w) == 1}
        assert len(key) and {int(p) for p in place[: lines.GRAMS]} <= once | {lines.ANYWHERE}
        assert (lines.ANYWHERE in place) == (len(set(windows)) < len(windows))


def test_candidates_settle_keys_across_batches():
    """Groups cut by batch borders, equal rows, marks and salts: members as if all came in one batch."""
    rnd = np.random.default_rng(4)
    key = np.sort(rnd.integers(1, 12, 400)) << 16
    n = rnd.integers(50, 54, 400)
    x = rnd.integers(1, 60, 400)
    order = np.lexsort((x, n, key))
    k, x = (key | n)[order], x[order]
    none = np.zeros(400, np.int64)
    table = pa.record_batch([pa.array(v) for v in (k, x, none, none)], ["_k", "_x", "_s1", "_s2"])

    def members(size):
        out = [b for b in lines._candidates(iter([table.slice(i, size) for i in range(0, 400, size)]))]
        return {tuple(r.values()) for b in out for r in b.to_pylist()}

    whole = members(400)
    assert whole and all(members(size) == whole for size in (1, 7, 64, 399))
    assert {r[1] for r in whole} <= {r[2] for r in whole}


def grouped(rows, find):
    """What ``find`` makes of rows (_k, _x, _s1, _s2), sorted as an exchange leaves them."""
    table = pa.Table.from_batches(rows)
    order = np.lexsort([np.asarray(table[c]) for c in ("_x", "_k")])
    return pa.Table.from_batches(find(iter(table.take(pa.array(order)).to_batches(max_chunksize=500))))


def test_lines_of_a_large_key_meet_only_where_they_are_alike():
    """2,400 lines with one window in common, one in forty nearly like the one before: no text of the others is fetched."""
    rnd = np.random.default_rng(31)
    n, step = rnd.integers(100, 300, 2_400), rnd.integers(0, lines.ANYWHERE, 2_400)
    s1, s2 = rnd.integers(0, 2**63, (2, 2_400))
    for v in (n, step, s1, s2):
        v[1::40] = v[::40]
    n[1::40] += 3
    s1[1::40] ^= 0xF00 << 20  # another character
    x = rnd.permutation(2_400)
    columns = (7 << 16 | n, x, s1, s2 & ~lines.LONG | step << lines.SALT_BITS)
    found = grouped([pa.record_batch([pa.array(v) for v in columns], ["_k", "_x", "_s1", "_s2"])], lines._candidates)
    assert len(set(found["_x"].to_pylist())) == 2_400 and found["_key"].null_count == 0
    cells = grouped([*lines._cells(iter(found.to_batches()))], lines._cell_candidates)
    assert cells["_key"].null_count == cells.num_rows
    members = {(r["_leader"], r["_x"]) for r in cells.to_pylist()}
    assert {(min(p), w) for p in zip(x[::40].tolist(), x[1::40].tolist()) for w in p} <= members
    assert len(members) <= 240  # 120 belong there


def test_lines_of_one_cell_are_all_that_may_go_together():
    """Every pair that lengths and places of a window allow shares a cell, at bounds too."""
    rnd = np.random.default_rng(9)
    n = np.concatenate((rnd.integers(10, 400, 300), rnd.integers(60_000, lines.LONG + 1, 40), [90, 100, 900, 1000, lines.LONG]))
    step = rnd.integers(0, lines.ANYWHERE + 1, len(n))
    x, none = np.arange(len(n)), np.zeros(len(n), np.int64)
    batch = pa.record_batch([pa.array(v) for v in (none, x, n, none, step << lines.SALT_BITS)], ["_key", "_x", "_n", "_s1", "_s2"])
    cells = pa.Table.from_batches(lines._cells(iter([batch])))
    of = {}
    for k, who in zip(cells["_k"].to_pylist(), cells["_x"].to_pylist()):
        of.setdefault(who, set()).add(k & lines.KEY)
    order = np.lexsort((x, n))
    for a, b in zip(*(order[v] for v in np.triu_indices(len(n), 1))):
        pair = np.array([a, b])
        s2 = (step[pair] << lines.SALT_BITS).view(lines.U)
        if len(lines._parts(none[:2], n[pair], x[pair], none[:2].view(lines.U), s2)[0]) and n[a] >= 0.9 * n[b] - 1e-6:
            assert of[a] & of[b], (n[pair], step[pair])
    assert max(map(len, of.values())) <= 22


def test_characters_beside_a_window():
    """What is after and before a place within its line, characters of several bytes as one."""
    text = "qé上bcdefg hijklmnopqrstuvwxyz"
    data = np.frombuffer(text.encode(), np.uint8)
    head = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [len(data)]))
    beside, at = lines._Beside(data, head), np.array([0, 3, 14, len(text)])
    letter = {c: int(beside.after(np.array([k]), np.array([1]))[0]) for k, c in enumerate(text)}
    assert all(1 <= v <= 15 for v in letter.values())
    for k, after, before in zip(at, beside.after(at, len(text) - at), beside.before(at, at)):
        assert int(after) == sum(letter[c] << 4 * j for j, c in enumerate(text[k : k + lines.AHEAD]))
        left = text[max(0, k - lines.BEHIND) : k]
        assert int(before) == sum(letter[c] << 4 * (lines.BEHIND - len(left) + j) for j, c in enumerate(left))
    one = beside.after(np.array([3]), np.array([20]))
    assert lines._missed(one, one, lines.AHEAD).tolist() == [0]
    moved = beside.after(np.array([5]), np.array([20]))
    assert lines._missed(one, moved, lines.AHEAD)[0] <= 2 < lines._missed(one, ~one, lines.AHEAD)[0]


def test_a_saved_table_leaves_no_shuffle_files(spark):
    dirs = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}

    before = shuffled()
    kept = scratch.saved(spark.range(20_000).repartition(3, "id"))
    for _ in range(50):  # files go in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == 20_000
    assert spark.conf.get(scratch.CLEANUP) == "false"
