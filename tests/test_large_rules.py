"""Rules too many for the driver: contraction, bridging, the order test, SQL functions, kept histograms."""

import random

import model
import numpy as np
import pytest

import tidemark as tm
from tidemark.operators import bridging, contraction, parts, reach, rule_graph, sent_rules
from tidemark.operators import repair as repair_module

EDGES = "attribute string, src string, dst string"


def dag(rnd, n, share):
    names = rnd.sample(range(1000), n)
    return [(str(names[i]), str(names[j])) for i in range(n) for j in range(i + 1, n) if rnd.random() < share]


def frame(spark, pairs, attribute="x"):
    return spark.createDataFrame([(attribute, a, b) for a, b in pairs], EDGES).checkpoint()


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def jobs(spark, call):
    spark.sparkContext.setJobGroup(name := f"count-{random.random()}", "")
    result = call()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def levels_of(spark, pairs, most):
    def finish(weighted):
        return rule_graph.per_attribute(weighted, rule_graph._task_levels, "attribute string, value string, level long")

    return contraction.levels(frame(spark, pairs), most, finish)


def test_levels_of_a_long_path_take_few_jobs(spark):
    path = [(f"v{k}", f"v{k + 1}") for k in range(3000)]
    (rows, few) = jobs(spark, lambda: levels_of(spark, path, 2).collect())
    assert {r["value"]: r["level"] for r in rows} == {f"v{k}": k for k in range(3001)}
    assert few < 100


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_by_contraction(spark, seed):
    rnd = random.Random(seed)
    pairs = dag(rnd, 14, 0.15) + [(f"p{k}", f"p{k + 1}") for k in range(5)] + [("p3", "q0"), ("q0", "q1")]
    pairs += [("q1", pairs[0][0])]  # a tail before a part that branches and meets
    got = {r["value"]: r["level"] for r in levels_of(spark, pairs, 1 if seed == 1 else 8).collect()}
    assert got == model.levels(pairs)


def reduced(pairs, kept):
    """(a, b) of kept values joined by a path whose inner values are not kept."""
    out, after = set(), {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for a in kept:
        todo, seen = [a], set()
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    if b in kept:
                        out.add((a, b))
                    else:
                        todo.append(b)
    return out


def test_contraction_keeps_the_ways_between_kept_values(spark):
    rnd = random.Random(3)
    pairs = dag(rnd, 25, 0.08) + [(f"p{k}", f"p{k + 1}") for k in range(60)] + [("p60", "q"), ("p10", "q"), ("dead", "end")]
    values = sorted({v for p in pairs for v in p})
    kept = {*rnd.sample(values, 12), "p0", "q"}
    names = spark.createDataFrame([("x", v) for v in kept], "attribute string, value string")
    left = {(r["src"], r["dst"]) for r in contraction.contract(frame(spark, pairs), names).collect()}
    assert reduced(left, kept) == reduced(pairs, kept)
    assert len(left) < len(pairs) / 2


def test_cycles_are_named(spark, monkeypatch):
    ring = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("z", "a")]
    with pytest.raises(ValueError, match="'b' -> 'c' -> 'd' -> 'b'"):
        tm.RuleBook({"x": ring})
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    tangled = [*ring, ("a", "c"), ("z", "d"), ("r", "b"), ("r", "c"), ("r", "d")]
    for most in (100, 0):  # in a task; by joins, with one way back and with several
        monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", most)
        for pairs in (ring, tangled):
            with pytest.raises(ValueError, match="cycle: .*->"):
                tm.rule_rank(frame(spark, pairs))


def entities(rnd, values, n=8):
    rows = [(e, rnd.choice([None, "odd", "odder", *values])) for e in [*range(n), None] for _ in range(rnd.randint(1, 9))]
    return rows + [(99, None)]


@pytest.mark.parametrize("most", [500_000, 0])
def test_bridging_in_tasks_and_by_joins(spark, monkeypatch, most):
    rnd = random.Random(4)
    pairs = dag(rnd, 16 if most else 8, 0.2 if most else 0.3)
    rows = entities(rnd, [p[0] for p in pairs])
    df = spark.createDataFrame(rows, "e int, x string")
    book, edges = tm.RuleBook({"x": pairs}), frame(spark, pairs)
    want = [sorted(map(tuple, f(df, ["e"], ["x"], book).collect()), key=repr) for f in (tm.present_edges, tm.latest_values, tm.cvq, tm.hsq)]
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", most)
    monkeypatch.setattr(bridging, "TASK_VALUES", 5)
    got = [sorted(map(tuple, f(df, ["e"], ["x"], edges).collect()), key=repr) for f in (tm.present_edges, tm.latest_values, tm.cvq, tm.hsq)]
    assert got == want
    if not most:
        return
    kept = tm.histogram(df, ["e"], ["x"])
    assert sorted(map(tuple, tm.cvq_of(kept, ["e"], ["x"], edges).collect()), key=repr) == want[2]
    assert sorted(map(tuple, tm.hsq_of(kept, ["e"], ["x"], edges).collect()), key=repr) == want[3]


def test_large_hsq_runs_no_loop_of_jobs(spark, monkeypatch):
    path = [(f"v{k}", f"v{k + 1}") for k in range(200)]
    df = spark.createDataFrame([(1, f"v{k}") for k in range(0, 201, 2)] + [(2, "v7")], "e int, x string")
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    rows, few = jobs(spark, lambda: tm.hsq(df, ["e"], ["x"], frame(spark, path)).collect())
    assert sorted(map(tuple, rows)) == [(1, 1.0), (2, 1.0)] and few < 60  # the chain has 101 values


def test_masks_made_when_asked_for_are_those_made_at_once():
    rnd = random.Random(10)
    for _ in range(30):
        pairs = dag(rnd, rnd.randint(2, 15), 0.3) or [("a", "b")]
        at_once, lazily = sent_rules.relations_from(pairs, 100), sent_rules.relations_from(pairs, 0)
        for code in range(len(at_once.older)):
            for one, other in zip(at_once, lazily):
                assert one[code] == other[code]


@pytest.mark.parametrize("full", [10_000, 0])
def test_long_entities_are_sliced_under_large_rules(spark, monkeypatch, full):
    rnd = random.Random(11)
    pairs = dag(rnd, 12, 0.3)
    values = [*{v for p in pairs for v in p}, "odd", None]
    rows = [(rnd.choice([1, 1, 1, 2]), k, f"r{rnd.randrange(30):02}", rnd.choice(values)) for k in range(200)]
    df = spark.createDataFrame(rows, "e int, v int, ref string, x string")
    book = {"x": pairs, "ref": [("r00", "r01")]}
    want = sorted(map(tuple, tm.repair(df, ["e"], "v", "ref", "x", tm.RuleBook(book)).collect()), key=repr)
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    monkeypatch.setattr(sent_rules, "FULL_VALUES", full)
    monkeypatch.setattr(repair_module, "_scan_with_own_rules", None)  # no row may hold an entity's edges
    rules = frame(spark, pairs).unionByName(frame(spark, book["ref"], "ref"))
    got = tm.repair(df, ["e"], "v", "ref", "x", rules, max_entity_runs=20)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert want != sorted(rows, key=repr)


def test_index_answers_like_the_closure():
    rnd = random.Random(1)
    for _ in range(60):
        pairs = dag(rnd, rnd.randint(2, 22), rnd.choice([0.05, 0.15, 0.4]))
        if not pairs:
            continue
        want = model.closure(pairs)
        for cells in (10**6, 0):  # a table of chains; labels and search
            index = reach.Index(pairs, cells)
            names = [(a, b) for a in index.number for b in index.number]
            u, v = np.array([(index.number[a], index.number[b]) for a, b in names]).T
            assert {p for p, hit in zip(names, index.reaches(u, v)) if hit} == want


@pytest.mark.parametrize("most", [500_000, 0])
def test_order_test_lists_no_closure(spark, monkeypatch, most):
    rnd = random.Random(6)
    pairs = [(str(k), str(k + d)) for k in range(60 if most else 6) for d in (2, 3)] + dag(rnd, 12 if most else 5, 0.2)
    order = model.closure(pairs)
    values = sorted({v for p in pairs for v in p}) + ["odd", None]
    rows = [(k, rnd.choice(values), rnd.choice(values)) for k in range(150)]
    want = {r[0]: "<" if r[1:] in order else ">" if (r[2], r[1]) in order else "<>" for r in rows}
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", most)
    monkeypatch.setattr(rule_graph, "_closure_of", None)  # nobody may list it
    monkeypatch.setattr(reach, "TASK_PAIRS", 40)
    written = []
    real = reach.ordered_pairs
    monkeypatch.setattr(reach, "ordered_pairs", lambda p, e: written.append((out := real(p, e)).count()) or out)
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = tm.relation(df, "a", "b", "x", frame(spark, pairs)).collect()
    assert {r["k"]: r["relation"] for r in got} == want
    assert written[0] <= len({r[1:] for r in rows})


# --- SQL functions and kept histograms -------------------------------------------------------


def test_scores_in_sql(spark):
    rnd = random.Random(8)
    pairs = {"x": dag(rnd, 9, 0.3), "wide": [(str(k), str(k + 3)) for k in range(90)], "it's": [("a'$", "b\\")]}
    book = tm.RuleBook(pairs)
    rows = [
        (rnd.choice([1, 2, None]), rnd.choice([None, "odd", *pairs["x"][k % 5]]), str(rnd.randrange(99)), rnd.choice(["a'$", "b\\", "?"]), rnd.choice("pq"))
        for k in range(120)
    ] + [(7, None, None, None, None)]
    df = spark.createDataFrame(rows, "e int, x string, wide string, `it's` string, free string")
    df.createOrReplaceTempView("sql_rows")
    names = ["x", "wide", "it's", "free"]
    tm.register_scores(spark, book, names, prefix="t_")
    text = {a: a.replace("'", "\\'") for a in names}
    hsq = ", ".join(
        f"t_hsq('{t}', collect_set(t_ruled('{t}', `{a}`)), count(DISTINCT t_unruled('{t}', `{a}`)))" for a, t in text.items()
    )
    got = spark.sql(f"SELECT e, {hsq} FROM sql_rows GROUP BY e").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, tm.hsq(df, ["e"], names, book).collect()), key=repr)
    for a, t in text.items():
        got = spark.sql(
            f"""SELECT e, t_cvq('{t}', collect_list(t_ruled_cell('{t}', value, n)), min(t_unruled_count('{t}', value, n)),
                  sum(t_unruled_count('{t}', value, n)))
                FROM (SELECT e, `{a}` AS value, count(*) AS n FROM sql_rows GROUP BY ALL) GROUP BY e"""
        ).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, tm.cvq(df, ["e"], [a], book).collect()), key=repr)
    whole = spark.sql("SELECT t_hsq('x', collect_set(t_ruled('x', x)), count(DISTINCT t_unruled('x', x))) FROM sql_rows")
    assert whole.first()[0] == tm.hsq(df, [], ["x"], book).first()[0]
    with pytest.raises(ValueError, match="512"):
        tm.register_scores(spark, tm.RuleBook({"x": [(str(k), str(k + 1)) for k in range(600)]}), ["x"])


def test_merged_histograms_score_like_all_rows(spark):
    rnd = random.Random(9)
    book = tm.RuleBook({"x": dag(rnd, 9, 0.3), "y": [("a", "b")]})
    values = [None, "odd", *{v for p in book.states["x"] for v in p}]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(values), rnd.choice("abc")) for _ in range(90)] + [(8, None, None)]
    make = lambda part: spark.createDataFrame(part, "e int, x string, y string")
    old, new = tm.histogram(make(rows[:50]), ["e"], ["x", "y"]), tm.histogram(make(rows[50:]), ["e"], ["x", "y"])
    merged = tm.merge_histograms(["e"], old, new)
    for of_rows, of_counts in ((tm.cvq, tm.cvq_of), (tm.hsq, tm.hsq_of)):
        want = of_rows(make(rows), ["e"], ["x", "y"], book).collect()
        assert sorted(map(tuple, of_counts(merged, ["e"], ["x", "y"], book).collect()), key=repr) == sorted(map(tuple, want), key=repr)


# --- connected parts -------------------------------------------------------------------------


@pytest.mark.parametrize("task_links", [500_000, 0])
def test_connected_parts(spark, monkeypatch, task_links):
    rnd = random.Random(12)
    pairs = [(a, b) for k in range(0, 400, 20) for a, b in ((rnd.randrange(k, k + 20), rnd.randrange(k, k + 20)) for _ in range(25))]
    pairs += [(1000 + k, 1001 + k) for k in range(200)] + [(2000, 2001 + k) for k in range(200)] + [(3000, 3000)]
    monkeypatch.setattr(parts, "TASK_LINKS", task_links)
    got = {r["node"]: r["part"] for r in parts.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {v: v for p in pairs for v in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert set(got) == set(want)
    assert len({(got[v], want[v]) for v in want}) == len(set(got.values())) == len(set(want.values()))


def test_a_large_attribute_is_walked_in_its_parts(spark, monkeypatch):
    """No joins step by step while every connected part fits a task; one that does not is still walked by them."""
    rnd = random.Random(13)
    pairs = [(f"{c}.{k}", f"{c}.{k + d}") for c in range(6) for k in range(7) for d in (2, 3)] + [("a", "b"), ("b", "c")]
    values = sorted({v for p in pairs for v in p})
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([*values, "odd", None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "e int, x string")
    two = spark.createDataFrame([(k, rnd.choice(values), rnd.choice(values)) for k in range(200)] + [(k, *pairs[k]) for k in range(40)], "k int, a string, b string")
    calls = (
        lambda r: tm.present_edges(df, ["e"], ["x"], r), lambda r: tm.latest_values(df, ["e"], ["x"], r),
        lambda r: tm.cvq(df, ["e"], ["x"], r), lambda r: tm.hsq(df, ["e"], ["x"], r), lambda r: tm.relation(two, "a", "b", "x", r),
        lambda r: tm.rule_rank(r, spark),
    )
    want = [sorted(map(tuple, f(tm.RuleBook({"x": pairs})).collect()), key=repr) for f in calls]
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", 15)
    for module, name in ((bridging, "_by_frontier"), (reach, "_by_search"), (rule_graph, "_levels_by_joins")):
        monkeypatch.setattr(module, name, None)
    edges = frame(spark, pairs)
    assert [sorted(map(tuple, f(edges).collect()), key=repr) for f in calls] == want
    with pytest.raises(ValueError, match="'b' -> 'c' -> 'd' -> 'b'|'c' -> 'd' -> 'b' -> 'c'|'d' -> 'b' -> 'c' -> 'd'"):
        tm.cvq(df, ["e"], ["x"], frame(spark, [*pairs, ("c", "d"), ("d", "b")]))
