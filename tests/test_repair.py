import random

import model
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators import repair as repair_module
from tidemark.operators import skew

SCHEMA = "eid string, vid int, ref string, x string, other double"


def case(seed, entities=25, odd_refs=()):
    rnd = random.Random(seed)
    pairs = {"ref": model.random_pairs(rnd, 4), "x": model.random_pairs(rnd, 6)}
    data = {}
    for e in range(entities):
        data[f"e{e}"] = [
            (
                vid,
                rnd.choice(["v0", "v1", "v2", "v3", "?", None, *odd_refs]),
                rnd.choice(["v0", "v1", "v2", "v3", "v4", "v5", "?", "!", None]),
            )
            for vid in rnd.sample(range(100, 200), rnd.randint(1, 30))
        ]
    return pairs, data


def frame(spark, data):
    rows = [(e, v, r, x, v / 2) for e, versions in data.items() for v, r, x in versions]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(data, pairs, compress=False):
    return {
        (e, vid): value
        for e, versions in data.items()
        for vid, value in model.repair(versions, pairs["ref"], pairs["x"], compress).items()
    }


def values(df):
    rows = df.collect()
    out = {(r["eid"], r["vid"]): r["x"] for r in rows}
    assert len(out) == len(rows)
    return out


ARGS = (["eid"], "vid", "ref", "x")


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_repair_matches_the_model(spark, compress, seed):
    pairs, data = case(seed)
    df = frame(spark, data)
    fixed = tm.repair(df, *ARGS, tm.RuleBook(pairs), compress_runs=compress)
    assert fixed.columns == df.columns
    assert values(fixed) == expected(data, pairs, compress)
    # only the repair column changes, and only to values of the same entity
    assert fixed.drop("x").exceptAll(df.drop("x")).isEmpty()
    for (e, _), v in values(fixed).items():
        assert v in {x for _, _, x in data[e]}


def test_shuffled_join_and_hot_runs_give_the_same(spark, monkeypatch):
    pairs, data = case(3)
    df = frame(spark, data)
    monkeypatch.setattr(repair_module, "MAX_BROADCAST_BYTES", -1)
    want = expected(data, pairs)
    assert values(tm.repair(df, *ARGS, tm.RuleBook(pairs))) == want
    monkeypatch.setattr(skew, "HOT_SALTS", 3)
    assert values(tm.repair(df, *ARGS, tm.RuleBook(pairs), min_hot_rows=2)) == want


@pytest.mark.parametrize("compress", [False, True])
def test_long_entities_are_scanned_in_slices(spark, compress):
    odd = [f"odd{i}" for i in range(40)]
    pairs, data = case(4, entities=4, odd_refs=odd)
    rnd = random.Random(9)
    data["big"] = [(v, rnd.choice(odd), f"v{rnd.randrange(6)}") for v in range(150)]
    df = frame(spark, data)
    fixed = tm.repair(df, *ARGS, tm.RuleBook(pairs), compress_runs=compress, max_entity_runs=20)
    assert values(fixed) == expected(data, pairs, compress)


@pytest.mark.parametrize("limit", [None, 7])
def test_one_entity_is_the_whole_table(spark, limit):
    pairs, data = case(6, entities=1, odd_refs=["odd1", "odd2", "odd3"])
    df = frame(spark, data).drop("eid")
    fixed = tm.repair(df, [], "vid", "ref", "x", tm.RuleBook(pairs), max_entity_runs=limit)
    got = {("e0", r["vid"]): r["x"] for r in fixed.collect()}
    assert got == expected(data, pairs)


def test_nothing_changes_without_reason(spark):
    data = {"forward": [(1, "r", "a"), (2, "r", "b"), (3, "r", "c")], "single": [(1, "r", "c")]}
    df = frame(spark, data)
    rules = tm.RuleBook({"x": [("a", "b"), ("b", "c")]})
    assert tm.repair(df, *ARGS, rules).exceptAll(df).isEmpty()
    assert tm.repair(df, *ARGS, tm.RuleBook({})).exceptAll(df).isEmpty()
    assert tm.repair(df.filter("false"), *ARGS, rules).isEmpty()


def test_modes_differ_by_votes(spark):
    data = {"e": [(1, "r1", "b"), (2, "r1", "b"), (3, "r2", "a")]}
    rules = tm.RuleBook({"ref": [("r1", "r2")], "x": [("a", "b")]})
    df = frame(spark, data)
    assert set(values(tm.repair(df, *ARGS, rules)).values()) == {"b"}
    assert set(values(tm.repair(df, *ARGS, rules, compress_runs=True)).values()) == {"a"}


def test_numeric_columns_keep_their_type(spark):
    df = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1)], "eid int, vid int, ref int, x int")
    fixed = tm.repair(df, *ARGS, tm.RuleBook({"ref": [("1", "2")], "x": [("1", "2")]}))
    assert fixed.schema["x"].dataType == df.schema["x"].dataType
    assert sorted(r["x"] for r in fixed.collect()) == [1, 1]


def test_same_version_number_in_two_entities(spark):
    pairs = {"ref": [("r1", "r2")], "x": [("a", "b")]}
    data = {"e": [(1, "r1", "b"), (2, "r2", "a")], "f": [(1, "r1", "a"), (2, "r2", "b")]}
    rules = tm.RuleBook(pairs)
    df = frame(spark, data)
    cells = tm.repaired_cells(df, *ARGS, rules)
    joined = tm.join_back(df, cells, ["eid"], "vid", "x")
    assert joined.columns == df.columns and joined.count() == 4
    assert values(joined) == expected(data, pairs)
    with pytest.raises(Exception, match="not unique"):
        tm.join_back(df, cells.unionByName(cells), ["eid"], "vid", "x").collect()


@pytest.mark.parametrize("limit", [None, 4])
def test_errors_are_backward_neighbours(spark, limit):
    pairs, data = case(7)
    order = model.closure(pairs["x"])
    want = set()
    for e, versions in data.items():
        rows = model.repair_order(versions, pairs["ref"], pairs["x"])
        want |= {(e, a[0], b[0], a[2], b[2]) for a, b in zip(rows, rows[1:]) if (b[2], a[2]) in order}
    found = tm.detect_errors(frame(spark, data), *ARGS, tm.RuleBook(pairs), max_group_rows=limit).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("limit", [None, 4])
def test_ranks_and_runs(spark, limit, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_RUNS", 10)
    pairs, data = case(8)
    rules = tm.RuleBook(pairs)
    df = frame(spark, data)
    ref_rank = model.ranks(pairs["ref"])
    static = tm.static_rank(df, "ref", rules).collect()
    assert all(r["ref_rank"] == ref_rank.get(r["ref"], 0) for r in static)
    dense = tm.dense_topo_rank(df, ["eid"], "ref", rules, "vid", max_group_rows=limit)
    numbered = tm.topo_row_number(df, ["eid", "ref"], "x", rules, "vid", max_group_rows=limit)
    runs = tm.run_compress(df, *ARGS, rules, max_group_rows=limit)
    groups = {(r["eid"], r["vid"]): r["group_id"] for r in dense.collect()}
    sorts = {(r["eid"], r["vid"]): r["sort_id"] for r in numbered.collect()}
    got_runs = {(r["eid"], r["run_id"]): (r["vid"], r["ref"], r["x"], r["run_rows"]) for r in runs.collect()}
    want_groups, want_sorts, want_runs = {}, {}, {}
    for e, versions in data.items():
        group = sort = run = 0
        before = None
        for vid, ref, x in model.repair_order(versions, pairs["ref"], pairs["x"]):
            if before is None or before[0] != ref:
                group, sort = group + 1, 0
            if before != (ref, x):
                run += 1
                want_runs[e, run] = (vid, ref, x, 0)
            before = (ref, x)
            sort += 1
            want_groups[e, vid], want_sorts[e, vid] = group, sort
            first = want_runs[e, run]
            want_runs[e, run] = (*first[:3], first[3] + 1)
    assert groups == want_groups
    assert sorts == want_sorts
    assert got_runs == want_runs


def test_ranks_by_distributed_rules(spark, monkeypatch):
    from tidemark.operators import rule_graph

    pairs, data = case(10, entities=5)
    frame_rules = tm.RuleBook(pairs).frame(spark)
    df = frame(spark, data)
    want = {tuple(r) for r in tm.static_rank(df, "ref", tm.RuleBook(pairs)).collect()}
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    assert {tuple(r) for r in tm.static_rank(df, "ref", frame_rules).collect()} == want
    for compress in (False, True):
        fixed = tm.repair(df, *ARGS, frame_rules, compress_runs=compress)
        assert values(fixed) == expected(data, pairs, compress)


def test_repair_never_shuffles_rows_when_few_runs_change(spark):
    pairs, data = case(12)
    fixed = tm.repair(frame(spark, data), *ARGS, tm.RuleBook(pairs))
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_large_group_numbering_is_split(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"), "id")
    got = skew.row_numbers(df, ["k"], [F.col("id").desc()], "n", max_group_rows=100)
    want = skew.row_numbers(df, ["k"], [F.col("id").desc()], "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    whole = skew.row_numbers(df, [], [F.col("id")], "n", max_group_rows=100)
    assert whole.filter(F.col("n") != F.col("id") + 1).isEmpty() and whole.count() == 4000
