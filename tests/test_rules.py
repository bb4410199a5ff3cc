import random

import model
import pytest

import tidemark as tm
from tidemark.operators import rule_graph
from tidemark.operators.rule_graph import RuleSetTooLarge

DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b")]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_closure_and_ranks_of_a_diamond(spark):
    book = tm.RuleBook({"x": DIAMOND})
    assert rows(tm.rule_closure(book, spark)) == {
        ("x", "a", "b", 1), ("x", "a", "c", 1), ("x", "b", "d", 1), ("x", "c", "d", 1), ("x", "a", "d", 2),
    }
    assert rows(tm.rule_rank(book, spark)) == {
        ("x", "a", 0, 1), ("x", "b", 1, 2), ("x", "c", 1, 3), ("x", "d", 2, 4),
    }


def test_one_edge_rule_is_a_state_rule(spark):
    book = tm.RuleBook({"x": [("O", "F")]})
    assert rows(tm.rule_rank(book, spark)) == {("x", "O", 0, 1), ("x", "F", 1, 2)}


def test_monotone_rule_has_no_edges(spark):
    rules = tm.load_rules(spark, {"x": DIAMOND}, {"age": ("low", "high")})
    assert rules.count() == 5
    assert tm.rule_edges(rules, "age").count() == 0
    assert tm.rule_edges(rules).count() == 4
    assert tm.RuleBook.from_frame(rules).monotone == {"age": ("low", "high")}


@pytest.mark.parametrize("pairs", [[("a", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]])
def test_cycles_are_rejected(spark, monkeypatch, pairs):
    with pytest.raises(ValueError, match="cycle"):
        tm.RuleBook({"x": pairs})
    rules = spark.createDataFrame([("x", a, b) for a, b in pairs], "attribute string, src string, dst string")
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    for most in (500_000, 0):
        monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", most)
        with pytest.raises(ValueError, match="cycle"):
            tm.rule_closure(rules)
        with pytest.raises(ValueError, match="cycle"):
            tm.rule_rank(rules)


def test_distributed_closure_and_rank_match_the_compiled_ones(spark, monkeypatch):
    rnd = random.Random(3)
    states = {f"a{k}": model.random_pairs(rnd, rnd.randint(2, 9)) for k in range(6)}
    states["chain"] = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    book = tm.RuleBook(states)
    closure, ranks = rows(tm.rule_closure(book, spark)), rows(tm.rule_rank(book, spark))
    for a, pairs in states.items():
        assert {(s, d) for x, s, d, _ in closure if x == a} == model.closure(pairs)
        assert {v: r for x, v, _, r in ranks if x == a} == model.ranks(pairs)
        assert {v: lv for x, v, lv, _ in ranks if x == a} == model.levels(pairs)
    frame = book.frame(spark)
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 3)
    assert rows(tm.rule_closure(frame)) == closure
    assert rows(tm.rule_rank(frame)) == ranks
    with pytest.raises(RuleSetTooLarge):
        tm.RuleBook.from_frame(frame)
    assert rows(tm.rule_closure(tm.RuleBook(states), spark)) == closure
    # attributes larger than a task takes are walked by joins
    monkeypatch.setattr(rule_graph, "MAX_TASK_EDGES", 4)
    monkeypatch.setattr(rule_graph, "MAX_TASK_PAIRS", 4)
    assert rows(tm.rule_closure(frame)) == closure
    assert rows(tm.rule_rank(frame)) == ranks


def test_many_closure_pairs_are_not_listed_on_the_driver(spark, monkeypatch):
    book = tm.RuleBook({"x": [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)]})
    want = rows(tm.rule_closure(book, spark))
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_PAIRS", 5)
    assert rows(tm.rule_closure(book, spark)) == want


@pytest.mark.parametrize("distributed", [False, True])
def test_relation(spark, monkeypatch, distributed):
    rules = tm.load_rules(spark, {"x": DIAMOND})
    if distributed:
        monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    pairs = [("a", "d"), ("d", "a"), ("b", "c"), ("a", "a"), ("a", "?"), (None, "a"), ("c", "d")]
    df = spark.createDataFrame(pairs, "l string, r string")
    got = {(r["l"], r["r"]): r["relation"] for r in tm.relation(df, "l", "r", "x", rules).collect()}
    assert got == dict(zip(pairs, ["<", ">", "<>", "<>", "<>", "<>", "<"]))


def test_rules_from_csv(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("attribute,src,dst,kind\nx,a,b,\nx,b,c,state\nage,low,high,monotone\n")
    rules = tm.load_rules(spark, str(path))
    assert rows(rules) == {("x", "a", "b", "state"), ("x", "b", "c", "state"), ("age", "low", "high", "monotone")}
    assert rows(tm.rule_rank(rules)) == {("x", "a", 0, 1), ("x", "b", 1, 2), ("x", "c", 2, 3)}
