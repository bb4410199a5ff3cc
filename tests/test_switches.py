"""One answer on both sides of every size switch, and free column names."""

import os
import subprocess
import sys

import model
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators import histogram, repair as repair_module, rule_graph, skew

PAIRS = {"x": [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "ref": [("r1", "r2"), ("r2", "r3")]}
ROWS = [
    (None, 1, "r1", "c"), (None, 2, "r2", "a"), (None, 3, "r3", "a"), (None, 4, "r3", None),
    (1, 1, "r1", "b"), (1, 2, "r2", "odd"), (1, 3, "r2", "a"), (1, 4, "odd ref", "d"),
    (2, 1, "r3", "odd"), (2, 2, "r1", None), (3, 1, None, None),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "e int, v int, ref string, x string")


def results(spark, rules):
    df = frame(spark)
    out = {
        "cvq": tm.cvq(df, ["e"], ["x", "ref"], rules),
        "hsq": tm.hsq(df, ["e"], ["x", "ref"], rules),
        "latest": tm.latest_values(df, ["e"], ["x", "ref"], rules),
        "present": tm.present_edges(df, ["e"], ["x", "ref"], rules),
        "rank": tm.static_rank(df, "x", rules),
        "errors": tm.detect_errors(df, ["e"], "v", "ref", "x", rules),
        "repair": tm.repair(df, ["e"], "v", "ref", "x", rules),
        "compressed": tm.repair(df, ["e"], "v", "ref", "x", rules, compress_runs=True),
    }
    return {k: sorted(map(tuple, v.collect()), key=repr) for k, v in out.items()}


@pytest.mark.parametrize(
    "switches",
    [
        [(histogram, "MAX_MASK_VALUES", 0)],
        [(rule_graph, "MAX_DRIVER_EDGES", 0)],
        [(rule_graph, "MAX_DRIVER_EDGES", 0), (rule_graph, "MAX_TASK_EDGES", 0), (rule_graph, "MAX_TASK_PAIRS", 0)],
        [(rule_graph, "MAX_DRIVER_EDGES", 0), (rule_graph, "MAX_BROADCAST_BYTES", -1), (repair_module, "MAX_BROADCAST_BYTES", -1)],
    ],
)
def test_switches_change_nothing(spark, monkeypatch, switches):
    book = tm.RuleBook(PAIRS)
    want = results(spark, book)
    null = {r[0]: r[1] for r in want["cvq"]}
    assert null[None] == model.cvq(["c", "a", "a"], PAIRS["x"]) == 1.0
    rules = book.frame(spark)
    for module, name, value in switches:
        monkeypatch.setattr(module, name, value)
    assert results(spark, rules if rule_graph.MAX_DRIVER_EDGES == 0 else book) == want


def test_cycles_raise_on_both_sides(spark, monkeypatch):
    rules = spark.createDataFrame([("x", "a", "b"), ("x", "b", "a")], "attribute string, src string, dst string")
    df = frame(spark)
    calls = [
        lambda: tm.cvq(df, ["e"], ["x"], rules),
        lambda: tm.hsq(df, ["e"], ["x"], rules),
        lambda: tm.latest_values(df, ["e"], ["x"], rules),
        lambda: tm.present_edges(df, ["e"], ["x"], rules),
        lambda: tm.static_rank(df, "x", rules),
        lambda: tm.detect_errors(df, ["e"], "v", "ref", "x", rules),
        lambda: tm.repair(df, ["e"], "v", "ref", "x", rules),
    ]
    for most in (10_000, 0):
        monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", most)
        for call in calls:
            with pytest.raises(ValueError, match="cycle"):
                call()


def test_only_the_rules_in_use_count(spark, monkeypatch):
    many = {**PAIRS, "other": [(f"a{k}", f"a{k + 1}") for k in range(50)]}
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 20)
    rules = tm.load_rules(spark, many)
    assert rules.count() == 56
    assert isinstance(rule_graph.rules_in_use(rules, ["x", "ref"], spark), tm.RuleBook)
    assert isinstance(rule_graph.rules_in_use(tm.RuleBook(many), ["x"], spark), tm.RuleBook)


@pytest.mark.parametrize("name", ["slot", "code", "_rank", "_k0", "odd", "_rv"])
def test_keys_may_have_any_name(spark, name):
    book = tm.RuleBook(PAIRS)
    df = frame(spark)
    named = df.withColumnRenamed("e", name)
    for got, want in (
        (tm.value_counts(named, [name], ["x"], "v"), tm.value_counts(df, ["e"], ["x"], "v")),
        (tm.latest_values(named, [name], ["x"], book), tm.latest_values(df, ["e"], ["x"], book)),
        (tm.present_edges(named, [name], ["x"], book), tm.present_edges(df, ["e"], ["x"], book)),
        (tm.dense_topo_rank(named, [name], "x", book, "v"), tm.dense_topo_rank(df, ["e"], "x", book, "v")),
        (tm.topo_row_number(named, [name], "x", book, "v"), tm.topo_row_number(df, ["e"], "x", book, "v")),
        (tm.run_compress(named, [name], "v", "ref", "x", book), tm.run_compress(df, ["e"], "v", "ref", "x", book)),
        (tm.detect_errors(named, [name], "v", "ref", "x", book), tm.detect_errors(df, ["e"], "v", "ref", "x", book)),
        (tm.repair(named, [name], "v", "ref", "x", book), tm.repair(df, ["e"], "v", "ref", "x", book)),
    ):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_clashing_outputs_are_named(spark):
    book = tm.RuleBook(PAIRS)
    named = frame(spark).withColumnRenamed("e", "value")
    for call in (
        lambda: tm.value_counts(named, ["value"], ["x"]),
        lambda: tm.latest_values(named, ["value"], ["x"], book),
        lambda: tm.detect_errors(named, ["value"], "v", "ref", "x", book),
        lambda: tm.static_rank(named, "x", book, "ref"),
    ):
        with pytest.raises(ValueError, match="two columns"):
            call()
    got = tm.detect_errors(named, ["value"], "v", "ref", "x", book, names=("next", "old", "new"))
    want = tm.detect_errors(frame(spark), ["e"], "v", "ref", "x", book)
    assert got.columns == ["value", "v", "next", "old", "new"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_sliced_repair_takes_as_many_rounds_for_any_number_of_slices(spark, monkeypatch):
    book = tm.RuleBook({"x": [(f"v{k}", f"v{k + 1}") for k in range(3)]})
    rounds = []
    original = repair_module._summarizer
    monkeypatch.setattr(repair_module, "_summarizer", lambda *a: rounds.append(1) or original(*a))
    seen = {}
    for n in (200, 2_000):
        rows = [(1, 0, "o00000", "v3"), (1, 1, "o00001", "none")] + [(1, k, f"o{k:05d}", f"v{k % 2}") for k in range(2, n)]
        df = spark.createDataFrame(rows, "e int, v int, ref string, x string")
        rounds.clear()
        got = {r["v"]: r["x"] for r in tm.repair(df, ["e"], "v", "ref", "x", book, max_entity_runs=10).collect()}
        seen[n] = len(rounds)
        if n == 200:
            whole = {r["v"]: r["x"] for r in tm.repair(df, ["e"], "v", "ref", "x", book).collect()}
            assert got == whole
    assert seen[200] == seen[2_000] <= 4


def test_groups_are_bounded_whatever_the_table(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    _, large, total = skew.split_groups(df, ["k"], 10)
    assert total == 3000 and large.count() == 3000


def test_tasks_need_no_installed_library(tmp_path):
    """A repair from another folder: only the driver can import the library."""
    code = """
import sys
sys.path.insert(0, ROOT)
import tidemark as tm
from tidemark.session import local_session
spark = local_session(2)
df = spark.createDataFrame([(1, 1, "r1", "b"), (1, 2, "r2", "a"), (1, 3, "r3", "b")], "e int, v int, ref string, x string")
rules = tm.RuleBook({"x": [("a", "b")], "ref": [("r1", "r2"), ("r2", "r3")]})
print("ROWS", tm.repair(df, ["e"], "v", "ref", "x", rules).count(), tm.present_edges(df, ["e"], ["x"], rules).count())
""".replace("ROOT", repr(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3 1" in done.stdout, done.stderr[-2000:]


def test_csv_keeps_every_text(spark, tmp_path):
    texts = ["", None, " pad ", 'a "quoted" one', "back\\slash\\", ",", "'", "\\N", '"']
    df = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "k int, t string, u string")
    path = str(tmp_path / "t")
    tm.save_table(df, path)
    for schema in (df.schema, None):
        got = {int(r["k"]): (r["t"], r["u"]) for r in tm.load_table(spark, path, schema).collect()}
        assert got == {k: (t, t) for k, t in enumerate(texts)}
    broken = spark.createDataFrame([(1, "x\ny"), (2, "x\r\ny")], "k int, t string")
    with pytest.raises(Exception, match="line break"):
        tm.save_table(broken, path)
    tm.save_table(broken, path, multiline=True)
    assert {r["t"] for r in tm.load_table(spark, path, multiline=True).collect()} == {"x\ny", "x\r\ny"}


@pytest.mark.parametrize("row", ["1", "1,2,3"])
def test_short_and_long_rows_are_errors(spark, tmp_path, row):
    path = tmp_path / "rows.csv"
    path.write_text(f"a,b\n1,2\n{row}\n")
    for call in (lambda t: t.collect(), lambda t: t.count(), lambda t: t.select("a").collect()):
        with pytest.raises(Exception):
            call(tm.load_table(spark, str(path)))
