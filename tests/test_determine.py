import random

import model
import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators import determine, histogram, rule_graph

ABC = [("a", "b"), ("b", "c")]
FORK = [("a", "b"), ("a", "c")]


def table(spark, entities):
    rows = [(e, i, v) for e, values in entities.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "eid string, vid int, x string")


def score(spark, metric, values, pairs):
    df = table(spark, {"e": values})
    rules = tm.RuleBook({"x": pairs} if pairs else {})
    return getattr(tm, metric)(df, ["eid"], ["x"], rules).first()[f"x_{metric}"]


@pytest.mark.parametrize(
    "values, pairs, cvq, hsq",
    [
        (["a", "b", "b", "c"], ABC, 1.0, 1.0),  # one latest value
        (["a", "b", "b", "c"], FORK, 1 / 3, 2 / 3),  # two incomparable latest values
        (["a", "c"], ABC, 1.0, 1.0),  # the value in between is absent
        (["a", "c", "?"], ABC, 0.5, 2 / 3),  # a value outside the rules
        (["a", "a", "b"], [], 1 / 3, 0.5),  # no rule
        (["O", "F"], [("O", "F")], 1.0, 1.0),  # one-edge rule
        (["a", None, None, "c"], ABC, 1.0, 1.0),  # nulls are ignored
        (["a"], ABC, 1.0, 1.0),  # single row
        ([None], ABC, None, None),
        (["?", "?", "!"], ABC, 1 / 3, 0.5),  # nothing inside the rules
    ],
)
def test_small_entities(spark, values, pairs, cvq, hsq):
    assert score(spark, "cvq", values, pairs) == cvq
    assert score(spark, "hsq", values, pairs) == hsq


def test_empty_input(spark):
    df = table(spark, {"e": ["a"]}).filter("false")
    rules = tm.RuleBook({"x": ABC})
    assert tm.cvq(df, ["eid"], ["x"], rules).count() == 0
    assert tm.cvq(df, [], ["x"], rules).collect()[0][0] is None
    assert tm.hsq(df, [], ["x"], rules).collect()[0][0] is None


def test_numbers_are_compared_as_text(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 2)], "eid int, vid int, x int")
    rules = tm.RuleBook({"x": [("2", "10")]})
    assert tm.cvq(df, ["eid"], ["x"], rules).first()["x_cvq"] == 1.0
    assert tm.hsq(df, ["eid"], ["x"], rules).first()["x_hsq"] == 1.0


def random_case(seed, size):
    rnd = random.Random(seed)
    pairs = {"x": model.random_pairs(rnd, size), "y": model.random_pairs(rnd, 4)}
    data = {}
    for e in range(30):
        data[e] = [
            (
                rnd.choice([f"v{i}" for i in range(size)] + ["?", "!", None]),
                rnd.choice(["v0", "v1", "v2", "v3", "it's", None]),
            )
            for _ in range(rnd.randint(1, 25))
        ]
    data[30] = [(None, None)] * 3
    return pairs, data


# Every strategy gives the same scores: counters, collected histograms, joins.
@pytest.mark.parametrize("size, counted, masks", [(8, 16, 512), (8, 0, 512), (70, 16, 512), (8, 16, 0)])
def test_random_entities(spark, monkeypatch, size, counted, masks):
    monkeypatch.setattr(determine, "MAX_COUNTED_VALUES", counted)
    monkeypatch.setattr(histogram, "MAX_MASK_VALUES", masks)
    pairs, data = random_case(size + counted, size)
    rows = [(e, i, x, y) for e, vs in data.items() for i, (x, y) in enumerate(vs)]
    df = spark.createDataFrame(rows, "eid int, vid int, x string, y string")
    rules = tm.RuleBook(pairs)
    for metric in ("cvq", "hsq"):
        got = {r["eid"]: (r[f"x_{metric}"], r[f"y_{metric}"]) for r in getattr(tm, metric)(df, ["eid"], ["x", "y"], rules).collect()}
        want = {
            e: tuple(getattr(model, metric)([v[k] for v in vs], pairs[a]) for k, a in enumerate("xy"))
            for e, vs in data.items()
        }
        assert got == want
    got = {tuple(r) for r in tm.latest_values(df, ["eid"], ["x", "y"], rules).collect()}
    want = {
        (e, a, v, n)
        for e, vs in data.items()
        for k, a in enumerate("xy")
        for v, n in model.latest([v[k] for v in vs], pairs[a]).items()
    }
    assert got == want
    got = [tuple(r) for r in tm.present_edges(df, ["eid"], ["x", "y"], rules).collect()]
    want = {
        (e, a, s, d)
        for e, vs in data.items()
        for k, a in enumerate("xy")
        for s, d in model.bridged([v[k] for v in vs], pairs[a])
    }
    assert set(got) == want and len(got) == len(want)


def test_rules_too_large_for_the_driver(spark, monkeypatch):
    pairs, data = random_case(5, 8)
    rows = [(e, i, x) for e, vs in data.items() for i, (x, _) in enumerate(vs)]
    df = spark.createDataFrame(rows, "eid int, vid int, x string")
    frame = tm.RuleBook(pairs).frame(spark)
    monkeypatch.setattr(rule_graph, "MAX_DRIVER_EDGES", 0)
    for metric in ("cvq", "hsq"):
        got = {r["eid"]: r[f"x_{metric}"] for r in getattr(tm, metric)(df, ["eid"], ["x"], frame).collect()}
        assert got == {e: getattr(model, metric)([v[0] for v in vs], pairs["x"]) for e, vs in data.items()}
    got = {tuple(r) for r in tm.present_edges(df, ["eid"], ["x"], frame).collect()}
    assert got == {(e, "x", s, d) for e, vs in data.items() for s, d in model.bridged([v[0] for v in vs], pairs["x"])}


def test_attribute_names_and_values_with_quotes(spark):
    df = spark.createDataFrame([(1, "it's"), (1, "back\\slash")], "eid int, `odd name` string")
    rules = tm.RuleBook({"odd name": [("it's", "back\\slash")]})
    assert tm.cvq(df, ["eid"], ["odd name"], rules).first()["odd name_cvq"] == 1.0
    edges = tm.present_edges(df, ["eid"], ["odd name"], rules).collect()
    assert [tuple(r) for r in edges] == [(1, "odd name", "it's", "back\\slash")]


def test_keys_named_like_working_columns(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 2, "${b}")], "slot int, odd int, n string")
    rules = tm.RuleBook({"n": [("a", "${b}")]})
    assert [tuple(r) for r in tm.cvq(df, ["slot", "odd"], ["n"], rules).collect()] == [(1, 2, 1.0)]
    assert [tuple(r) for r in tm.hsq(df, ["slot", "odd"], ["n"], rules).collect()] == [(1, 2, 1.0)]
    latest = tm.latest_values(df.withColumnsRenamed({"slot": "a", "odd": "b"}), ["a", "b"], ["n"], rules)
    assert [tuple(r) for r in latest.collect()] == [(1, 2, "n", "${b}", 1)]


def test_counts_and_versions(spark):
    df = spark.createDataFrame([(1, 7, "a"), (1, 5, "a"), (1, 5, "b"), (2, 5, "a"), (2, 6, None)], "eid int, vid int, x string")
    counts = {tuple(r) for r in tm.value_counts(df, ["eid"], ["x"], "vid").collect()}
    assert counts == {(1, "x", "a", 2, 5), (1, "x", "b", 1, 5), (2, "x", "a", 1, 5)}
    versions = {tuple(r) for r in tm.value_versions(df, ["eid"], ["x"], "vid").collect()}
    assert versions == {(1, "x", "a", 5), (1, "x", "a", 7), (1, "x", "b", 5), (2, "x", "a", 5)}


def test_combining_and_filtering(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (12, 0.25, 0.25), (19, None, 1.0)], "eid int, a double, b double")
    got = [r[0] for r in df.orderBy("eid").select(tm.combine_scores("a", F.col("b"))).collect()]
    assert got == [0.75, 0.25, None]
    assert tm.average_score(df, ["a", "b"]).first()["avg"] == 0.5
    assert [r["eid"] for r in tm.entity_filter(df, "eid", equals=12).collect()] == [12]
    assert sorted(r["eid"] for r in tm.entity_filter(df, "eid", like="1_").collect()) == [12, 19]


def test_large_entity_is_reduced_before_the_exchange(spark):
    """Half of all rows belong to one entity; plans count before they shuffle."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("eid"),
        F.concat(F.lit("v"), F.col("id") % 8).alias("x"),
    )
    pairs = model.random_pairs(random.Random(1), 8)
    for metric in ("cvq", "hsq"):
        scored = getattr(tm, metric)(df, ["eid"], ["x"], tm.RuleBook({"x": pairs}))
        plan = scored._jdf.queryExecution().executedPlan().toString()
        first = plan.rindex("Exchange hashpartitioning")
        assert "partial_" in plan[first:]
        assert "BroadcastHashJoin" in plan[first:]
        got = {r["eid"]: r[f"x_{metric}"] for r in scored.collect()}
        assert got[0] == getattr(model, metric)([f"v{i % 8}" for i in range(0, 20_000, 2)], pairs)
