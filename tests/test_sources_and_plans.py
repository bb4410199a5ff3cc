import model
import pytest

import tidemark as tm
from tidemark.plans import (
    cohort_average,
    entity_score,
    repair_coded_file,
    repair_text_file,
    table_average,
)
from tidemark.plans.student import CODED_SCHEMA, coded_rules, label_rules

# Our own rows: entity, version, name, age, city, grade, status.
CODED = [
    (1, "v1", 1, 20, 1, 1, 1), (1, "v2", 1, 21, 1, 3, 2), (1, "v3", 1, 22, 2, 4, 2), (1, "v4", 1, 23, 2, 6, 3),
    (1, "v5", 1, 24, 2, 6, 6), (11, "v1", 2, 30, 1, 7, 8), (11, "v2", 2, 31, 1, 8, 9), (11, "v3", 2, 32, 1, 9, 1),
    (12, "v1", 3, 40, 1, 10, 10), (12, "v2", 3, 41, 1, 5, 5), (2, "v1", 4, 50, 1, 99, 1),
]
HEADER = "eId,vId,name,age,city,grade,status\n"


@pytest.fixture
def coded_csv(tmp_path):
    path = tmp_path / "student.csv"
    path.write_text(HEADER + "".join(",".join(map(str, r)) + "\n" for r in CODED))
    return str(path)


def scores(metric, rows, attribute):
    pairs = coded_rules().states[attribute]
    column = 5 if attribute == "grade" else 6
    return getattr(model, metric)([str(r[column]) for r in rows], pairs)


@pytest.mark.parametrize("metric", ["cvq", "hsq"])
def test_named_scores(spark, coded_csv, metric):
    df = tm.load_table(spark, coded_csv, CODED_SCHEMA)
    rules = coded_rules()
    one = [r for r in CODED if r[0] == 1]
    assert entity_score(metric, df, "eId", 1, ["grade"], rules).first()[0] == scores(metric, one, "grade")
    both = (scores(metric, one, "grade") + scores(metric, one, "status")) / 2
    assert entity_score(metric, df, "eId", 1, ["grade", "status"], rules).first()[0] == both

    def mean(entities):
        parts = []
        for e in entities:
            rows = [r for r in CODED if r[0] == e]
            parts.append((scores(metric, rows, "grade") + scores(metric, rows, "status")) / 2)
        return sum(parts) / len(parts)

    cohort = cohort_average(metric, df, "eId", "1_", ["grade", "status"], rules).first()["avg"]
    assert cohort == pytest.approx(mean([11, 12]), abs=1e-12)
    table = table_average(metric, df, "eId", ["grade", "status"], rules).first()["avg"]
    assert table == pytest.approx(mean([1, 11, 12, 2]), abs=1e-12)


def test_views_and_preview(spark, coded_csv):
    df = tm.register(tm.load_table(spark, coded_csv, CODED_SCHEMA), "student")
    tm.register(tm.cvq(df, ["eId"], ["grade", "status"], coded_rules()), "student_cvq")
    out = spark.sql("SELECT avg((grade_cvq + status_cvq) / 2) AS avg FROM student_cvq WHERE eId LIKE '1_'")
    assert out.first()["avg"] == cohort_average("cvq", df, "eId", "1_", ["grade", "status"], coded_rules()).first()["avg"]
    assert tm.preview(df).count() == 1


def test_bad_codes_fail_loudly(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + "1,v1,1,20,1,Master,Single\n")
    with pytest.raises(Exception):
        tm.load_table(spark, str(path), CODED_SCHEMA).collect()
    assert tm.load_table(spark, str(path)).first()["grade"] == "Master"


@pytest.mark.parametrize("even", [True, False])
def test_csv_round_trip(spark, coded_csv, tmp_path, even):
    df = tm.load_table(spark, coded_csv, CODED_SCHEMA)
    target = str(tmp_path / "out")
    for _ in range(2):  # the second write replaces the first
        tm.save_table(df, target, files=2, even=even)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) <= 2
    assert tm.load_table(spark, target, CODED_SCHEMA).exceptAll(df).isEmpty()
    assert tm.load_table(spark, target).count() == len(CODED)


def test_repair_jobs(spark, coded_csv, tmp_path):
    rules = coded_rules()
    by_entity = {}
    for r in CODED:
        by_entity.setdefault(r[0], []).append((r[1], str(r[5]), str(r[6])))
    for compress, name in ((False, "text"), (True, "coded")):
        target = str(tmp_path / name)
        if compress:
            repair_coded_file(spark, coded_csv, target, CODED_SCHEMA, "grade", "status", rules, files=1)
        else:
            repair_text_file(spark, coded_csv, target, "grade", "status", rules, files=1)
        got = {(int(r["eId"]), r["vId"]): r["status"] for r in tm.load_table(spark, target).collect()}
        want = {
            (e, vid): value
            for e, rows in by_entity.items()
            for vid, value in model.repair(rows, rules.states["grade"], rules.states["status"], compress).items()
        }
        assert got == want


def test_isolated_wrong_labels_are_repaired(spark):
    """Each grade held many times with its usual status, and one slip per entity."""
    usual = {"HighSchool": "Single", "Bachelor": "Married", "Master": "Divorced", "PHD": "Remarried"}
    rows = [("e", n * 10 + k, g, s) for n, (g, s) in enumerate(usual.items()) for k in range(5)]
    slip = [r if r[1] != 12 else ("e", 12, "Bachelor", "Remarried") for r in rows]
    df = spark.createDataFrame(slip, "eId string, vId int, grade string, status string")
    fixed = tm.repair(df, ["eId"], "vId", "grade", "status", label_rules())
    changed = fixed.exceptAll(df).collect()
    assert [(r["vId"], r["status"]) for r in changed] == [(12, "Divorced")]
    assert tm.detect_errors(df, ["eId"], "vId", "grade", "status", label_rules()).count() == 1
    assert tm.detect_errors(fixed, ["eId"], "vId", "grade", "status", label_rules()).isEmpty()


def test_files_of_a_size_and_a_table_over_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(5000).selectExpr("id", "repeat('x', cast(id % 50 as int)) AS text", "cast(null as string) AS nothing")
    tm.save_table(df, path, file_bytes=40_000)
    sizes = [f.stat().st_size for f in (tmp_path / "table").glob("*.csv")]
    assert len(sizes) > 2 and all(20_000 < s < 80_000 for s in sizes)
    again = tm.load_table(spark, path, df.schema)
    tm.save_table(again.filter("id >= 100"), path, files=2)
    assert tm.load_table(spark, path, df.schema).count() == 4900
    assert [f.name for f in tmp_path.iterdir()] == ["table"]  # nothing staged is left
    with pytest.raises(Exception, match="line break"):
        tm.save_table(spark.createDataFrame([("a\nb",)], "t string"), path)
    assert tm.load_table(spark, path, df.schema).count() == 4900  # the old table stays
    with pytest.raises(ValueError, match="not both"):
        tm.save_table(df, path, files=2, file_bytes=10)


def test_join_back_of_a_bucketed_table_shuffles_nothing_wide(spark, tmp_path):
    rows = [(k % 7, k, "r1" if k % 3 else "r2", "ab"[k % 2], "wide" * 10) for k in range(200)]
    df = spark.createDataFrame(rows, "e int, v int, ref string, x string, rest string")
    rules = tm.RuleBook({"ref": [("r1", "r2")], "x": [("a", "b")]})
    base = tm.save_bucketed(df, "bucketed_rows", ["e", "v"], 4, str(tmp_path / "bucketed"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tm.join_back(base, tm.repaired_cells(base, ["e"], "v", "ref", "x", rules), ["e"], "v", "x")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        want = tm.repair(df, ["e"], "v", "ref", "x", rules)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_rows")
