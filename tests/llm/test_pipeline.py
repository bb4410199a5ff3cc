"""Registered queries and the pipeline."""

import os
import subprocess
import sys

import pytest
from cases import awkward, bag, frame
from check import oracle, spark_result

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.scratch import saved

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, name):
    assert spark_result(queries()[name](spark, FOLDER)) == oracle(FOLDER, ORACLES[name])


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "temperature_mixing",
    ]


def test_stages_on_awkward_documents(spark, tmp_path):
    items = [(1, awkward()[14][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame(spark)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, docs, str(tmp_path)))
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert bag(last.select("doc_id").collect()) == bag(whole.select("doc_id").collect())


def test_near_copies_at_four_fifths_go(spark, tmp_path):
    words = [f"w{k}" for k in range(104)]
    other = [*words[:50], "x", *words[51:80], "y", *words[81:]]  # 90 of 110 shingles in common: 0.818
    rows = [(k, " ".join(w), *[None] * 7) for k, w in enumerate((words, other))]
    out = corpus_pipeline.minhash_near_dedup(spark, frame(spark, rows), str(tmp_path))
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0


def test_tasks_need_no_installed_library(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from tidemark.session import local_session
from tidemark.llm import decontam, near, pieces
spark = local_session(2)
df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
n = near.near_duplicates(df).filter("kept").count()
print("GOT", n, decontam.contaminated_pairs(df, bench).count(), pieces.token_counts(df, "/opt/tokenizers/piece_bpe_32k.model").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT 1 2 2" in done.stdout, done.stderr[-2000:]
