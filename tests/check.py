"""Compare every query with its SQL counterpart: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def oracle(folder, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    return canonical([c[0] for c in result.description], result.fetchall())


def spark_result(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        t0 = time.time()
        try:
            got = spark_result(queries()[name](spark, folder))
        except Exception as e:
            print(f"{name:22s} SPARK ERROR {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        try:
            want = oracle(folder, oracle_sql()[name])
        except Exception as e:
            print(f"{name:22s} SQL ERROR {str(e)[:600]}", flush=True)
            continue
        ok = got == want
        print(f"{name:22s} {'ok' if ok else 'DIFF'} rows={len(got[1])}/{len(want[1])} spark={t1 - t0:.2f}s sql={time.time() - t1:.2f}s", flush=True)
        if not ok:
            print("   ", got[0], want[0])
            bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:3]
            print("   ", bad)
