"""Awkward documents and plain-Python helpers for the operator tests."""

from __future__ import annotations

import random
import re

WORDS = "alpha beta gamma delta the of and to in is on kappa lambda omicron sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _th int, _row int, kept string"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rnd: random.Random, n: int) -> str:
    out = [rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing", str(rnd.randrange(50))]) for _ in range(n)]
    lines = [" ".join(out[k : k + 12]) for k in range(0, n, 12)]
    return "\n".join(lines)


def awkward(seed: int = 1) -> list[tuple]:
    """Rows with nulls in every column, empty and long texts, exact and near copies, shared
    passages, repeated rows, repeated lines and clashing column names."""
    rnd = random.Random(seed)
    base = prose(rnd, 150)
    passage = prose(rnd, 60)
    near = base.split(" ")
    near[20] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "two words", "Ünï çødé 文字 \U0001f600 " * 12]
    texts += [prose(rnd, 60) + "\n" + passage + "\n" + prose(rnd, 30) for _ in range(3)]
    texts += ["ha " * 200, "x" * 3_000, prose(rnd, 40), passage, base.upper(), prose(rnd, 2_500), "a\n\n\nb\r\nc"]
    texts += [prose(rnd, rnd.randint(1, 90)) for _ in range(12)]
    rows = [
        (k + 3, t, rnd.choice(["en", None]), rnd.choice(["s0", "s0", "s1", None]), len(t or ""), "x", k, k, "no")
        for k, t in enumerate(texts)
    ]
    rows.append(rows[2])  # a repeated row
    rows.append((None, base, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    rows.append((4_000_000_000_000, passage + " tail", None, "s2", None, None, None, None, None))
    rows.append((-5, prose(rnd, 50), "en", "s1", 1, None, None, None, None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def order(doc_id) -> int:
    return -(2**63) if doc_id is None else doc_id


def bag(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)
