"""Quality rules as weak supervision, in DataFrame functions only.

Ten rules look at a text and vote good, vote bad or abstain. Expectation-maximisation over
the counts of vote patterns (at most 3 ** 10 of them, whatever the number of documents)
estimates the share of good documents and, for each rule, how often it votes right on good
and on bad ones. A document stays if its posterior probability of being good is at least
KEEP, instead of having to pass every rule; base_failed alone rejects at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import NULL_ID, given_id, saved
from tidemark.session import small_frame

WHITE = "[ \\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
KEEP = 0.5
ROUNDS = 60
#: name, ratio, bad below, good from, good to, bad above; None: no such side
RULES = (
    ("length", "n_words", 20, 50, None, None),
    ("word_length", "word_chars / n_words", 2.0, 3.0, 10.0, 14.0),
    ("symbols", "n_symbols / n_words", None, None, 0.05, 0.3),
    ("symbol_share", "n_symbols / word_chars", None, None, 0.01, 0.08),
    ("letters", "n_letters / word_chars", 0.8, 0.9, None, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, None, 0.1, 0.3),
    ("repeated_words", "n_repeat_words / n_words", None, None, 0.1, 0.3),
    ("capitals", "n_capitals / word_chars", None, None, 0.15, 0.4),
    ("exclamations", "n_marks / n_words", None, None, 0.1, 0.5),
    ("variety", "n_distinct / n_words", 0.1, 0.2, None, None),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE)).otherwise(F.array().cast("array<string>"))


def _without(text: Column, characters: str) -> Column:
    """Characters of the text that are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, counts): one row for each row of ``docs``; a null text counts as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_th"),
        text.alias("_t"),
        F.transform(_words(text), lambda w: F.xxhash64(w)).alias("_h1"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0).alias("_lines"),
    )
    # names of 2, 4 and 8 words from the names of halves; each is computed once per word
    size = 1
    for _ in range(3):
        rows = rows.withColumn(
            f"_h{2 * size}",
            F.expr(
                f"transform(slice(_h{size}, 1, greatest(size(_h{size}) - {size}, 0)), "
                f"(x, i) -> xxhash64(x, _h{size}[i + {size}]))"
            ),
        )
        size *= 2
    rows = rows.withColumn("_again", F.size(F.array_distinct("_h8")) < F.size("_h8"))
    # (name, place) in order: equal neighbours are windows found twice or more
    rows = rows.withColumn(
        "_order", F.expr("case when _again then array_sort(transform(_h8, (x, i) -> struct(x as h, i as i))) end")
    )
    rows = rows.withColumn(
        "_places",
        F.expr(
            "sort_array(filter(transform(_order, (s, k) -> case when s.h = get(_order, k - 1).h "
            "or s.h = get(_order, k + 1).h then s.i end), x -> x is not null))"
        ),
    )
    covered = F.expr(
        f"aggregate(_places, struct(0L as till, 0L as n), (a, i) -> struct(i + {WINDOW}L as till, "
        f"a.n + i + {WINDOW}L - greatest(a.till, i + 0L) as n), a -> a.n)"
    )
    symbols = "#*$%&|<>"
    return rows.select(
        "_id",
        "_th",
        F.size("_h1").cast("long").alias("n_words"),
        (F.length("_t") - _without(F.col("_t"), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        _without(F.col("_t"), symbols).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        _without(F.col("_t"), "!?").cast("long").alias("n_marks"),
        F.size(F.array_distinct("_h1")).cast("long").alias("n_distinct"),
    )


def _vote(rule: tuple) -> Column:
    """1 good, 2 bad, 0 abstain; without a ratio (no words) abstain."""
    _, ratio, bad_below, good_from, good_to, bad_above = rule
    part = ratio.split(" / ")
    x = F.col(part[0]) if len(part) == 1 else F.col(part[0]) / F.nullif(F.col(part[1]), F.lit(0).cast("long"))
    bad, good = F.lit(False), F.lit(True)
    if bad_below is not None:
        bad, good = bad | (x < bad_below), good & (x >= good_from)
    if bad_above is not None:
        bad, good = bad | (x > bad_above), good & (x <= good_to)
    return F.when(x.isNull(), 0).when(bad, 2).when(good, 1).otherwise(0)


def estimate(counts: dict[int, int]) -> tuple[dict[int, float], float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns (base-3 codes) with their counts.

    Returns the posterior of each pattern, the share of good documents, and for each rule how
    often it is right on good and on bad documents. Starts from passing every rule: most kinds
    of bad text trip one rule only, and the rounds find out which rules misfire on good text.
    """
    n = len(RULES)
    votes = {code: [code // 3**k % 3 for k in range(n)] for code in counts}
    posterior = {code: 0.1 if 2 in v else 0.95 for code, v in votes.items()}
    prior, right = 0.5, [(0.8, 0.8)] * n
    for _ in range(ROUNDS):
        total = sum(counts.values())
        prior = (sum(counts[c] * posterior[c] for c in counts) + 1) / (total + 2)
        right = []
        for k in range(n):
            mass = {(v, good): 0.0 for v in (1, 2) for good in (True, False)}
            for c, v in votes.items():
                if v[k]:
                    mass[v[k], True] += counts[c] * posterior[c]
                    mass[v[k], False] += counts[c] * (1 - posterior[c])
            right.append(
                (
                    (mass[1, True] + 8) / (mass[1, True] + mass[2, True] + 10),
                    (mass[2, False] + 2) / (mass[1, False] + mass[2, False] + 4),
                )
            )
        for c, v in votes.items():
            odds = math.log(prior / (1 - prior))
            for k in range(n):
                on_good, on_bad = right[k]
                if v[k] == 1:
                    odds += math.log(on_good / (1 - on_bad))
                elif v[k] == 2:
                    odds += math.log((1 - on_good) / on_bad)
            posterior[c] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return posterior, prior, right


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    features = saved(text_features(docs, id_col, text_col))
    code = sum((_vote(rule) * 3**k for k, rule in enumerate(RULES)), F.lit(0))
    features = features.withColumn("_votes", code.cast("int"))
    # at most 3 ** 10 patterns
    counts = {r["_votes"]: r["count"] for r in features.groupBy("_votes").count().collect()}
    posterior, _, _ = estimate(counts)
    table = small_frame(
        docs.sparkSession, sorted(posterior.items()) or [(0, 0.0)], "_votes int, posterior double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return features.join(F.broadcast(table), "_votes").select(
        "*", failed.alias("base_failed"), (~failed & (F.col("posterior") >= KEEP)).alias("kept")
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, posterior and kept.

    A null or empty text has no words and fails; a null id stays null; repeated rows get equal
    verdicts; other columns are not read; an empty table gives an empty result. Lines are
    those with a word; a window of eight words counts as repeated within one text only.
    """
    return _verdicts(docs, id_col, text_col).select(
        given_id().alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "posterior",
    )


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that quality_verdicts rejects; all columns as they are."""
    kept = _verdicts(docs, id_col, text_col).filter("kept").select("_id", "_th").distinct()
    own = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_th"),
    )
    return own.join(kept.hint("merge"), ["_id", "_th"], "left_semi").select("_row.*")
