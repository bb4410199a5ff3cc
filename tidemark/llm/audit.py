"""What each filter of a chain removes, under every order in which the filters can be applied.

A document's failing filters decide, for every order at once, which filter removes it: the first
failing one. So each document is reduced to the letters of the filters it fails, and these
combinations are counted; the orders are applied to the counts.

Four filters look at one text. The fifth, E, at the table: a left-semi join on hash, exact text and
smaller id marks every document whose text a smaller id also has. The right side of the join is one
row for each text that several ids have, so that copies are never paired; documents of a text that
very many have are dealt over salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import saved
from tidemark.llm.textbytes import bytes_of
from tidemark.operators.skew import join_runs

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# Fixed values of the filters
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"

#: documents of one text that go to one task, at least; never under 1/HOT of all documents
SPREAD, HOT = 1_000, 1_000
#: repeated hashes up to this number are broadcast (24 bytes each)
BROADCAST_ROWS = 1_000_000
#: a text is split into words so many bytes at a time
PIECE = 1 << 20

_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))


def failed_filters(text: bytes) -> str:
    """The letters of the filters A to D that the text fails."""
    words, distinct, at = 0, set(), 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\f\r":
            end += 1
        piece = text[at:end].split()
        words += len(piece)
        distinct.update(piece)
        at = end
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    failed = "A" if words < LEAST_WORDS else ""
    failed += "B" if 100 * len(distinct) < LEAST_DISTINCT_PERCENT * words else ""
    failed += "C" if 100 * capitals > MOST_CAPITALS_PERCENT * points else ""
    return failed + ("D" if len(text.translate(None, SYMBOLS)) < len(text) else "")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        data, offsets = bytes_of(batch.column(names.index("_text")))
        cuts = offsets.tolist()
        failed = [failed_filters(data[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.record_batch(
            [*(batch.column(names.index(c)) for c in ("_id", "_part", "_h1", "_h2")), pa.array(failed, pa.string())],
            ["_id", "_part", "_h1", "_h2", "_failed"],
        )


def repeated_texts(rows: DataFrame, judged: DataFrame, spread: int | None = None) -> DataFrame:
    """The rows (_id, _h1, _h2) among ``rows`` (with _text) that have the text of a smaller id.

    ``judged`` has the ids and hashes of the same rows. Only texts whose hash several ids have are
    shuffled, the smallest id of each beforehand.
    """
    hashes = judged.groupBy("_h1", "_h2").agg(
        F.count("*").alias("_n"), F.min("_id").alias("_least"), F.max("_id").alias("_most")
    )
    hashes = saved(hashes.filter("_least < _most").select("_h1", "_h2", "_n"))
    size = hashes.agg(F.count("*").alias("rows"), F.max("_n").alias("largest")).first()
    share = max(spread or SPREAD, judged.count() // HOT)
    salted = hashes.select("_h1", "_h2", F.ceil(F.col("_n") / share).cast("long").alias("_salts"))
    # fewer than HOT texts have more than 1/HOT of all rows
    hot = salted.filter("_salts > 1") if (size["largest"] or 0) > share else None
    if size["rows"] <= BROADCAST_ROWS:
        candidates = rows.join(F.broadcast(salted), ["_h1", "_h2"])
    else:
        candidates = join_runs(rows, salted, ["_h1", "_h2"], "_id", hot).filter("_salts is not null")
    candidates = candidates.select("_id", "_h1", "_h2", "_text", "_salts")
    first = (
        candidates.groupBy("_h1", "_h2", "_text")
        .agg(F.min("_id").alias("_least"), F.max("_salts").alias("_salts"))
        .select(
            *[F.col(c).alias(f"_f{c}") for c in ("_h1", "_h2", "_text", "_least")],
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("_f_salt"),
        )
    )
    dealt = candidates.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    same = " and ".join(f"{c} = _f{c}" for c in ("_h1", "_h2", "_salt", "_text"))
    return dealt.join(first, F.expr(f"{same} and _f_least < _id"), "left_semi").select("_id", "_h1", "_h2")


def failure_combinations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", spread: int | None = None
) -> DataFrame:
    """(_id, _part, _failed, _n): the number of rows of an id and part that fail just these filters.

    A null text is the empty one, a null part the empty string. A null id is smaller or larger than
    none. Repeated rows count each; they are no copies of one another, since neither id is smaller.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("_part"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit("second"), text).alias("_h2"),
        text.alias("_text"),
    )
    judged = saved(rows.mapInArrow(_judge, "_id long, _part string, _h1 long, _h2 long, _failed string"))
    copies = repeated_texts(rows.select("_id", "_h1", "_h2", "_text"), judged, spread).distinct()
    # ids failing E beside the others; only ids that have a row in several parts meet here again
    once = judged.groupBy("_id", "_h1", "_h2", "_part", "_failed").agg(F.count("*").alias("_n"))
    marks = once.select("_id", "_h1", "_h2", F.struct("_part", "_failed", "_n").alias("_row")).unionByName(
        copies.withColumn("_row", F.lit(None).cast("struct<_part:string,_failed:string,_n:long>"))
    )
    together = marks.groupBy("_id", "_h1", "_h2").agg(
        F.max(F.col("_row").isNull()).alias("_copy"), F.collect_list("_row").alias("_rows")
    )
    return (
        together.select("_id", "_copy", F.inline("_rows"))
        .select("_id", "_part", F.concat("_failed", F.when(F.col("_copy"), "E").otherwise("")).alias("_failed"), "_n")
        .groupBy("_id", "_part", "_failed")
        .agg(F.sum("_n").alias("_n"))
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    spread: int | None = None,
) -> DataFrame:
    """One row for each part, filter_order (120) and step (1 to 5): kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    kept: documents that fail none of the filters up to this step; removed: those that fail this
    one first; redundant: those that fail it, too; unique_fails: those that fail it alone, in
    any order; good_lost and toxic_lost: removed ones that ``labels`` (doc_id, quality, toxic) call
    quality = 1 and toxic = 1, where an id has several labels by any of them; shapley: removed by this
    step's filter, summed over all orders. An empty table has no parts and so no rows.
    For nulls and repeated rows see :func:`failure_combinations`.
    """
    counts = failure_combinations(docs, id_col, text_col, part_col, spread)
    known = labels.groupBy(labels["doc_id"].cast("long").alias("_label_id")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("_toxic"),
    )
    combinations = (
        counts.join(known, F.col("_id") == F.col("_label_id"), "left")
        .groupBy(
            "_part", "_failed",
            F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic"),
        )
        .agg(F.sum("_n").alias("_n"))
    )
    steps = (
        combinations.withColumn("filter_order", F.explode(F.lit(ORDERS)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("_filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("_fails", F.expr("instr(_failed, _filter) > 0"))
        .withColumn("_gone", F.expr("translate(_failed, substring(filter_order, 1, step - 1), '') <> _failed"))
        .withColumn("_now", F.expr("_fails and not _gone"))
    )

    def counted(condition: str, name: str) -> F.Column:
        return F.sum(F.when(F.expr(condition), F.col("_n")).otherwise(0)).cast("long").alias(name)

    audited = steps.groupBy("_part", "filter_order", "step", "_filter").agg(
        counted("not _fails and not _gone", "kept"),
        counted("_now", "removed"),
        counted("_fails and _gone", "redundant"),
        counted("_failed = _filter", "unique_fails"),
        counted("_now and _good", "good_lost"),
        counted("_now and _toxic", "toxic_lost"),
    )
    over_orders = Window.partitionBy("_part", "_filter")
    return audited.select(
        F.col("_part").alias("part"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", F.sum("removed").over(over_orders).alias("shapley"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS w FROM docs
), first_id AS (
  SELECT t, min(doc_id) AS least FROM docs GROUP BY t
), failed AS (
  SELECT words.doc_id, part,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN first_id.least < words.doc_id THEN 'E' ELSE '' END AS f
  FROM words JOIN first_id ON words.t = first_id.t
), counts AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n
  FROM failed LEFT JOIN (
    SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad
    FROM labels GROUP BY doc_id
  ) AS known ON failed.doc_id = known.doc_id
  GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT counts.*, o, s, substr(o, s, 1) AS l, contains(f, substr(o, s, 1)) AS fails,
    s > 1 AND translate(f, substr(o, 1, s - 1), '') <> f AS gone
  FROM counts, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), audited AS (
  SELECT part, o, s, l,
    sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails AND NOT gone AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, o, s, l
)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM audited
"""
