"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

The weight of a source is its token share to the power of an exponent, normalised: 1 keeps
the shares, 0 makes all sources equal. The exponent is found by bisection: the largest one
whose weights reach a target entropy, or the smallest one under which no source is repeated
more than a limit. Each step of the bisection is one aggregate over the source table that
tries PROBES exponents at once, so sources are never collected.

A source's budget is its weight times the token budget. It is filled pass by pass: in every
pass its documents stand in a pseudo-random order of blocks (a hash of seed and document,
scrambled anew for each pass), and the last, partial pass takes documents in that order
until the budget is met.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import WHITE
from tidemark.llm.scratch import NULL_ID, given_id, saved

PROBES, STEPS = 32, 4
#: 2 ** BITS blocks per source and level of the budget search
BITS, LEVELS = 12, 3


def source_shares(docs: DataFrame) -> DataFrame:
    """(_source, _tokens, _log_share) of rows (_source, _tokens), sources without tokens left out."""
    sums = docs.groupBy("_source").agg(F.sum("_tokens").alias("_tokens")).filter("_tokens > 0")
    total = sums.agg(F.sum("_tokens")).first()[0]
    return sums.select("_source", "_tokens", F.log(F.col("_tokens") / F.lit(total)).alias("_log_share"))


def _measures(shares: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, largest number of passes) of the weights under each exponent."""
    columns = []
    for k, x in enumerate(exponents):
        power = F.exp(x * F.col("_log_share"))
        columns += [
            F.sum(power).alias(f"z{k}"),
            F.sum(power * x * F.col("_log_share")).alias(f"s{k}"),
            F.max(power / F.col("_tokens")).alias(f"m{k}"),
        ]
    row = shares.agg(*columns).first()
    out = []
    for k in range(len(exponents)):
        z = row[f"z{k}"]
        out.append((math.log(z) - row[f"s{k}"] / z, budget * row[f"m{k}"] / z))
    return out


def bisect_exponent(
    shares: DataFrame, budget: float, target_entropy: float | None = None, max_passes: float | None = None
) -> float:
    """The exponent in [0, 1]. With ``target_entropy`` (nats, as a share of ln of the number of
    sources): the largest that reaches it, 0 if none does. With ``max_passes``: not below the
    smallest under which no source is passed over more often, 1 if there is none. Both: the
    limit on passes goes first."""
    n = shares.count()
    if n < 2:
        return 1.0

    def search(good) -> float:
        """Where ``good`` turns from true (at 0) to false."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            grid = [low + (high - low) * k / PROBES for k in range(PROBES + 1)]
            fine = [good(m) for m in _measures(shares, grid, budget)]
            if fine[-1]:
                return high
            last = max((k for k in range(PROBES + 1) if all(fine[: k + 1])), default=None)
            if last is None:
                return low
            low, high = grid[last], grid[last + 1]
        return low

    exponent = 1.0
    if target_entropy is not None:
        exponent = search(lambda m: m[0] >= target_entropy * math.log(n) - 1e-12)
    if max_passes is not None:
        most = search(lambda m: m[1] > max_passes)
        if _measures(shares, [exponent], budget)[0][1] > max_passes:
            exponent = min(1.0, most + 1.0 / PROBES**STEPS)
    return exponent


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    target_entropy: float | None = 0.95, max_passes: float | None = 4.0,
    budget: int | None = None, seed: int = 7, keep_columns: bool = False,
) -> DataFrame:
    """The mixture: one row for each use of a document.

    doc_id, source, n_tokens (words), weight of the source, pass (from 0), position (a
    number that orders the rows of a pass; passes follow one another). ``budget`` is
    in tokens, by default those of the input. A source's rows have at least its budget of
    tokens and exceed it by less than its last document (documents with an equal position
    hash are taken together).
    ``keep_columns`` appends these but doc_id and source to all columns of ``docs`` instead; they take the
    place of columns of ``docs`` that have one of their names.

    A document without words has no tokens and is never used. A null source is a source of its
    own. Null ids stay null; repeated rows are used each like the first. An empty table gives an
    empty result.
    """
    trimmed = F.btrim(docs[text_col].cast("string"), F.lit(" \t\n\x0b\f\r"))
    tokens = F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, WHITE))).otherwise(0).cast("long")
    key = [
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_th"),
        docs[source_col].cast("string").alias("_source"),
    ]
    units = saved(docs.select(*key, tokens.alias("_tokens")).filter("_tokens > 0"))
    shares = saved(source_shares(units))
    if budget is None:
        budget = shares.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    exponent = bisect_exponent(shares, float(budget), target_entropy, max_passes)
    power = F.exp(exponent * F.col("_log_share"))
    norm = shares.agg(F.sum(power)).first()[0]
    plan = shares.select("_source", "_tokens", (power / F.lit(norm)).alias("weight"))
    plan = plan.withColumn("_due", budget * F.col("weight"))
    plan = plan.withColumn("_full", F.floor(F.col("_due") / F.col("_tokens") + 1e-9))
    plan = saved(
        plan.select(
            F.col("_source").alias("_of"),
            "weight",
            "_full",
            F.least(F.col("_due") - F.col("_full") * F.col("_tokens"), F.col("_tokens")).alias("_rest"),
        )
    )
    own = units.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_hash", F.xxhash64(F.lit(seed), "_id", "_th", "_full")
    )
    # the last pass: the largest hash its budget reaches, found block by block
    cut = plan.select("_of", "_rest", F.lit(0).cast("long").alias("_prefix")).filter("_rest > 0")
    for level in range(LEVELS):
        shift = 64 - BITS * (level + 1)
        above = F.shiftrightunsigned("_hash", shift + BITS) if level else F.lit(0).cast("long")
        block = F.shiftrightunsigned("_hash", shift).alias("_block")
        inside = own.select("_source", "_tokens", above.alias("_above"), block)
        here = F.col("_source").eqNullSafe(F.col("_o")) & (F.col("_above") == F.col("_prefix"))
        blocks = (
            inside.join(cut.select(F.col("_of").alias("_o"), "_prefix"), here)
            .groupBy("_source", "_block")
            .agg(F.sum("_tokens").alias("_sum"))
        )
        # at most 2 ** BITS blocks per source
        order = F.expr("sum(_sum) over (partition by _source order by _block)")
        cut = (
            blocks.withColumn("_upto", order)
            .join(cut, F.col("_source").eqNullSafe(F.col("_of")))
            .filter("_upto >= _rest")
            .groupBy("_of")
            .agg(F.min(F.struct("_block", "_upto", "_sum", "_rest")).alias("_b"))
            .select(
                "_of",
                (F.col("_b._rest") - (F.col("_b._upto") - F.col("_b._sum"))).alias("_rest"),
                F.col("_b._block").alias("_prefix"),
            )
        )
        cut = saved(cut)
    # what the remaining block (one document in 2 ** 36) holds is taken in the order of the hash
    shift = 64 - BITS * LEVELS
    edge = own.join(
        cut.withColumnRenamed("_of", "_o").withColumnRenamed("_rest", "_left"),
        F.col("_source").eqNullSafe(F.col("_o")) & (F.shiftrightunsigned("_hash", shift) == F.col("_prefix")),
    )
    ends = (
        edge.withColumn("_upto", F.expr("sum(_tokens) over (partition by _source order by _hash)"))
        .filter("_upto >= _left")
        .groupBy("_source")
        .agg(F.min(F.struct(F.shiftrightunsigned("_hash", 1).alias("h"), F.col("_hash"))).alias("_e"))
        .select(F.col("_source").alias("_o"), F.col("_e._hash").alias("_last"))
    )
    ranked = own.join(ends, F.col("_source").eqNullSafe(F.col("_o")), "left")
    # hashes compare as unsigned numbers: flip the sign bit
    sign = F.lit(-(2**63)).cast("long")
    partial = F.col("_last").isNotNull() & (
        F.col("_hash").bitwiseXOR(sign) <= F.col("_last").bitwiseXOR(sign)
    )
    uses = ranked.withColumn("_uses", F.col("_full") + partial.cast("long")).filter("_uses > 0")
    rows = uses.select(
        "*", F.explode(F.expr("sequence(0L, _uses - 1)")).alias("pass")
    ).select(
        "_id", "_th", "_source",
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "pass",
        F.when(F.col("pass") == F.col("_full"), F.col("_hash")).otherwise(F.xxhash64("_hash", "pass")).alias("position"),
    )
    if not keep_columns:
        return rows.select(
            given_id().alias("doc_id"), F.col("_source").alias("source"), "n_tokens", "weight", "pass", "position"
        )
    whole = docs.select(F.struct(*docs.columns).alias("_row"), *key).alias("w")
    r = rows.distinct().hint("merge").alias("r")
    same = (F.col("w._id") == F.col("r._id")) & (F.col("w._th") == F.col("r._th"))
    same &= F.col("w._source").eqNullSafe(F.col("r._source"))
    extra = ["n_tokens", "weight", "pass", "position"]
    own = [F.col("w._row")[c].alias(c) for c in docs.columns if c.lower() not in extra]
    return whole.join(r, same).select(*own, *(F.col(f"r.{c}") for c in extra))
