"""Comparing the members of index buckets without emitting their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import saved

#: a block holds about so many members and so much weight; a larger group makes more blocks
BLOCK_ROWS, BLOCK_WEIGHT = 1_024, 1_000_000
SALTS = 64


def bucket_members(entries: DataFrame) -> DataFrame:
    """Distinct (_leader, _x, _n): for each bucket of ``entries`` (_key, _x, _n) with two or more
    members, its members beside its smallest one, which leads it."""
    leaders = entries.groupBy("_key").agg(F.min("_x").alias("_leader"), F.max("_x").alias("_last"))
    return saved(
        entries.join(leaders.filter("_leader < _last").drop("_last"), "_key")
        .select("_leader", "_x", "_n")
        .distinct()
    )


def met_in_blocks(members: DataFrame, payload: DataFrame) -> DataFrame:
    """The payload rows (_x, ...) of the members of each leader, behind (_leader, _i, _j), the block they meet in, and
    _own, which of the two they were dealt to; the rows of a block stand together in one partition.

    A leader with many members deals them to several blocks and every pair of blocks meets,
    so a task's group stays bounded whatever the size of the bucket.
    """
    # leaders with more than one block, under every salt, so that their many members are spread
    blocks = (
        members.groupBy("_leader")
        .agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("_n") / BLOCK_WEIGHT)).alias("_many"))
        .filter("_many > 1")
        .select("_leader", "_many", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int"))
    count = F.coalesce("_many", F.lit(1).cast("long"))
    placed = salted.join(blocks, ["_leader", "_salt"], "left").select("_leader", "_x", count.alias("_blocks"))
    own = F.pmod(F.xxhash64("_x"), F.col("_blocks"))
    placed = placed.select(
        "_leader", "_x", own.alias("_own"), F.explode(F.expr("sequence(0L, _blocks - 1)")).alias("_other")
    ).select("_leader", "_x", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own")
    return (
        placed.join(payload, "_x")
        .select("_leader", "_i", "_j", "_own", *payload.columns)
        .repartition("_leader", "_i", "_j")
        .sortWithinPartitions("_leader", "_i", "_j")
    )


def block_links(
    members: DataFrame, payload: DataFrame, decide: Callable[[pa.Table], list[tuple[int, int]]]
) -> DataFrame:
    """Links (a, b) among the members of each leader.

    ``payload`` has one row (_x, ...) per node with what ``decide`` needs; ``decide`` gets the
    payload rows of one block and returns few edges (a spanning forest of its links).
    """
    return met_in_blocks(members, payload).drop("_own").mapInArrow(_per_block(decide), "a long, b long")


def _per_block(decide):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            edges = decide(table) if table.num_rows > 1 else []
            return pa.record_batch(
                [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        at, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([np.asarray(batch.column(k)) for k in range(3)])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            body = batch.select(batch.schema.names[3:])
            for low, high in zip(cuts[:-1], cuts[1:]):
                key = tuple(group[:, low])
                if key != at:
                    if parts:
                        yield links(parts)
                    at, parts = key, []
                parts.append(body.slice(low, high - low))
        if parts:
            yield links(parts)

    return run


def forest(ids: np.ndarray, neighbours: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """(smallest member, member) edges of the components of a graph on ``ids``; ``neighbours``
    gives a row of truth values over all nodes for a set of nodes."""
    edges, todo = [], np.ones(len(ids), bool)
    for k in np.argsort(ids, kind="stable"):
        if not todo[k]:
            continue
        todo[k] = False
        front = np.array([k])
        while len(front):
            front = np.flatnonzero(neighbours(front) & todo)
            todo[front] = False
            edges += [(int(ids[k]), int(ids[x])) for x in front]
    return edges
