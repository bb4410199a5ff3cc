"""Connected parts of rule graphs too large for a task.

No path leads from one part to another, so each part is sorted, closed and walked by itself, many
parts a task. Values are compared as 64-bit hashes here: a clash only joins two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: links that one task joins by itself
TASK_LINKS = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, part) of all links of a task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "part"])


def connected(links: DataFrame) -> DataFrame:
    """(node, part) of materialized undirected ``links`` (u, v) between longs; equal parts are connected.

    In a round every node moves to the least label next to it, and links between what is left go on.
    Labels are hashed anew each round, so that a round removes a constant share of the nodes,
    whatever the graph. The last ``TASK_LINKS`` links are joined in one task.
    """
    moves: list[DataFrame] = []
    while links.count() > TASK_LINKS:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"))
        move = materialize(least.select(F.col("u").alias("node"), F.xxhash64(F.least("u", "v")).alias("part")))
        moves.append(move)
        ends = [move.select(F.col("node").alias(c), F.col("part").alias(f"_{c}")) for c in ("u", "v")]
        links = links.join(ends[0], "u").join(ends[1], "v").filter("_u <> _v")
        links = materialize(links.select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
    out = materialize(links.coalesce(1).mapInArrow(_joined, "node long, part long"))
    while moves:  # a node that met no other after a round keeps its label
        last = out.select(F.col("node").alias("part"), F.col("part").alias("_part"))
        out = moves.pop().join(last, "part", "left").select("node", F.coalesce("_part", "part").alias("part"))
    return out


def with_parts(edges: DataFrame) -> DataFrame:
    """Materialized ``edges`` (attribute, src, dst) with the column ``_part``."""
    hashed = edges.select("*", *[F.xxhash64("attribute", c).alias(n) for c, n in (("src", "u"), ("dst", "v"))])
    parts = connected(materialize(hashed.select("u", "v")))
    return hashed.join(parts.select(F.col("node").alias("u"), F.col("part").alias("_part")), "u").select(
        "attribute", "src", "dst", "_part"
    )


def part_of_values(edges: DataFrame) -> DataFrame:
    """(attribute, value, _part) of ``edges`` with parts."""
    ends = [edges.select("attribute", F.col(c).alias("value"), "_part") for c in ("src", "dst")]
    return ends[0].unionByName(ends[1]).groupBy("attribute", "value").agg(F.min("_part").alias("_part"))
