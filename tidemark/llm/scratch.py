"""Written intermediate tables and connected components, shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Spark's setting that the shuffle files of a written table go when it is written, not when the driver collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: stands for a null document id inside the operators, so that joins on ids keep it
NULL_ID = -(2**63)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts the lineage,
    survives lost executors, and costs compressed columns instead of raw rows. What was shuffled for it is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-llm/{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator works on, as ``_id`` (null: NULL_ID) and ``_text``."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        docs[text_col].cast("string").alias("_text"),
    )


def given_id(column: str = "_id") -> F.Column:
    """The id as it was given: NULL_ID back to null."""
    return F.nullif(F.col(column), F.lit(NULL_ID).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, component),
    the component being its smallest node. Nodes without an edge do not appear.

    Alternating large-star and small-star steps; each is a minimum per node, combined
    before the shuffle, and a join back to the edges, which adaptive execution can split.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = saved(edges.distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low)
        )
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = saved(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
