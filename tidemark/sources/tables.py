"""CSV sources and sinks of version tables, and the rule source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rule_graph import RULE_SCHEMA
from tidemark.session import materialize, small_frame


#: Marks null while reading, so that an empty field is null and a quoted empty one a text.
NULL_MARK = "\ue000null\ue000"


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    multiline: bool = False,
) -> DataFrame:
    """A CSV table with a header line, as :func:`save_table` writes it.

    Rows with too many or too few fields, or that do not fit the schema, are an error.
    Without a schema, columns take their names from the header and are all text; no data is
    read to guess types. An empty field is null, ``""`` an empty text; quotes inside a quoted
    field are doubled. ``multiline`` allows line breaks in quoted fields, at the price
    that a file is read by one task.
    """
    options = {
        "header": True,
        "sep": sep,
        "mode": "FAILFAST",
        "nullValue": NULL_MARK,
        "escape": '"',
        "multiLine": multiline,
        "columnPruning": False,  # a pruned row would not show that it is too short
    }
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def save_table(
    df: DataFrame,
    path: str,
    files: int | None = None,
    even: bool = True,
    sep: str = ",",
    multiline: bool = False,
    file_bytes: int | None = None,
) -> None:
    """Write CSV with a header, replacing what is there.

    By default every partition becomes a file. ``files`` bounds their number: ``even``
    reaches it with a round-robin shuffle, which keeps the work before it parallel; otherwise
    partitions are merged, which avoids the shuffle but runs the last stage in ``files``
    tasks. ``file_bytes`` sets the number of files by the measured bytes of the text instead, so that
    each has about so many; the table is computed once, into the checkpoint folder.
    A text with a line break is an error unless ``multiline`` allows it, on reading too.

    The files are written beside ``path`` and take its place when all are there, so a reader never sees
    half a table, a failed job leaves the old one, and ``df`` may read from ``path`` itself.
    """
    if files is not None and file_bytes is not None:
        raise ValueError("give files or file_bytes, not both")
    if not multiline:
        message = F.lit("a text has a line break; write and read with multiline=True")
        breaks = [
            F.when(F.col(f"`{f.name}`").rlike("[\\r\\n]"), F.raise_error(message)).otherwise(F.col(f"`{f.name}`"))
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
        df = df.select(*[b.cast(f.dataType).alias(f.name) for b, f in zip(breaks, df.schema)])
    options = {
        "header": True,
        "sep": sep,
        "escape": '"',
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    if file_bytes is not None:
        df = materialize(df)
        files, even = max(1, round(_csv_bytes(df, sep) / file_bytes)), True
    if files is not None:
        df = df.repartition(files) if even else df.coalesce(files)
    staging = f"{path.rstrip('/')}.staging-{uuid4().hex}"
    df.write.options(**options).csv(staging)
    _swap(df.sparkSession, staging, path.rstrip("/"))


def _csv_bytes(df: DataFrame, sep: str) -> int:
    """Bytes of the lines of ``df`` as CSV."""
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in df.columns]), {"sep": sep, "escape": '"'})
    return df.agg(F.sum(F.octet_length(line) + 1)).first()[0] or 0


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """Let the folder ``staging`` take the place of ``path``: two renames, whatever the size."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, place, old = hadoop(staging), hadoop(path), hadoop(f"{staging}-old")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(place)
    if there and not files.rename(place, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(new, place):
        if there:
            files.rename(old, place)
        raise OSError(f"cannot move {staging} to {path}")
    if there:
        files.delete(old, True)


def save_bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None
) -> DataFrame:
    """Write ``df`` as the catalog table ``name``, dealt to ``buckets`` buckets by ``keys`` and sorted by
    them inside, and read it. An existing table of that name is replaced.

    Joins and groupings on ``keys`` then read the table where it lies: bucketed by entity and version,
    :func:`~tidemark.join_back` shuffles only the repaired cells. One exchange while writing puts a bucket into one file.
    """
    writer = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys]).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table available to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df


def preview(df: DataFrame, rows: int = 1) -> DataFrame:
    """The first rows Spark produces."""
    return df.limit(rows)


def load_rules(
    spark: SparkSession,
    source: str | Mapping[str, list[tuple[str, str]]],
    monotone: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """A rule table ``attribute, src, dst, kind`` from a mapping or a CSV file.

    The mapping gives per attribute its (older, newer) pairs. ``monotone`` marks
    attributes declared to only grow or shrink, e.g. ``("low", "high")``. A CSV
    file has the same columns; ``kind`` may be left empty for state rules.
    """
    if isinstance(source, str):
        rules = spark.read.option("header", True).schema(RULE_SCHEMA).csv(source)
        return rules.withColumn("kind", F.coalesce("kind", F.lit("state")))
    rows = [(a, s, d, "state") for a, pairs in source.items() for s, d in dict.fromkeys(map(tuple, pairs))]
    rows += [(a, s, d, "monotone") for a, (s, d) in (monotone or {}).items()]
    return small_frame(spark, rows, RULE_SCHEMA)
