"""Near-duplicate documents: a multi-index Hamming join over b-bit minhash signatures.

A signature has SYMBOLS minhash values cut to 16 bits; the distance of two signatures is
the number of places where they differ. It is split into CHUNKS chunks. If two signatures
differ in at most RADIUS = 2 * CHUNKS - 1 places, some chunk holds at most one error
(pigeonhole), so every chunk is indexed with each one of its places left out: two
signatures within the radius then share a key. Documents whose similarity is exactly at
the threshold of 0.85 are further apart than all keys reach with probability below 2e-8.

No pair of a bucket is emitted as a row. Equal sets are one node from the start. A bucket
names its smallest node (by the digest of its set) the leader; the members of all buckets of a leader meet in blocks
of bounded size (a large group is dealt to pairs of blocks), where full shingle sets are
compared, and a block returns only a spanning forest of its confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import block_links, bucket_members, forest
from tidemark.llm.scratch import NULL_ID, components, given_id, id_and_text, saved
from tidemark.llm.textbytes import Words, as_long, chunks, list_array, mix, shingles

CHUNKS, PLACES = 10, 5
SYMBOLS = CHUNKS * PLACES
RADIUS = 2 * CHUNKS - 1
#: parts into which the copies of one set are dealt
SALTS = 64

_random = np.random.default_rng(851)
_SCALE = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_KEY_SALT = _random.integers(0, 2**63, (CHUNKS, PLACES), dtype=np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """16-bit minhash symbols of a set of 64-bit numbers."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 4_096):
        part = values[k : k + 4_096][None, :] * _SCALE[:, None]
        part += _SHIFT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return mix(low) & np.uint64(0xFFFF)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """For each signature (rows of symbols) the keys of its chunks, one place left out of each."""
    chunk = signatures.reshape(len(signatures), CHUNKS, PLACES)
    keys = np.empty(chunk.shape, np.uint64)
    for gone in range(PLACES):
        value = np.zeros(chunk.shape[:2], np.uint64)
        for k in range(PLACES):
            if k != gone:
                value = (value << np.uint64(16)) | chunk[:, :, k]
        keys[:, :, gone] = mix(mix(value) ^ _KEY_SALT[None, :, gone])
    return keys.reshape(len(signatures), SYMBOLS)


def _sets(data, starts, lengths) -> list[np.ndarray]:
    values, windows = shingles(Words(data, starts, lengths))
    return [np.unique(x) for x in np.split(values, np.cumsum(windows)[:-1])]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, starts, lengths, batch in chunks(batches):
        sets = _sets(data, starts, lengths)
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        digest = np.zeros((2, len(sets)), np.uint64)
        signatures = np.zeros((len(full), SYMBOLS), np.uint64)
        for row, k in enumerate(full):
            digest[0, k] = mix(sets[k]).sum()
            digest[1, k] = mix(sets[k] ^ np.uint64(0x5BD1E995A5A5A5A5)).sum()
            signatures[row] = signature(sets[k])
        yield pa.record_batch(
            [
                pa.array(ids),
                batch.column(batch.schema.names.index("_th")),
                pa.array(sizes.astype(np.int64)),
                pa.array(as_long(digest[0])),
                pa.array(as_long(digest[1])),
                list_array(as_long(keys_of(signatures).ravel()), np.where(sizes > 0, SYMBOLS, 0)),
            ],
            ["_id", "_th", "_n", "_d1", "_d2", "_keys"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, starts, lengths, _ in chunks(batches):
        sets = _sets(data, starts, lengths)
        yield pa.record_batch(
            [pa.array(ids), list_array(as_long(np.concatenate(sets)), np.array([len(s) for s in sets]))],
            ["_x", "_set"],
        )


def confirmed_links(percent: int):
    """Decides the links of a block (_x, _set): 100 * intersection >= percent * union."""

    def decide(table: pa.Table) -> list[tuple[int, int]]:
        ids = np.asarray(table["_x"])
        column = table["_set"].combine_chunks()
        values = np.asarray(column.flatten()).view(np.uint64)
        sizes = np.asarray(column.value_lengths()).astype(np.int64)
        n = len(ids)
        distinct, where = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        # only what two sets hold can be common to two sets
        shared = np.bincount(where, minlength=len(distinct)) > 1
        column = (np.cumsum(shared) - 1)[where]
        keep = shared[where]
        owner, column = owner[keep], column[keep]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width, step = int(shared.sum()), max(1, 8_000_000 // n)
        common = np.zeros((n, n), np.float32)
        for low in range(0, width, step):
            a, b = np.searchsorted(column, (low, low + step))
            part = np.zeros((n, min(step, width - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        common = common.astype(np.int64)
        linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        return forest(ids, lambda front: linked[front].any(axis=0))

    return decide


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(_id, _th, _n, _component, _kept) for each row."""
    texts = id_and_text(docs, id_col, text_col).withColumn("_th", F.xxhash64("_text"))
    sketch = saved(
        texts.mapInArrow(_sketch, "_id long, _th long, _n long, _d1 long, _d2 long, _keys array<long>")
    )
    # a node is a set, under its digest: rows that share an id may hold different sets
    nodes = (
        sketch.filter("_n > 0")
        .groupBy("_d1", "_d2", "_n")
        .agg(F.min(F.struct("_id", "_th")).alias("_first"), F.count("*").alias("_m"), F.first("_keys").alias("_keys"))
    )
    entries = nodes.select(F.col("_d1").alias("_x"), F.col("_n"), F.explode("_keys").alias("_key"))
    members = bucket_members(entries)
    wanted = members.select("_x").distinct()
    where = nodes.join(wanted, nodes["_d1"] == wanted["_x"], "left_semi").select("_first._id", "_first._th", "_d1")
    # merged at every size: a broadcast would only fit small tables; of repeated rows one goes on
    sets = (
        texts.join(where.hint("merge"), ["_id", "_th"])
        .dropDuplicates(["_id", "_th"])
        .select(F.col("_d1").alias("_id"), "_text")
        .mapInArrow(_full_sets, "_x long, _set array<long>")
    )
    label = components(block_links(members, sets, confirmed_links(percent)))
    linked = nodes.drop("_keys").join(label, F.col("_d1") == F.col("node"), "left")
    least = linked.filter("component is not null").groupBy("component").agg(F.min("_first").alias("_least"))
    # one row per set that has copies or links, under every salt: a set of any number of copies is spread
    classes = (
        linked.join(least, "component", "left")
        .filter("_m > 1 or component is not null")
        .select(
            "_d1", "_d2", "_n",
            F.coalesce("_least", "_first").alias("_class"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
        )
    )
    salted = sketch.drop("_keys").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    own = F.struct("_id", "_th")
    return salted.join(classes, ["_d1", "_d2", "_n", "_salt"], "left").select(
        "_id", "_th", "_n",
        F.coalesce("_class._id", "_id").alias("_component"),
        (F.col("_class").isNull() | (F.col("_class") == own)).alias("_kept"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when their sets of five-word shingles satisfy
    ``100 * intersection >= percent * union``; component_id is the smallest id reachable;
    its row (of several with that id the one of smallest text hash) is kept.

    Null and empty texts and texts without words have an empty set and no links. A null id
    is a document like any other, smaller than all ids, and stays null. Rows that
    share an id are judged by their own texts. Repeated rows are equal sets, hence one
    component. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    return _components(docs, id_col, text_col, percent).select(
        given_id().alias("doc_id"),
        F.col("_n").alias("n_shingles"),
        given_id("_component").alias("component_id"),
        F.col("_kept").alias("kept"),
    )


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """``docs`` with the document of smallest id of each component of near_duplicates; of rows that
    agree in id and text one stays. All columns as they are; texts without words are kept."""
    kept = _components(docs, id_col, text_col, percent).filter("_kept").select("_id", "_th")
    own = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_th"),
    )
    one = own.join(kept.distinct().hint("merge"), ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"])
    return one.select("_row.*")
