"""Exact removal of repeated 100-byte strings by refining buckets of sampled suffixes.

Bucket-pointer refinement, with content names for bucket identifiers. The name of a 20-byte
gram is paired with the name 20 bytes later (40 bytes), that with the name 40 bytes later
(80), and that with the 20-byte name at offset 80: the name of the 100-byte string at any
position is made of names at later offsets, each reused.

Only a sample of the suffixes is sorted. The anchor of a 100-byte string is its leftmost
smallest 40-byte name (of the 61 in it), so equal strings have their anchors at the same
offset, and consecutive strings mostly share one. Buckets of anchors are refined:

1. bucket: the 40-byte name. An anchor alone in its bucket has no repeated string.
2. refined by the names of the first and the last string it anchors: members with equal
   names repeat the earliest of them with all their strings.
3. what is earliest under its refined name, in a bucket with several of them, is refined to
   single strings by their 100-byte names; all but the earliest of a name are repeats.

Each task resolves what it can of its own texts first and sends at most two rows for a
bucket, so a passage in a third of all documents arrives as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import NULL_ID, given_id, saved
from tidemark.llm.textbytes import _BASE, _BASE_INVERSE, _BYTE_CODE, _power, as_long, bytes_of, chunks, list_array, mix

U = np.uint64
LENGTH, GRAM = 100, 20
#: 40-byte names in a string; so many consecutive names are compared for its anchor
SPREAD = LENGTH - 2 * GRAM + 1
#: bytes of text handled at once; longer texts are handled in overlapping segments
SEGMENT = 1_000_000
_PLACE = U((1 << 28) - 1)
SEEN, MARK, REPEAT, OPEN = 0, 1, 2, 3
TAG = 25


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(_BASE) + b)


class Names:
    """Names at all positions of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        code = _BYTE_CODE[data]
        code *= _power(_BASE, n)
        total = np.zeros(n + 1, U)
        np.cumsum(code, out=total[1:])
        gram = total[GRAM:] - total[:-GRAM]
        gram *= _power(_BASE_INVERSE, n)[: len(gram)]
        self.n20 = mix(gram)
        self.n40 = _pair(self.n20[:-GRAM], self.n20[GRAM:])

    def anchors(self) -> np.ndarray:
        """The anchor's position for each 100-byte string."""
        low = (self.n40 & ~_PLACE) | np.arange(len(self.n40), dtype=U)
        width = 1
        while 2 * width <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPREAD - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        return (low & _PLACE).astype(np.int64)

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Names of the 100-byte strings at some positions."""
        return _pair(_pair(self.n40[at], self.n40[at + 2 * GRAM]), self.n20[at + 4 * GRAM])


def _segments(data, starts, lengths) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text index, position in the text, segment start in bytes) of groups of segments,
    each with LENGTH bytes or more; every string of a text is in one segment."""
    part, doc, base, begin, size = [], [], [], [], 0
    for k in np.flatnonzero(lengths >= LENGTH):
        for low in range(0, int(lengths[k]) - LENGTH + 1, SEGMENT):
            high = min(low + SEGMENT + LENGTH - 1, int(lengths[k]))
            if size and size + high - low > SEGMENT:
                yield np.concatenate(part), np.array(doc), np.array(base), np.array(begin)
                part, doc, base, begin, size = [], [], [], [], 0
            part.append(data[starts[k] + low : starts[k] + high])
            doc.append(k)
            base.append(low)
            begin.append(size)
            size += high - low
    if part:
        yield np.concatenate(part), np.array(doc), np.array(base), np.array(begin)


def resolve(bucket, name, ids, tags, places):
    """Order entries by (bucket, name, id, tag, place); arrays of indices

    repeat: not the earliest of its name (entries equal to the earliest in id, tag and place
    are the same row again and left out); first: the earliest of each name; several: whether
    the bucket of that earliest has other names.
    """
    order = np.lexsort((places, tags, ids, name, bucket))
    b, n = bucket[order], name[order]
    new_bucket = np.ones(len(order), bool)
    new_bucket[1:] = b[1:] != b[:-1]
    new_name = new_bucket.copy()
    new_name[1:] |= n[1:] != n[:-1]
    first = np.flatnonzero(new_name)
    owner = order[first][np.cumsum(new_name) - 1]
    same = (ids[owner] == ids[order]) & (tags[owner] == tags[order]) & (places[owner] == places[order])
    repeat = order[~same]
    names_in_bucket = np.bincount(np.cumsum(new_bucket)[first] - 1)
    several = names_in_bucket[np.cumsum(new_bucket)[first] - 1] > 1
    return repeat, order[first], several


_ENTRY = "_bucket long, _name long, _kind int, _id long, _w int, _p int"
_FOUND = "_id long, _w int, _p int, _open boolean"


def _entries(parts) -> pa.RecordBatch:
    columns = [np.concatenate([p[k] for p in parts]) for k in range(6)] if parts else [np.zeros(0)] * 6
    kinds = (np.int64, np.int64, np.int32, np.int64, np.int32, np.int32)
    return pa.record_batch(
        [pa.array(c.view(np.int64) if c.dtype == U else c.astype(k)) for c, k in zip(columns, kinds)],
        ["_bucket", "_name", "_kind", "_id", "_w", "_p"],
    )


def _emit(bucket, name, ids, w, p) -> pa.RecordBatch:
    """Resolve a task's own entries and keep what other tasks must know or decide."""
    repeat, first, several = resolve(bucket, name, ids, w >> 6, p)
    spread = mix(ids.astype(np.int64).view(U) ^ U(0xA5A5))

    def part(kind, k, key, value):
        return key, value, np.full(len(k), kind), ids[k], w[k], p[k]

    single, crowd = first[~several], first[several]
    _, one = np.unique(bucket[crowd], return_index=True)
    marks = crowd[one]
    return _entries(
        [
            part(SEEN, single, bucket[single], name[single]),
            part(MARK, marks, bucket[marks], np.zeros(len(marks), U)),
            part(OPEN, crowd, spread[crowd], np.zeros(len(crowd), U)),
            part(REPEAT, repeat, spread[repeat], np.zeros(len(repeat), U)),
        ]
    )


def _anchor_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, starts, lengths, batch in chunks(batches, SEGMENT):
        tag = np.asarray(batch.column(batch.schema.names.index("_tag")))
        for piece, doc, base, begin in _segments(data, starts, lengths):
            names = Names(piece)
            ends = np.append(begin[1:], len(piece))
            counts = ends - begin - LENGTH + 1
            segment = np.repeat(np.arange(len(doc)), counts)
            at = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[segment]
            anchor = names.anchors()[at]
            cut = np.flatnonzero(np.diff(anchor, prepend=-1))
            p0, p1, anchor, segment = at[cut], at[np.append(cut[1:], len(at)) - 1], anchor[cut], segment[cut]
            width = p1 - p0
            name = _pair(_pair(names.strings(p0), names.strings(p1)), ((anchor - p0) * 64 + width).astype(U))
            owner = doc[segment]
            yield _emit(
                names.n40[anchor], name, ids[owner], (tag[owner] << 6) | width.astype(np.int32),
                (p0 - begin[segment] + base[segment]).astype(np.int32),
            )


def _settle(windows: bool):
    """Resolve sorted entries bucket by bucket; ``windows``: the names are single strings."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows):
            bucket, name, kind, ids, w, p = rows
            told = kind >= REPEAT
            seen = np.flatnonzero(kind == SEEN)
            repeat, first, several = resolve(bucket[seen], name[seen], ids[seen], w[seen] >> 6, p[seen])
            several |= np.isin(bucket[seen][first], bucket[kind == MARK])
            opened = first[several] if not windows else first[:0]
            keep = np.concatenate((np.flatnonzero(told), seen[repeat], seen[opened]))
            is_open = np.concatenate((kind[told] == OPEN, np.zeros(len(repeat), bool), np.ones(len(opened), bool)))
            return pa.record_batch(
                [pa.array(ids[keep]), pa.array(w[keep]), pa.array(p[keep]), pa.array(is_open)],
                ["_id", "_w", "_p", "_open"],
            )

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(k)) for k in range(6)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            if cut:
                yield done([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        if rest is not None:
            yield done(rest)

    return settle


def _string_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the single strings of open ranges: columns _id, _text, _tag, _ranges."""
    for ids, data, starts, lengths, batch in chunks(batches, SEGMENT):
        tag = np.asarray(batch.column(batch.schema.names.index("_tag")))
        ranges = batch.column(batch.schema.names.index("_ranges"))
        flat = np.asarray(ranges.flatten())
        owner = np.repeat(np.arange(len(ids)), np.asarray(ranges.value_lengths()))
        p, width = flat >> 6, flat & 63
        counts = width + 1
        owner = np.repeat(owner, counts)
        at = np.repeat(p, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = []
        for piece, doc, base, begin in _segments(data, starts, lengths):
            names = Names(piece)
            ends = np.append(begin[1:], len(piece))
            for k in range(len(doc)):
                low, high = np.searchsorted(owner, (doc[k], doc[k] + 1))
                mine = at[low:high]
                mine = mine[(mine >= base[k]) & (mine < min(base[k] + SEGMENT, base[k] + ends[k] - begin[k] - LENGTH + 1))]
                if len(mine):
                    name = names.strings(mine - base[k] + begin[k])
                    found.append((name, np.full(len(mine), doc[k]), mine))
        if found:
            name, doc, place = (np.concatenate(x) for x in zip(*found))
            yield _emit(name, name, ids[doc], tag[doc] << 6, place.astype(np.int32))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns _id, _text, _ranges -> the report of each text."""
    for batch in batches:
        column = batch.column(batch.schema.names.index("_text"))
        data, offsets = bytes_of(column)
        ranges = batch.column(batch.schema.names.index("_ranges"))
        ranges = ranges.fill_null(pa.scalar([], ranges.type)) if ranges.null_count else ranges
        flat = np.asarray(ranges.flatten())
        bounds = np.concatenate(([0], np.cumsum(np.asarray(ranges.value_lengths()))))
        rows, spans = [], []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            mine = flat[bounds[k] : bounds[k + 1]]
            gone = np.zeros(len(text) + 1, np.int32)
            np.add.at(gone, mine >> 6, 1)
            np.add.at(gone, (mine >> 6) + (mine & 63) + LENGTH, -1)
            gone = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            spans.append(edge)
            kept = text[~gone]
            rows.append((len(text), len(text) - len(kept), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest()))
        n, removed, number, digest = zip(*rows) if rows else ((), (), (), ())
        yield pa.record_batch(
            [
                batch.column(batch.schema.names.index("_id")),
                pa.array(n, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(number, pa.int64()),
                pa.array(digest, pa.string()),
                list_array(np.concatenate(spans) if spans else np.zeros(0, np.int64), np.array([len(s) for s in spans])),
            ],
            ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartition("_bucket").sortWithinPartitions("_bucket")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row of ``docs``.

    A byte is removed if a 100-byte string over it also starts earlier: in a smaller id, or
    in the same document at an earlier byte. ``removed`` lists begin and end of each maximal
    removed run, one after the other. All is judged on the texts as given, in UTF-8 bytes.

    A null text is empty; texts under 100 bytes lose nothing. A null id counts as the
    smallest. Of rows with one id and different texts, one (by a hash of the text) is the
    earlier; rows repeated as a whole are one document and lose the same bytes. Other columns
    are not read. An empty table gives an empty result.
    """
    text = docs[text_col].cast("string")
    texts = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(text).bitwiseAND((1 << TAG) - 1).cast("int").alias("_tag"),
        text.alias("_text"),
    )
    entries = texts.filter(F.octet_length("_text") >= LENGTH).mapInArrow(_anchor_entries, _ENTRY)
    found = saved(_sorted(entries).mapInArrow(_settle(False), _FOUND))

    def ranges(rows: DataFrame) -> DataFrame:
        packed = F.shiftleft(F.col("_p").cast("long"), 6).bitwiseOR(F.col("_w").bitwiseAND(63).cast("long"))
        return (
            rows.groupBy("_id", F.shiftright("_w", 6).alias("_tag"))
            .agg(F.collect_list(packed).alias("_ranges"))
            .hint("merge")
        )

    opened = texts.join(ranges(found.filter("_open")), ["_id", "_tag"]).mapInArrow(_string_entries, _ENTRY)
    strings = _sorted(opened).mapInArrow(_settle(True), _FOUND)
    gone = found.filter("not _open").union(strings)
    report = texts.join(ranges(gone), ["_id", "_tag"], "left").mapInArrow(
        _cut,
        "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>",
    )
    return report.select(given_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")
