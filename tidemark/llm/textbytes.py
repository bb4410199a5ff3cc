"""Vectorised words and hashes over the UTF-8 bytes of many texts at once.

Used inside Spark tasks only: a task turns the texts of an Arrow batch into one byte
array, and everything here is a numpy pass over such an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: bytes of text handled at once in a task; a single longer text is handled alone
CHUNK_BYTES = 2_000_000

_random = np.random.default_rng(20240229)
_BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: white space and all other ASCII marks: only letters, digits and bytes above ASCII make words
PUNCTUATED = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (in place when ``x`` is a temporary)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes
        keep = np.asarray(column.is_valid())
        lengths = np.where(keep, np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            return bytes_of(pa.array(column.to_pylist(), pa.string()).fill_null(""))
    return data, offsets


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(ids, bytes, starts, lengths, batch slice) for groups of whole texts of ``limit`` bytes or one text.
    Batches carry ``_id`` and ``_text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        ids = np.asarray(batch.column(names.index("_id")))
        data, offsets = bytes_of(batch.column(names.index("_text")))
        first = 0
        while first < len(ids):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(ids))
            low, high = offsets[first], offsets[last]
            yield (
                ids[first:last],
                data[low:high],
                offsets[first:last] - low,
                np.diff(offsets[first : last + 1]),
                batch.slice(first, last - first),
            )
            first = last


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, or those between other marks, A-Z lower-cased.

    hash: a 64-bit number per word; doc: index of its text; counts: words per text;
    start, end: byte positions in ``spaced``, the texts with one space after each.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, between: np.ndarray = _WHITE):
        n = len(lengths)
        spaced = np.full(len(data) + n, 0x20, np.uint8)
        owner = np.repeat(np.arange(n), lengths)
        spaced[np.arange(len(data)) + owner] = data
        self.spaced = spaced
        self.text_start = starts + np.arange(n)
        inside = ~between[spaced]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=n)
        code = _BYTE_CODE[_LOWER[spaced]]
        code *= _power(_BASE, len(spaced))
        total = np.zeros(len(spaced) + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        word = total[self.end] - total[self.start]
        word *= _power(_BASE_INVERSE, len(spaced))[self.start]
        self.hash = mix(word)


def window_hash(h: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Hash of the windows of ``length`` (at most ``size``) words of ``h`` from ``begin`` on."""
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    value = np.full(len(begin), size, np.uint64)
    for k in range(size):
        value *= U(_BASE)
        value += np.where(length > k, padded[begin + k], U(0))
    value += length.astype(np.uint64)
    return mix(value)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window of ``size`` words, number of windows per text), in text order.
    A text with fewer words has one, made of all its words; without words none."""
    h, counts = words.hash, words.counts
    first = np.cumsum(counts) - counts
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    return window_hash(h, begin, np.repeat(np.minimum(counts, size), windows), size), windows


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
