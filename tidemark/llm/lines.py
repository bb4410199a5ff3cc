"""Fuzzy line deduplication: pieces of lines as blocks, SimHash, edit similarity, connected groups.

A line is normalised to its words (A-Z lower-cased, white space collapsed). Equal lines are
one node. Lines whose edits leave some pieces whole share them: a node's blocks are the GRAMS
smallest hashes of its windows of five to twelve characters. Members of a block go together when their lengths, and the lengths
before and after the common window, allow the edit bound, and the characters beside the window are nearly the same. Of
these, lines whose SimHash fingerprints (112 bits over windows of six bytes) differ in at most RADIUS bits are candidates;
their texts are compared, and they are linked when the edit similarity, 1 - Levenshtein / longer length, reaches the bound.
Of every connected group the first occurrence (document id, text hash, line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import BLOCK_ROWS, SALTS, met_in_blocks
from tidemark.llm.edits import edit_distance, spread, within
from tidemark.llm.scratch import NULL_ID, components, given_id, saved
from tidemark.llm.textbytes import (
    _BASE,
    _BASE_INVERSE,
    _BYTE_CODE,
    _LOWER,
    Words,
    _power,
    as_long,
    chunks,
    list_array,
    mix,
)

U = np.uint64
#: bytes of the windows that make fingerprints
PRINT_BYTES = 6
#: bits of 112 in which the fingerprints of linked lines may differ
RADIUS = 47
EDIT_SIMILARITY = 0.9
GRAMS = 10
#: shorter lines have no similar line but equal ones: one edit is more than the bound allows
FUZZY_CHARS = 10
#: class k holds the lines from EDIT_SIMILARITY * EDGES[k] to below EDGES[k + 1] characters; its windows have
#: WIDTHS[k]. Up to eight surely stay together when every tenth is edited; edits at random places leave
#: longer pieces in longer lines
EDGES = np.array([FUZZY_CHARS, 20, 30, 40, 60, 100, np.inf])
WIDTHS = np.array([5, 6, 7, 8, 10, 12])
#: lengths from here on count as equal among candidates; the edit similarity has the full ones
LONG = 0xFFFF
#: bits of a key that are compared; the lowest 16 hold a length
KEY = 0x7FFFFFFFFFFF0000
#: the lowest bits of the second fingerprint hold a salt and, above it, the place of the key's window: so many steps
#: of the line's length, the last one for a window that the line has more than once
SALT_BITS, ANYWHERE = 7, 511
SALT = (1 << SALT_BITS) - 1
#: a task spreads the rows of a block that it has given so many members over SALTS
HOT_ROWS, HOT_BATCH = BLOCK_ROWS, 4
#: a larger group than BLOCK_ROWS is dealt to cells of lengths and places, and a task settles a cell of at most so many
CELL_ROWS = 16 * BLOCK_ROWS
#: lines whose lengths allow the edit bound are in one band of lengths or in neighbouring ones, which grow by this factor
BAND = 1 / (EDIT_SIMILARITY - 0.001)
#: characters after and before a key's window that a row of the key has, four bits each, and by how many they may be moved
AHEAD, BEHIND, DRIFT = 16, 12, 3
#: pairs of neighbouring characters, of 26 after and before the window, that one of two lines may lack in the other. An edit
#: takes away two, so lines with a tenth of their characters edited lack some five; lines that share the window alone lack most
MISSED = 11
#: bits of the marks of candidate lines, a bound of what the driver holds
MARKS = 1 << 26
#: bytes of text whose lines are read at once: their numbers stay in a core's cache
READ_BYTES = 500_000
#: a task compares the lines of whole blocks when it has so many of them, or so many bytes; pairs are told apart so many at once
LINK_ROWS, LINK_BYTES, PAIR_ROWS = 4_096, 2_000_000, 1 << 16


#: a small number for each byte
_SMALL = (_BYTE_CODE >> U(56)).astype(np.uint8)


def simhash(word_hash: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of words: bit k is set if it is in more than half of them.

    Run k has counts[k] > 0 words from starts[k] on. Eight 8-bit counters share a number while
    runs are short; longer runs are summed in pieces.
    """
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out
    counts = counts.astype(np.int64)
    pieces = (counts + 254) // 255
    first = np.cumsum(pieces) - pieces
    run = np.repeat(np.arange(len(starts)), pieces)
    offset = (np.arange(len(run)) - first[run]) * 255
    begin = starts[run] + offset
    end = begin + np.minimum(counts[run] - offset, 255)
    half = counts[:, None]
    ones, bounds = np.zeros(len(word_hash) + 1, U), np.stack((begin, end), 1).ravel()
    for k in range(8):
        np.right_shift(word_hash, U(k), out=ones[:-1])
        ones[:-1] &= U(0x0101010101010101)
        lanes = np.add.reduceat(ones, bounds)[::2].copy().view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, first, axis=0)
        for byte in range(8):
            out |= (2 * sums[:, byte] > half[:, 0]).astype(U) << U(8 * byte + k)
    return out


class _Lines:
    """The lines of some texts that are not blank: their text, its place in ``normal`` (words with one space
    after each), number, two hashes of their words, and characters."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        w = Words(data, starts, lengths)
        breaks = np.flatnonzero(w.spaced == 0x0A)
        line_of_word = np.searchsorted(breaks, w.start)  # line breaks before the word
        before = np.searchsorted(breaks, w.text_start)[w.doc] if len(w.doc) else w.doc
        group = line_of_word + w.doc  # distinct per line: the space between texts has no break
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        counts = np.diff(np.append(cut, len(group)))
        ones = np.concatenate(([U(0)], np.cumsum(w.hash)))
        position = np.arange(len(w.hash)) - np.repeat(cut, counts)
        sums = np.concatenate(([U(0)], np.cumsum(mix(w.hash ^ mix(position.astype(U) + U(1))))))
        self.h1 = mix(sums[cut + counts] - sums[cut])
        self.h2 = mix(ones[cut + counts] - ones[cut] + counts.astype(U))
        self.doc, self.line = w.doc[cut], line_of_word[cut] - before[cut]
        kept = np.zeros(len(w.spaced) + 1, np.int8)
        kept[w.start] += 1
        kept[w.end + 1] -= 1
        kept = np.cumsum(kept[:-1], dtype=np.int8).astype(bool)
        self.normal = _LOWER[w.spaced[kept]]
        at = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
        self.normal[at[1:] - 1] = 0x20
        self.begin, self.end = at[cut], at[cut + counts] - 1
        chars = np.concatenate(([0], np.cumsum((self.normal & 0xC0) != 0x80)))
        self.size = chars[self.end] - chars[self.begin]
        owner = np.searchsorted(w.text_start, breaks, "right") - 1
        self.per_text = np.where(lengths > 0, np.bincount(owner, minlength=len(lengths)) + 1, 0)


class _Seen:
    """Which numbers come for the first time, as far as a bounded memory tells."""

    def __init__(self):
        self.had: set[int] = set()

    def first(self, values: np.ndarray) -> np.ndarray:
        """Places of the new ones among ``values``."""
        if len(self.had) > 1_000_000:
            self.had = set()
        out = []
        for k, v in enumerate(values.tolist()):
            if v not in self.had:
                self.had.add(v)
                out.append(k)
        return np.array(out, np.int64)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, starts, lengths, batch in chunks(batches, READ_BYTES):
        text_hash = np.asarray(batch.column(batch.schema.names.index("_th")))
        x = _Lines(data, starts, lengths)
        none = np.zeros(len(ids), np.int64)
        # the lines, and after them a row for each text: line -1 with the number of lines
        yield pa.record_batch(
            [
                pa.array(np.concatenate((ids[x.doc], ids))),
                pa.array(np.concatenate((text_hash[x.doc], text_hash))),
                pa.array(np.concatenate((x.line, none - 1)).astype(np.int32)),
                pa.array(np.concatenate((as_long(x.h1), none))),
                pa.array(np.concatenate((as_long(x.h2), none))),
                pa.array(np.concatenate((x.size, x.per_text)).astype(np.int64)),
            ],
            ["_id", "_th", "_line", "_h1", "_h2", "_size"],
        )


def similar(a: str, b: str, least: float = EDIT_SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def _gram_counts(point: np.ndarray, owner: np.ndarray, n: int, width: int, kinds: int) -> np.ndarray:
    """For each of n lines how often it holds the windows of ``width`` characters of each of some kinds;
    counts above 255 are 255, which brings two lines no further apart."""
    last = max(0, len(point) - width + 1)
    value = np.zeros(last, np.uint32)
    for k in range(width):
        value *= np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(15)
        value += point[k : last + k]
    value *= np.uint32(0x9E3779B1)
    value >>= np.uint32(32 - kinds.bit_length() + 1)
    place = owner[:last] * kinds
    place += value
    counts = np.bincount(place[owner[:last] == owner[len(owner) - last :]], minlength=n * kinds)
    return np.minimum(counts, 255, out=counts).reshape(n, kinds).astype(np.int16)


def _all_links(
    block: np.ndarray, deal: np.ndarray, ids: np.ndarray, texts: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the lines of each of some blocks, as (a, b). Lines of one ``deal`` from 0 on meet
    in a block of their own, so they are not compared here; those of -1 are compared with all."""
    code = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    order = np.lexsort((size, block))
    begin = (np.cumsum(size) - size)[order]
    block, deal, ids, size = block[order], deal[order], ids[order], size[order]
    owner, _, at = spread(begin, size)
    point = code[at]
    letter = np.zeros(int(code.max()) + 1, np.int64)
    letter[code] = 1
    code = (np.cumsum(letter) - 1)[code]
    n, most = len(ids), ((1 - EDIT_SIMILARITY) * size + 1e-9).astype(np.int64)
    coarse = _gram_counts(point, owner, n, 2, 64)
    fine = _gram_counts(point, owner, n, 3, 1_024)
    span = int(size.max()) + 1
    low = np.searchsorted(block * span + size, block * span + size - most)
    others = np.arange(n) - low
    # pairs of allowed lengths; an edit takes away two pairs and three triples of characters at most and brings as many
    found, ends, first = [], np.cumsum(others), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - others[first] + PAIR_ROWS, "right")))
        a, _, b = spread(low[first:last], others[first:last])
        a += first
        meet = (deal[a] != deal[b]) | (deal[a] < 0)
        a, b = a[meet], b[meet]
        for counts, width, step in ((coarse, 2, PAIR_ROWS), (fine, 3, PAIR_ROWS // 8)):
            apart = np.zeros(len(a), np.int32)
            for k in range(0, len(a), step):
                gap = counts[a[k : k + step]]
                gap -= counts[b[k : k + step]]
                apart[k : k + step] = np.abs(gap, out=gap).sum(axis=1, dtype=np.int32)
            near = apart <= 2 * width * most[a]
            a, b, apart = a[near], b[near], apart[near]
        found.append((a, b, apart))
        first = last
    a, b, apart = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((apart, a))
    a, b = a[order], b[order]
    # each line is compared with the nearest ones of other groups, with twice as many every time
    group, edges, much = np.arange(n), [], 1
    while len(a):
        new = np.flatnonzero(np.diff(a, prepend=-1))
        now = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a)))) < much
        linked = np.flatnonzero(now)[within(code, begin, size, a[now], b[now], most[a[now]])]
        for x, y in zip(a[linked].tolist(), b[linked].tolist()):
            while group[x] != x:
                group[x] = x = group[group[x]]
            while group[y] != y:
                group[y] = y = group[group[y]]
            if x != y:
                group[max(x, y)] = min(x, y)
                edges.append((x, y))
        while (group[group] != group).any():
            group = group[group]
        rest = ~now & (group[a] != group[b])
        a, b, much = a[rest], b[rest], 2 * much
    x, y = np.array(edges, np.int64).reshape(-1, 2).T
    return ids[x], ids[y]


def linked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among the lines (_x, _line_text, _own) of each block (_leader, _i, _j); many blocks are compared at once."""

    def links(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        group = np.stack([np.asarray(table[c]) for c in ("_leader", "_i", "_j")])
        block = np.cumsum(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))) - 1
        kept = np.flatnonzero(np.bincount(block)[block] > 1)
        a = b = np.zeros(0, np.int64)
        if len(kept):
            text = table["_line_text"].combine_chunks()
            deal = np.where(group[1] == group[2], -1, np.asarray(table["_own"]))
            a, b = _all_links(block[kept], deal[kept], np.asarray(table["_x"])[kept], text.take(pa.array(kept)))
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    parts, rows, weight, at = [], 0, 0, None  # ``at``: the block at the end of the parts
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        group = np.stack([np.asarray(batch.column(names.index(c))) for c in ("_leader", "_i", "_j")])
        sizes = np.asarray(pc.binary_length(batch.column(names.index("_line_text"))))
        sizes = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
        starts = [0, *change.tolist()] if at is not None and at != tuple(group[:, 0]) else change.tolist()
        low = 0
        for high in starts:  # a block ends before each of these
            if rows + high - low >= LINK_ROWS or weight + sizes[high] - sizes[low] >= LINK_BYTES:
                parts.append(batch.slice(low, high - low))
                yield links(parts)
                parts, rows, weight, low = [], 0, 0, high
        parts.append(batch.slice(low))
        rows += batch.num_rows - low
        weight += sizes[-1] - sizes[low]
        at = tuple(group[:, -1])
    if parts:
        yield links(parts)


def _bound(counts: np.ndarray) -> np.ndarray:
    """Hashes (without their lowest 11 bits) below which a run of so many values nearly always has GRAMS."""
    return (np.minimum((GRAMS + 3 * GRAMS**0.5) / counts, 1.0) * 2.0**53).astype(U)


def _smallest(run: np.ndarray, value: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(run, value, first place ``at``, whether it is the only one) of the GRAMS smallest distinct values of each of ``n`` runs."""
    order = np.lexsort((value, run))
    run, value, at = run[order], value[order], at[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (value[1:] != value[:-1])
    once = np.append(new[1:], True)[new]
    run, value, at = run[new], value[new], at[new]
    first = np.searchsorted(run, np.arange(n))
    taken = np.arange(len(run)) - first[run] < GRAMS
    return run[taken], value[taken], at[taken], once[taken]


def _totals(data: np.ndarray) -> np.ndarray:
    """Sums of the codes of the bytes before each place, by which any window has its hash."""
    total = np.zeros(len(data) + 1, U)
    code = _BYTE_CODE[data]
    code *= _power(_BASE, len(data))
    np.cumsum(code, out=total[1:])
    return total


def fingerprints(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, total: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the SimHash over windows of PRINT_BYTES; the lowest 16 bits of the second are 0."""
    n = max(0, len(data) - PRINT_BYTES + 1)
    total = _totals(data) if total is None else total
    window = total[len(total) - n :] - total[:n]
    window *= _power(_BASE_INVERSE, len(data) + 1)[:n]
    window = mix(window)
    counts = lengths - PRINT_BYTES + 1
    s2 = simhash(mix(window ^ U(0x5BD1E995A5A5A5A5)), starts, counts)
    return simhash(window, starts, counts), s2 & ~U(LONG)


def line_keys(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, total: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) for the keys of normalised lines given as bytes; the place of a key's window is in
    steps of the line's length, ANYWHERE for one that is there more than once."""
    return _keys(data, starts, lengths, total)[:3]


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``line_keys``, and the characters after and before each window, the first one if there are several."""
    head = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [len(data)]))
    begin = np.searchsorted(head, starts)
    n = np.searchsorted(head, starts + lengths) - begin
    total = _totals(data) if total is None else total
    total, back = total[head], _power(_BASE_INVERSE, len(data) + 1)[head]
    own = np.searchsorted(EDGES, n, "right") - 1
    fuzzy = np.flatnonzero(n >= FUZZY_CHARS)
    twice = fuzzy[n[fuzzy] >= EDIT_SIMILARITY * EDGES[own[fuzzy] + 1] - 1]
    lines, classes = np.concatenate((fuzzy, twice)), np.concatenate((own[fuzzy], own[twice] + 1))
    beside = _Beside(data, head)
    out = [(np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))]
    for k, g in enumerate(WIDTHS):
        of = np.sort(lines[classes == k])
        if not len(of):
            continue
        counts, first = n[of] - g + 1, begin[of]
        bound = _bound(counts)
        if 2 * counts.sum() > len(data):  # most windows: all at once, those outside these lines never under a bound
            value = mix((total[g:] - total[:-g]) * back[:-g])
            gap = first - np.concatenate(([0], first[:-1] + counts[:-1]))
            limit = np.repeat(np.stack((np.zeros(len(of), U), bound), 1).ravel(), np.stack((gap, counts), 1).ravel())
            hit = np.flatnonzero((value[: len(limit)] >> U(11)) < limit)
            run, value, at = np.searchsorted(first, hit, "right") - 1, value[hit], hit
        else:
            run = np.repeat(np.arange(len(of)), counts)
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            value = mix((total[at + g] - total[at]) * back[at])
            under = (value >> U(11)) < bound[run]
            run, value, at = run[under], value[under], at[under]
        few = np.bincount(run, minlength=len(of)) < np.minimum(GRAMS, counts)
        if few.any():  # all windows of the lines that had too few under the bound
            c, f, enough = counts[few], first[few], ~few[run]
            more = np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())
            run = np.concatenate((run[enough], np.repeat(np.flatnonzero(few), c)))
            value = np.concatenate((value[enough], mix((total[more + g] - total[more]) * back[more])))
            at = np.concatenate((at[enough], more))
        run, value, at, once = _smallest(run, value, at, len(of))
        place = np.where(once, (at - first[run]) * ANYWHERE // n[of[run]], ANYWHERE)
        before, after = at - first[run], first[run] + n[of[run]] - at - g
        out.append((of[run], mix(value ^ U(k)), place, beside.after(at + g, after), beside.before(at, before)))
    return tuple(np.concatenate(x) for x in zip(*out))


class _Beside:
    """The characters beside some places of a text, as numbers from 1 to 15 of four bits each; 0 is no character."""

    def __init__(self, data: np.ndarray, head: np.ndarray):
        code = _SMALL[data]
        if len(head) - 1 < len(data):
            code = np.add.reduceat(code, head[:-1], dtype=np.uint8)
        self.four = np.zeros(BEHIND + len(code) + AHEAD, np.uint16)  # each with the three after it
        self.four[BEHIND : BEHIND + len(code)] = code % np.uint8(15) + np.uint8(1)
        self.four[:-1] |= self.four[1:] << np.uint16(4)
        self.four[:-2] |= self.four[2:] << np.uint16(8)

    def _at(self, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), U)
        for k in range(0, n, 4):
            out |= self.four[at + (BEHIND + k)].astype(U) << U(4 * k)
        return out

    def after(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """AHEAD characters from ``at`` on, of which so many are there; the first one is lowest."""
        gone = U(4) * (AHEAD - np.minimum(there, AHEAD)).astype(U)
        return np.where(there > 0, ~U(0) >> np.minimum(gone, U(63)), U(0)) & self._at(at, AHEAD)

    def before(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """BEHIND characters up to ``at``; the last one is highest."""
        gone = U(4) * (BEHIND - np.minimum(there, BEHIND)).astype(U)
        return self._at(at - BEHIND, BEHIND) >> gone << gone


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of each line of some texts: _k is 47 bits of the key and the length (up to LONG), _s1 the characters
    after its window and _s2 those before it, with place and salt at its end. What is over HOT_ROWS of one key in a task is
    dealt over salts, and a row of length 0 tells the others of that key."""
    often: dict[int, int] = {}
    seen = _Seen()
    for _, data, starts, lengths, _ in chunks(batches, READ_BYTES):
        lines = _Lines(data, starts, lengths)
        fuzzy = np.flatnonzero(lines.size >= FUZZY_CHARS)
        fuzzy = fuzzy[seen.first(lines.h1[fuzzy])]
        row, key, place, s1, s2 = _keys(
            lines.normal, lines.begin[fuzzy], lines.end[fuzzy] - lines.begin[fuzzy], _totals(lines.normal)
        )
        x, size, key = as_long(lines.h1[fuzzy])[row], lines.size[fuzzy][row], as_long(key) & KEY
        found, counts = np.unique(key, return_counts=True)
        hot = []
        for k, c in zip(found[counts >= HOT_BATCH].tolist(), counts[counts >= HOT_BATCH].tolist()):
            often[k] = often.get(k, 0) + c
            if often[k] > HOT_ROWS:
                hot.append(k)
        if len(often) > 1_000_000:
            often = {k: c for k, c in often.items() if c > HOT_ROWS}
        hot = np.array(hot, np.int64)
        salt = np.where(np.isin(key, hot), 1 + (x.view(U) % U(SALTS)).astype(np.int64), 0)
        none = np.zeros(len(hot), np.int64)
        yield pa.record_batch(
            [
                pa.array(np.concatenate((hot, key | np.minimum(size, LONG)))),
                pa.array(np.concatenate((none, x))),
                pa.array(np.concatenate((none, as_long(s1)))),
                pa.array(np.concatenate((none, as_long(s2) << 16 | place << SALT_BITS | salt))),
            ],
            ["_k", "_x", "_s1", "_s2"],
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as those of ``_entries`` for the lines of large keys, under finer keys: those that ``_parts`` lets go together
    share one, as they are in one or two neighbouring bands of lengths and cells of places."""
    for batch in batches:
        key, x, n, s1, s2 = (np.asarray(batch.column(batch.schema.names.index(c))) for c in ("_key", "_x", "_n", "_s1", "_s2"))
        step = (s2 & LONG) >> SALT_BITS
        free = (step == ANYWHERE) | (n == LONG)
        begin = (step + 0.5) * n / ANYWHERE
        band = np.floor(np.log(n) / np.log(BAND)).astype(np.int64)
        out = []
        for low in (band - 1, band):
            longest = BAND ** (low + 2.0)
            reach = 1 - EDIT_SIMILARITY + 2 / ANYWHERE + 1e-6
            cell = np.floor(begin / (reach * longest)).astype(np.int64)
            for k in range(-1, int(1 / reach) + 1):  # a line whose place says nothing is in all cells
                here = np.flatnonzero(free | (k == cell - 1) | (k == cell))
                out.append((here, mix(key[here].view(U) ^ mix((low[here] << 8 | k + 1).view(U)))))
        row, finer = (np.concatenate(v) for v in zip(*out))
        yield pa.record_batch(
            [pa.array(as_long(finer) & KEY | n[row]), pa.array(x[row]), pa.array(s1[row]), pa.array(s2[row] & ~SALT)],
            ["_k", "_x", "_s1", "_s2"],
        )


def _missed(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many pairs of neighbours among ``n`` characters of ``a`` are not in ``b`` within DRIFT places."""
    out = ~np.zeros(len(a), U)
    for by in range(-DRIFT, DRIFT + 1):
        differ = a ^ (b << U(4 * by) if by > 0 else b >> U(-4 * by))
        for bits in (1, 2, 4):
            differ |= differ >> U(bits)
        out &= differ
    return np.bitwise_count(out & U(0x1111111111111111 & (1 << 4 * (n - 1)) - 1))


def _joined(label: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``label``, the first place of the group of each place, when the groups of each edge are one."""
    a, b = (np.concatenate(e) for e in zip(*edges))
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label[a], label[b] = label[label[a]], label[label[b]]


def _groups(key: np.ndarray, n: np.ndarray, x: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """(leader, place) of the members of groups of two and more. Rows are sorted by key and length, so that each is compared
    with those after it while key and length allow and they are not known to be in one group; ``near`` tells which of the
    pairs of some rows go together."""
    label = np.arange(len(key))
    edges, held, at = [], 0, np.arange(len(key))
    most = n / EDIT_SIMILARITY + 1e-9
    for lag in range(1, len(key)):
        at = at[at + lag < len(key)]
        at = at[(key[at] == key[at + lag]) & ((n[at + lag] <= most[at]) | (n[at + lag] == LONG))]
        if not len(at):
            break
        apart = at[label[at] != label[at + lag]]
        kept = near(apart, apart + lag)
        edges.append((kept, kept + lag))
        held += len(kept)
        if held > PAIR_ROWS:
            label, edges, held = _joined(label, edges), [], 0
    if edges:
        label = _joined(label, edges)
    while (label[label] != label).any():
        label = label[label]
    place = np.flatnonzero(np.bincount(label, minlength=len(key))[label] > 1)
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, label, x)
    return least[label[place]], place


def _parts(key: np.ndarray, n: np.ndarray, x: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_groups`` of lines that share a window, the common key.

    A window that the edits of a line leave alone moves by no more than the edits before it, and what follows it changes
    its length by no more than the edits after it: beyond the edit bound, the two are not one window of similar lines. Nor
    are they where the characters beside the window differ more than MISSED tells.
    """
    step = (s2.view(np.int64) & LONG) >> SALT_BITS
    free = (step == ANYWHERE) | (n == LONG)  # a place says nothing
    begin = (step + 0.5) * n / ANYWHERE
    s2 = s2 >> U(16)

    def near(at, other):
        moved, longer = begin[other] - begin[at], n[other] - n[at]
        # each place is known to half a step
        most_moved = (1 - EDIT_SIMILARITY) * n[other] + (n[at] + n[other]) / ANYWHERE + 1e-9
        there = (np.abs(moved) + np.abs(longer - moved) <= most_moved) | free[at] | free[other]
        at, other = at[there], other[there]
        return at[_missed(s1[at], s1[other], AHEAD) + _missed(s2[at], s2[other], BEHIND) <= MISSED]

    return _groups(key, n, x, near)


def _alike(key: np.ndarray, n: np.ndarray, x: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_groups`` of lines whose fingerprints (s1, s2) differ in at most RADIUS bits."""

    def near(at, other):
        return at[np.bitwise_count(s1[at] ^ s1[other]) + np.bitwise_count((s2[at] ^ s2[other]) >> U(16)) <= RADIUS]

    return _groups(key, n, x, near)


def _candidates(batches: Iterator[pa.RecordBatch], parts=_parts, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Groups of each key: its rows stand together, sorted by length. A key of at most ``most`` lines, or BLOCK_ROWS, is settled
    here (_leader, _x, _n); the lines of larger ones go on as they are, with the key."""
    most = BLOCK_ROWS if most is None else most

    def settled(rows):
        leader, place = parts(rows[0], rows[2], rows[3], rows[4].view(U), rows[5].view(U))
        return out([None] * len(place), leader, rows[:, place], [None] * len(place), [None] * len(place))

    def large(rows):
        rows = rows[:, rows[2] > 0]
        return out(rows[0], rows[3], rows, rows[4], rows[5])

    def out(key, leader, rows, s1, s2):
        arrays = [pa.array(v, pa.int64()) for v in (key, leader, rows[3], rows[2], s1, s2)]
        return pa.record_batch(arrays, ["_key", "_leader", "_x", "_n", "_s1", "_s2"])

    held = np.zeros((6, 0), np.int64)
    passing = None
    for batch in batches:
        k, x, s1, s2 = (np.asarray(c) for c in batch.columns)
        rows = np.concatenate((held, np.stack((k & KEY, s2 & SALT, k & LONG, x, s1, s2))), axis=1)
        if not rows.shape[1]:
            continue
        # equal lines of several tasks are neighbours
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        rows = rows[:, new]
        cut = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        size = np.diff(np.append(cut, rows.shape[1]))
        # salted rows, those of a key with a mark, and too many are not settled here
        big = (rows[1, cut] > 0) | (rows[2, cut] == 0) | (size > most)
        big |= [tuple(rows[:2, cut[0]]) == passing] + [False] * (len(cut) - 1)
        last = cut[-1]
        passing = tuple(rows[:2, last]) if big[-1] else None
        if big.any():
            yield large(rows[:, np.repeat(big, size)])
        rest = ~np.repeat(big, size)
        rest[last:] = False
        if rest.any():
            yield settled(rows[:, rest])
        # of a large key one row is kept, to know its repeats; it may be given twice
        held = rows[:, -1:] if big[-1] else rows[:, last:]
    if held.shape[1] > 1 and passing is None:
        yield settled(held)


def _cell_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _candidates(batches, _parts, CELL_ROWS)


def _alike_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _candidates(batches, _alike, CELL_ROWS)


def _candidate_texts(marks):
    """(_x, _h2, _line_text, _s1, _s2) of the marked lines with their fingerprints, each once as far as a task remembers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        seen = _Seen()
        for _, data, starts, lengths, _ in chunks(batches, READ_BYTES):
            x = _Lines(data, starts, lengths)
            place = x.h1 & U(MARKS - 1)
            taken = (bits[(place >> U(5)).astype(np.int64)] >> (place & U(31)) & U(1)).astype(bool)
            taken = np.flatnonzero(taken & (x.size >= FUZZY_CHARS))
            taken = taken[seen.first(x.h1[taken])]
            buffer = x.normal.tobytes()
            lines = [buffer[i:j] for i, j in zip(x.begin[taken].tolist(), x.end[taken].tolist())]
            size = x.end[taken] - x.begin[taken]
            prints = fingerprints(np.frombuffer(b"".join(lines), np.uint8), np.cumsum(size) - size, size)
            texts = pa.array([line.decode(errors="replace") for line in lines], pa.string())
            yield pa.record_batch(
                [pa.array(as_long(x.h1[taken])), pa.array(as_long(x.h2[taken])), texts, *(pa.array(as_long(s)) for s in prints)],
                ["_x", "_h2", "_line_text", "_s1", "_s2"],
            )

    return read


def _marks(wanted: DataFrame):
    """A mark for each of MARKS remainders of the wanted lines, broadcast: it only saves texts that nobody needs
    from being shuffled, and says less the more lines there are."""
    place = F.col("_x").bitwiseAND(MARKS - 1)
    words = (
        wanted.select(F.shiftright(place, 5).cast("int").alias("_word"), place.bitwiseAND(31).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
        .toArrow()
    )
    bits = np.zeros(MARKS // 32, U)
    bits[np.asarray(words["_word"])] = np.asarray(words["_bits"]).view(U)
    return wanted.sparkSession.sparkContext.broadcast(bits)


def _with_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        text.alias("_text"),
        F.xxhash64(text).alias("_th"),
    )


def _read_lines(texts: DataFrame) -> DataFrame:
    return saved(
        texts.mapInArrow(
            _line_rows,
            "_id long, _th long, _line int, _h1 long, _h2 long, _size long",
        )
    )


def _settled(entries: DataFrame, find) -> DataFrame:
    """What ``find``, one of the functions around ``_candidates``, makes of ``entries``."""
    key, salt = F.shiftright("_k", 16), F.col("_s2").bitwiseAND(SALT)
    return saved(
        entries.repartition(key, salt)
        .sortWithinPartitions(key, salt, "_k", "_x")
        .mapInArrow(find, "_key long, _leader long, _x long, _n long, _s1 long, _s2 long")
    )


def _members(found: DataFrame) -> DataFrame:
    """(_leader, _x, _n) of all groups, those too large for a task as a whole."""
    large = found.filter("_key is not null")
    leaders = large.groupBy("_key").agg(F.min("_x").alias("_leader"))
    members = found.filter("_key is null").select("_leader", "_x", "_n")
    return members.union(large.drop("_leader").join(leaders, "_key").select("_leader", "_x", "_n"))


def _similar_lines(texts: DataFrame) -> DataFrame:
    """(_h1, _h2, _component) of the lines that are linked with others."""
    entry = "_k long, _x long, _s1 long, _s2 long"
    found = _settled(texts.select("_id", "_text").mapInArrow(_entries, entry), _candidates)
    cells = _settled(found.filter("_key is not null").mapInArrow(_cells, entry), _cell_candidates)
    members = found.filter("_key is null").select("_leader", "_x", "_n")
    members = saved(members.union(_members(cells)).distinct())
    # a group whose leader belongs to another joins it: one line of many groups would travel with its text for each
    under = members.filter("_leader < _x").groupBy(F.col("_x").alias("_leader")).agg(F.min("_leader").alias("_top"))
    members = saved(
        members.join(under.hint("merge"), "_leader", "left")
        .select(F.coalesce("_top", "_leader").alias("_leader"), "_x", "_n")
        .distinct()
    )
    wanted = members.select("_x").distinct()
    # two lines of one 64-bit hash: the one of the smaller second hash takes part
    payload = saved(
        texts.select("_id", "_text")
        .mapInArrow(_candidate_texts(_marks(wanted)), "_x long, _h2 long, _line_text string, _s1 long, _s2 long")
        .join(wanted.hint("merge"), "_x", "left_semi")
        .groupBy("_x")
        .agg(F.min(F.struct("_h2", "_line_text", "_s1", "_s2")).alias("_l"))
        .select("_x", "_l.*")
    )
    prints = members.join(payload.select("_x", "_s1", "_s2").hint("merge"), "_x").select(
        F.xxhash64("_leader").bitwiseAND(KEY).bitwiseOR(F.col("_n")).alias("_k"), "_x", "_s1", "_s2"
    )
    members = saved(_members(_settled(prints, _alike_candidates)).distinct())
    blocks = met_in_blocks(members, payload.select("_x", "_line_text"))
    label = components(blocks.mapInArrow(linked_lines, "a long, b long"))
    return payload.select(F.col("_x").alias("_h1"), "_h2").join(
        label.select(F.col("node").alias("_h1"), F.col("component").alias("_component")), "_h1"
    )


def repeated_lines(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The lines to drop: (_id, _th, _drop array<int>), line numbers from 0, for documents that
    have any; _th is xxhash64 of the text, so rows with one id and different texts differ."""
    lines = rows.filter("_line >= 0")
    nodes = lines.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_th", "_line")).alias("_first"), F.count("*").alias("_m"))
    groups = saved(
        nodes.join(_similar_lines(texts).hint("merge"), ["_h1", "_h2"], "left").filter("_m > 1 or _component is not null")
    )
    firsts = groups.filter("_component is not null").groupBy("_component").agg(F.min("_first").alias("_least"))
    keep = groups.join(firsts, "_component", "left").select("_h1", "_h2", F.coalesce("_least", "_first").alias("_keep"))
    return (
        lines.select("_id", "_th", "_line", "_h1", "_h2")
        .join(keep, ["_h1", "_h2"])
        .filter(F.struct("_id", "_th", "_line") > F.col("_keep"))
        .groupBy("_id", "_th")
        .agg(F.sort_array(F.collect_set("_line")).alias("_drop"))
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_lines, n_dropped, dropped) for each row of ``docs``: the lines of the
    text (null or empty: none), how many of them repeat an earlier line, and their numbers."""
    texts = _with_hash(docs, id_col, text_col)
    read = _read_lines(texts)
    drop = repeated_lines(texts, read)
    rows = read.filter("_line < 0").select("_id", "_th", F.col("_size").alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(drop, ["_id", "_th"], "left").select(
        given_id().alias("doc_id"),
        "n_lines",
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("_drop", none).alias("dropped"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all other columns as they are.

    Blank lines always stay. A null text stays null. Rows that are
    repeated as a whole lose the same lines, none to each other: they are one document.
    A document whose lines all go keeps its row with an empty text. Null ids count as the
    smallest id. An empty table gives an empty result.
    """
    texts = _with_hash(docs, id_col, text_col)
    drop = repeated_lines(texts, _read_lines(texts))
    own = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("_th"),
    )
    text = F.col("_row")[text_col]
    # the outer array binds the lines once
    cut = F.expr(
        f"transform(array(split(_row.`{text_col}`, '\\n', -1)), l -> array_join("
        f"transform(array_except(sequence(0, size(l) - 1), _drop), i -> l[i]), '\\n'))[0]"
    )
    joined = own.join(drop.hint("merge"), ["_id", "_th"], "left")
    return joined.select(
        *(
            (F.when(F.col("_drop").isNull(), text).otherwise(cut) if c == text_col else F.col("_row")[c]).alias(c)
            for c in docs.columns
        )
    )
