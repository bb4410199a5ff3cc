"""Benchmark decontamination: SimHash of item-sized windows, then weighted shingles.

Every window of a document that is as long as a benchmark item is a candidate of the items
of that length; a document shorter than an item is one window. Windows with too few of the items' words are cut off first, by a bound that
no match can miss. The rest get a 64-bit SimHash over their words; each item's fingerprint
is cut into four 16-bit blocks, and every block value with up to ERRORS = 3 wrong bits is
marked. Fingerprints within RADIUS = 4 * (ERRORS + 1) - 1 bits share a marked block, so none
is missed. A window within the radius is compared with the item itself:
weighted Jaccard similarity of five-word shingles. Of the N items df hold a shingle of the item, which
weighs ln(1 + N / df); what only the window holds weighs ln(1 + N).

N and df are those of the whole benchmark, so it does not matter in how many passes it is searched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lines import simhash
from tidemark.llm.scratch import given_id, id_and_text, saved
from tidemark.llm.textbytes import PUNCTUATED, Words, bytes_of, chunks, shingles, window_hash

U = np.uint64
SHINGLE = 5
_ONES = U(0x0101010101010101)
SIMILARITY = 0.8
ERRORS = 3
RADIUS = 4 * (ERRORS + 1) - 1
#: items and bytes of text in one pass over the documents; a larger benchmark makes more passes
PASS_ITEMS, PASS_BYTES = 20_000, 8_000_000


#: all 16-bit numbers with up to ERRORS bits set
_WRONG = np.array([sum(1 << b for b in c) for k in range(ERRORS + 1) for c in combinations(range(16), k)], np.int64)


class Items:
    """The items of one pass, by number of words: fingerprints, shingles, block tables."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, counted: tuple[int, np.ndarray, np.ndarray] | None = None):
        """``counted``: number of items of all passes, shingles of this pass (sorted), items that hold each."""
        self.sizes = {}
        if not len(ids):
            return
        words, sets = _item_sets(texts)
        if counted is None:
            self.shingle, df = np.unique(np.concatenate(sets), return_counts=True)
            self.items = len(sets)
        else:
            self.items, self.shingle, df = counted
        self.weight, self.alone = np.log1p(self.items / df), np.log1p(self.items)
        self.words = np.unique(words.hash)
        self.common = np.zeros(1 << 16, bool)
        self.common[(self.words & U(0xFFFF)).astype(np.int64)] = True
        starts = np.cumsum(words.counts) - words.counts
        full = np.flatnonzero(words.counts)
        prints = dict(zip(full, simhash(words.hash, starts[full], words.counts[full])))
        by_size = defaultdict(list)
        for k in full:
            by_size[int(words.counts[k])].append(k)
        for size, members in by_size.items():
            marked = np.zeros((4, 1 << 16), bool)
            for k in members:
                for b in range(4):
                    marked[b, (int(prints[k]) >> 16 * b & 0xFFFF) ^ _WRONG] = True
            self.sizes[size] = (
                marked,
                np.array([prints[k] for k in members], U),
                [(int(ids[k]), sets[k], self.weights(sets[k]).sum()) for k in members],
                min(self._fewest(sets[k]) for k in members),
            )

    def weights(self, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingle, values), len(self.shingle) - 1)
        return np.where(self.shingle[at] == values, self.weight[at], self.alone)

    def _fewest(self, values: np.ndarray) -> int:
        """Distinct shingles of an item that a window must hold to be similar enough."""
        heavy = np.cumsum(np.sort(self.weights(values))[::-1])
        return int(np.searchsorted(heavy, SIMILARITY * heavy[-1] * (1 - 1e-9))) + 1

    def known(self, hashes: np.ndarray) -> np.ndarray:
        out = self.common[(hashes & U(0xFFFF)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
        out[maybe] = self.words[at] == hashes[maybe]
        return out

    def similarity(self, window: np.ndarray, item: np.ndarray, weight: float) -> float:
        both = np.intersect1d(window, item, assume_unique=True)
        return float(self.weights(both).sum() / (weight + (len(window) - len(both)) * self.alone))

    def hits(self, words: Words) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(text, item id) -> (best similarity, first word, words)."""
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        total = len(words.hash)
        if not total or not self.sizes:
            return out
        known = np.concatenate(([0], np.cumsum(self.known(words.hash), dtype=np.int32)))
        text_start = np.cumsum(words.counts) - words.counts
        prints_of = WindowPrints(words.hash)
        per_width = {}
        for size, (marked, prints, members, fewest) in self.sizes.items():
            self._short_hits(words, text_start, known, size, out)
            if size > total:
                continue
            width = min(size, SHINGLE)
            if width not in per_width:
                whole = known[width:] - known[:-width] == width
                value = window_hash(words.hash, np.arange(total), np.full(total, width), SHINGLE)
                per_width[width] = np.concatenate(([0], np.cumsum(whole, dtype=np.int32))), value
            run, value = per_width[width]
            span = size - width + 1
            begin = np.flatnonzero(run[span:] - run[:-span] >= fewest)
            begin = begin[words.doc[begin] == words.doc[begin + size - 1]]
            if not len(begin):
                continue
            found = prints_of.windows(begin, size)
            near = np.zeros(len(begin), bool)
            for b in range(4):
                near |= marked[b, (found >> U(16 * b) & U(0xFFFF)).astype(np.int64)]
            begin, found = begin[near], found[near]
            for k in range(len(prints)):
                item, values, weight = members[k]
                at = begin[np.bitwise_count(found ^ prints[k]) <= RADIUS]
                for low in range(0, len(at), 10_000):
                    part = at[low : low + 10_000]
                    window = value[part[:, None] + np.arange(span)]
                    place = np.minimum(np.searchsorted(values, window), len(values) - 1)
                    # what is common to both, repeats counted again: below the bound for no match
                    common = np.where(values[place] == window, self.weights(values)[place], 0.0).sum(axis=1)
                    for first_word in part[common >= SIMILARITY * weight * (1 - 1e-9)]:
                        own = np.unique(value[first_word : first_word + span])
                        score = self.similarity(own, values, weight)
                        doc = int(words.doc[first_word])
                        first = int(first_word - text_start[doc])
                        best = out.get((doc, item), (0.0, 0, 0))
                        if score >= SIMILARITY and (score, -first) > (best[0], -best[1]):
                            out[doc, item] = (score, first, size)
        return out

    def _short_hits(self, words: Words, text_start: np.ndarray, known: np.ndarray, size: int, out: dict) -> None:
        """Texts with fewer words than the items of ``size``, each as one window."""
        marked, prints, members, fewest = self.sizes[size]
        n = words.counts
        short = np.flatnonzero((n < size) & (n >= SHINGLE) & (n - SHINGLE + 1 >= fewest))
        # distinct shared shingles need as many shared words, one more for each of the first four
        short = short[known[text_start[short] + n[short]] - known[text_start[short]] >= fewest]
        if not len(short):
            return
        found = simhash(words.hash, text_start[short], n[short])
        near = np.zeros(len(short), bool)
        for b in range(4):
            near |= marked[b, (found >> U(16 * b) & U(0xFFFF)).astype(np.int64)]
        for doc, fingerprint in zip(short[near].tolist(), found[near]):
            begin = text_start[doc] + np.arange(n[doc] - SHINGLE + 1)
            window = np.unique(window_hash(words.hash, begin, np.full(len(begin), SHINGLE), SHINGLE))
            for k in np.flatnonzero(np.bitwise_count(prints ^ fingerprint) <= RADIUS).tolist():
                item, values, weight = members[k]
                score = self.similarity(window, values, weight)
                if score >= SIMILARITY and score > out.get((doc, item), (0.0,))[0]:
                    out[doc, item] = (score, 0, int(n[doc]))


def _item_sets(texts: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """The words of items and the distinct shingles of each."""
    data, offsets = bytes_of(texts)
    words = Words(data, offsets[:-1] - offsets[0], np.diff(offsets), PUNCTUATED)
    values, windows = shingles(words, SHINGLE)
    return words, [np.unique(s) for s in np.split(values, np.cumsum(windows)[:-1])]


class WindowPrints:
    """SimHash of windows of words from running sums, eight 8-bit counters in each number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.sums = []
        for k in range(8):
            total = np.zeros(len(hashes) + 1, U)
            np.cumsum((hashes >> U(k)) & _ONES, out=total[1:])
            self.sums.append(total)

    def windows(self, begin: np.ndarray, size: int) -> np.ndarray:
        if size > 250:
            return simhash(self.hashes, begin, np.full(len(begin), size))
        out = np.zeros(len(begin), U)
        # a counter above half of size sets the top bit of its byte
        lift = U(127 - size // 2) * _ONES
        for k, total in enumerate(self.sums):
            counters = total[begin + size] - total[begin]
            out |= ((counters + lift) & (_ONES << U(7))) >> U(7 - k)
        return out


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            names = batch.schema.names
            _, sets = _item_sets(batch.column(names.index("_text")))
            slices = np.repeat(np.asarray(batch.column(names.index("_slice"))), [len(x) for x in sets])
            yield pa.record_batch([pa.array(slices), pa.array(np.concatenate(sets).view(np.int64))], ["_slice", "_hash"])


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcast (items, their shingles counted over the whole benchmark or None), in slices of a bounded size."""
    items = id_and_text(benchmark, item_col, text_col)
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    slices = max(1, -(-n // PASS_ITEMS), -(-size // PASS_BYTES))
    context = benchmark.sparkSession.sparkContext
    if slices == 1:
        return [context.broadcast((items.toArrow(), None))]
    items = items.withColumn("_slice", F.pmod(F.xxhash64("_id", "_text"), F.lit(slices)))
    held = items.select("_slice", "_text").mapInArrow(_shingles_of, "_slice long, _hash long")
    df = held.groupBy("_hash").agg(F.count("*").alias("_df"))
    counted = saved(held.distinct().join(df, "_hash"))
    out = []
    for k in range(slices):
        own = counted.filter(F.col("_slice") == k).toArrow()
        hashes, df_of = np.asarray(own["_hash"].combine_chunks()).view(U), np.asarray(own["_df"].combine_chunks())
        order = np.argsort(hashes)
        part = items.filter(F.col("_slice") == k).drop("_slice").toArrow()
        out.append(context.broadcast((part, (n, hashes[order], df_of[order]))))
    return out


def _items(sent: tuple) -> Items:
    part = sent[0].combine_chunks().sort_by("_id")
    return Items(np.asarray(part["_id"]), part["_text"].combine_chunks(), sent[1])


def _find(broadcast):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _items(broadcast.value)
        for ids, data, starts, lengths, _ in chunks(batches):
            hits = sorted(index.hits(Words(data, starts, lengths, PUNCTUATED)).items())
            yield pa.record_batch(
                [
                    pa.array([int(ids[doc]) for (doc, _), _ in hits], pa.int64()),
                    pa.array([item for (_, item), _ in hits], pa.int64()),
                    pa.array([x[0] for _, x in hits], pa.float64()),
                    pa.array([x[1] for _, x in hits], pa.int64()),
                    pa.array([x[2] for _, x in hits], pa.int64()),
                ],
                ["_id", "_item", "similarity", "first_word", "n_words"],
            )

    return find


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document
    for each item it contains with weighted similarity SIMILARITY or more; ties: the first. A document with
    fewer words than the item is compared as a whole.

    Null and empty texts and items without words match nothing. Null ids stay null. Rows that
    are repeated give repeated pairs; items that are repeated give one pair for each id.
    Either table may be empty; the result then is.
    """
    texts = id_and_text(docs, id_col, text_col)
    schema = "_id long, _item long, similarity double, first_word long, n_words long"
    found = None
    for part in _passes(benchmark, item_col, item_text_col):
        pairs = texts.mapInArrow(_find(part), schema)
        found = pairs if found is None else found.union(pairs)
    return found.select(
        given_id().alias("doc_id"), given_id("_item").alias("item_id"), "similarity", "first_word", "n_words"
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item (as in contaminated_pairs); all
    columns stay as they are. Decided row by row against the broadcast items: no shuffle."""
    place = docs.columns.index(text_col)

    def clean(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _items(broadcast.value)
            for batch in batches:
                text = batch.column(place)
                pair = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), text], ["_id", "_text"])
                keep = np.ones(batch.num_rows, bool)
                for ids, data, starts, lengths, _ in chunks([pair]):
                    for doc, _ in index.hits(Words(data, starts, lengths, PUNCTUATED)):
                        keep[ids[doc]] = False
                yield batch.filter(pa.array(keep))

        return run

    for part in _passes(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(clean(part), docs.schema)
    return docs
