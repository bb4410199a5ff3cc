"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, so every context (the last 0 to DEPTH bytes) holds a binary
tree of 255 nodes, and every node counts its zeros and ones in the training texts. A node's
probability of its training bits is the mean of its own Krichevsky-Trofimov estimate and of
the product over the contexts one byte longer. That fixes, for each node, the weight of
stopping at it; a byte's probability is the product over its bits of the estimates
of all depths, mixed by these weights along the context.

A byte's chance hangs on the DEPTH bytes before it alone, so it is worked out once for every distinct
gram, DEPTH bytes and the byte, from the nodes of all contexts: those of SHORT bytes are few (the bytes bound
them, not the texts) and go to all tasks, longer ones meet their grams in an exchange. The most frequent
grams, at most HELD of them, go to the scoring tasks, and all others are joined. Words of the base
score do the same: those with one in HEAVY of the training tokens, at most HEAVY of them, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import NULL_ID, given_id, saved
from tidemark.llm.textbytes import Words, as_long, chunks, list_array

U = np.uint64
DEPTH = 4
#: None: the model has every context; a number: on request a smaller model, without the contexts that have less
#: than one in so many of the training bytes
CONTEXTS = None
#: contexts of up to so many bytes go to all tasks; a group of longer ones has SHORT + 1 bytes in common
SHORT = 2
HEAVY, HELD = 500_000, 1_000_000
#: the token that ends each text
END = np.uint64(0x7E57E7D0C0FFEE11)
WORD, GRAM = 0, 1
_CHUNK = 1_000_000
#: rows of nodes and grams that are worked on at once, and the rest of their last group
_ROWS = 4_000


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts."""
    values = np.sort(values)
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return values[cut], np.diff(np.append(cut, len(values)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[cut], np.add.reduceat(counts, cut)


def _padded(data, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The texts with DEPTH zero bytes before each, and the places of their bytes."""
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1) * DEPTH, lengths)
    out = np.zeros(len(data) + DEPTH * len(lengths), np.uint8)
    out[place] = data
    return out, place


def _grams(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each place and its byte, which is lowest."""
    gram = np.zeros(len(place), U)
    for back in range(DEPTH, -1, -1):
        gram = gram << U(8) | padded[place - back]
    return gram


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word and gram counts of training texts, merged over all a task reads so far; grams of the texts that
    are held out are listed with nothing."""
    parts = {WORD: [], GRAM: []}
    held = {WORD: 0, GRAM: 0}

    def emit(kind):
        keys, counts = _merged(parts[kind])
        parts[kind], held[kind] = [], 0
        return pa.record_batch(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
            ["_kind", "_key", "_c"],
        )

    for ids, data, starts, lengths, batch in chunks(batches, _CHUNK):
        trains = ~np.asarray(batch.column(batch.schema.names.index("_held")).to_numpy(zero_copy_only=False)).astype(bool)
        words = Words(data, starts, lengths)
        gram, of = _grams(*_padded(data, starts, lengths)), np.repeat(trains, lengths)
        tokens = np.concatenate((words.hash[trains[words.doc]], np.full(trains.sum(), END)))
        for kind, values, counted in ((WORD, tokens, 1), (GRAM, gram[of], 1), (GRAM, gram[~of], 0)):
            if len(values):
                keys, counts = _runs(values)
                parts[kind].append((keys, counts * counted))
                held[kind] += len(keys)
            if held[kind] > 2_000_000:
                merged = _merged(parts[kind])
                parts[kind], held[kind] = [merged], len(merged[0])
                if held[kind] > 1_000_000:
                    yield emit(kind)
    for kind in (WORD, GRAM):
        if parts[kind]:
            yield emit(kind)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, stepped down; x of 0.5 or more."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def _log_kt(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - 1.1447298858494002 - _log_gamma(a + b + 1.0)


def weighted_nodes(grams: DataFrame, least: int) -> list[DataFrame]:
    """Per depth the nodes (_context, _node, _kt, _go) of contexts with ``least`` training bytes or
    more: the estimate of a one, and the weight of going on to longer contexts at the node.

    ``grams`` has (_key, _c): DEPTH context bytes and the byte, the byte lowest.
    """
    bits = F.expr(
        "transform(sequence(0, 7), k -> struct(cast(shiftleft(1, k) + shiftright(cast(_key & 255 as int), 8 - k) as int) as node, "
        "cast(shiftright(cast(_key & 255 as int), 7 - k) & 1 as int) as bit))"
    )
    level = (
        grams.select(F.shiftright("_key", 8).alias("_context"), "_c", F.explode(bits).alias("_b"))
        .groupBy("_context", F.col("_b.node").alias("_node"))
        .agg(
            F.sum(F.col("_c") * (1 - F.col("_b.bit"))).alias("_a"),
            F.sum(F.col("_c") * F.col("_b.bit")).alias("_o"),
        )
        .withColumn("_below", F.lit(None).cast("double"))
    )
    half = float(np.log(0.5))
    out = []
    for depth in range(DEPTH, -1, -1):
        own = half + _log_kt(F.col("_a"), F.col("_o"))
        if depth == DEPTH:
            level = level.withColumn("_own", _log_kt(F.col("_a"), F.col("_o"))).withColumn("_all", F.col("_own"))
        else:
            level = level.withColumn("_own", own)
            high = F.greatest("_own", F.col("_below") + half)
            low = F.least("_own", F.col("_below") + half)
            level = level.withColumn("_all", high + F.log1p(F.exp(low - high)))
        level = saved(level)
        kept = level
        if least > 1:  # the first node of a context has all its bytes
            kept = level.join(level.filter(f"_node = 1 and _a + _o >= {least}").select("_context"), "_context")
        out.append(
            kept.select(
                "_context",
                F.col("_node").cast("short").alias("_node"),
                ((F.col("_o") + 0.5) / (F.col("_a") + F.col("_o") + 1.0)).alias("_kt"),
                F.coalesce(F.exp(F.col("_below") + half - F.col("_all")), F.lit(0.0)).cast("float").alias("_go"),
            )
        )
        if depth:
            shorter = F.col("_context").bitwiseAND((1 << 8 * (depth - 1)) - 1)
            level = level.groupBy(shorter.alias("_context"), "_node").agg(
                F.sum("_a").alias("_a"), F.sum("_o").alias("_o"), F.sum("_all").alias("_below")
            )
    return out[::-1]


#: contexts, and for them by node: the part of a one's chance that shorter contexts give, the weight that they leave,
#: the own estimate, and the weight of going on
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_NONE: Level = (np.zeros(0, np.int64), np.zeros((1, 256)), np.ones((1, 256)), np.zeros((0, 256)), np.zeros((0, 256)))


def _left(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """What a context hands to the longer ones: the part given so far and the weight left."""
    _, mixed, free, kt, go = level
    return mixed + free * (1 - go) * kt, free * go


def _longer(shorter: np.ndarray, mixed: np.ndarray, free: np.ndarray, depth: int, nodes) -> Level:
    """The contexts of a depth, given the ``shorter`` ones and what they hand on; ``nodes`` has _context, _node, _kt, _go."""
    found, row = np.unique(np.asarray(nodes["_context"]), return_inverse=True)
    if depth:  # a context's bytes: the latest is lowest, so the shorter context is the lower part
        parent = np.searchsorted(shorter, found & ((1 << 8 * (depth - 1)) - 1))
        mixed, free = mixed[parent], free[parent]
    kt, go = np.full((2, len(found), 256), 0.5)
    node = np.asarray(nodes["_node"]).astype(np.int64)
    kt[row, node] = np.asarray(nodes["_kt"])
    go[row, node] = np.asarray(nodes["_go"])
    return found, mixed, free, kt, go


class Model:
    """Tables of the contexts of the first depths: ``step[d]`` leads from a state of depth d and the byte before it
    to a state of depth d + 1 (or -1), ``logs[state]`` has log10 of the chance of each byte where no longer
    context is known; ``last`` has the contexts of the last depth and what they hand to longer ones."""

    def __init__(self, nodes: list[pa.Table]):
        size = [0]
        for table in nodes:
            size.append(size[-1] + len(np.unique(np.asarray(table["_context"]))))
        self.logs = np.empty((max(1, size[-1]), 256), np.float32)
        self.step = []
        level, given = _NONE, _NONE[1:3]
        for depth, table in enumerate(nodes):
            shorter = level[0]
            level = _longer(shorter, *given, depth, table)
            found, mixed, free, kt, _ = level
            if depth:
                parent = np.searchsorted(shorter, found & ((1 << 8 * (depth - 1)) - 1))
                step = np.full((max(1, len(shorter)), 256), -1, np.int32)
                step[parent, found >> 8 * (depth - 1)] = np.arange(len(found))
                self.step.append(step)
            if len(found):  # where no longer context is known, all the weight that is left stops
                self.logs[size[depth] : size[depth + 1]] = self._bytes(mixed + free * kt)
            given = _left(level)
        if not size[-1]:  # no training text
            self.logs[0] = -8 * np.log10(2)
        self.first = size[:-1]
        self.last = (level[0], *(x.astype(np.float32) for x in given))

    @staticmethod
    def _bytes(one: np.ndarray) -> np.ndarray:
        byte = np.arange(256)
        out = np.zeros((len(one), 256))
        for k in range(8):
            node = (1 << k) | byte >> (8 - k)
            bit = byte >> (7 - k) & 1
            p = one[:, node]
            out += np.log10(np.where(bit, p, 1 - p))
        return out.astype(np.float32)

    def tables(self) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
        return self.logs, self.step, self.first


def byte_logs(tables: tuple[np.ndarray, list[np.ndarray], list[int]], gram: np.ndarray) -> np.ndarray:
    """log10 of the chance of the last byte of each gram by the contexts in ``tables``."""
    logs, steps, first = tables
    state = np.zeros(len(gram), np.int64)
    row = np.zeros(len(gram), np.int64)
    going = np.ones(len(gram), bool)
    for depth, step in enumerate(steps):
        state = step[np.where(going, state, 0), gram >> 8 * (depth + 1) & 255]
        going &= state >= 0
        row = np.where(going, first[depth + 1] + state, row)
    return logs[row, gram & 255]


def _chances(model):
    """(_key, _log) of the grams among rows of contexts longer than SHORT and grams, which stand by common bytes."""

    def logs(part: pa.Table) -> pa.RecordBatch:
        short, level = model.value
        kind = np.asarray(part["_kind"])
        gram = np.asarray(part["_context"])[kind > DEPTH]
        out = byte_logs(short, gram).astype(np.float64)
        for depth in range(SHORT + 1, DEPTH + 1):
            found, mixed, free, kt, _ = now = _longer(*level, depth, part.filter(pa.array(kind == depth)))
            level = (found, *_left(now))
            if not len(found):
                break
            context = gram >> 8 & ((1 << 8 * depth) - 1)
            row = np.minimum(np.searchsorted(found, context), len(found) - 1)
            at = np.flatnonzero(found[row] == context)
            one, byte = mixed + free * kt, gram[at] & 255
            out[at] = 0.0
            for k in range(8):
                p = one[row[at], (1 << k) | byte >> (8 - k)]
                out[at] += np.log10(np.where(byte >> (7 - k) & 1, p, 1 - p))
        return pa.record_batch([pa.array(gram), pa.array(out)], ["_key", "_log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n < _ROWS:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            group = np.asarray(part["_group"])
            cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1)]  # whole groups; the last may go on
            at = 0
            while cut[-1] - at > 0:
                end = cut[max(np.searchsorted(cut, at + _ROWS, "right") - 1, np.searchsorted(cut, at, "right"))]
                yield logs(part.slice(at, end - at).combine_chunks())
                at = end
            held = part.slice(at).combine_chunks().to_batches()
            n = len(part) - at
        if n:
            yield logs(pa.Table.from_batches(held).combine_chunks())

    return run


def gram_logs(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(_key, _log) for each of the distinct ``grams`` (_key): log10 of the chance of its last byte, given all the
    contexts in ``nodes``. A group of rows that a task holds has SHORT + 1 bytes in common, so that its size is bounded."""
    short = Model([x.toArrow() for x in nodes[: SHORT + 1]])
    model = grams.sparkSession.sparkContext.broadcast((short.tables(), short.last))
    none = F.lit(None)
    rows = grams.select(
        F.lit(DEPTH + 1).alias("_kind"),
        F.col("_key").alias("_context"),
        none.cast("short").alias("_node"),
        none.cast("double").alias("_kt"),
        none.cast("float").alias("_go"),
        F.shiftright("_key", 8).alias("_four"),
    )
    for depth in range(SHORT + 1, DEPTH + 1):
        own = nodes[depth].select(F.lit(depth).alias("_kind"), "_context", "_node", "_kt", "_go", F.col("_context").alias("_four"))
        rows = rows.union(own)
    group = F.col("_four").bitwiseAND((1 << 8 * (SHORT + 1)) - 1)
    return saved(
        rows.withColumn("_group", group)
        .drop("_four")
        .repartition("_group")
        .sortWithinPartitions("_group")
        .mapInArrow(_chances(model), "_key long, _log double")
    )


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their logs (else 0)."""
    have, logs = table
    if not len(have):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    known = have[at] == keys
    return known, np.where(known, logs[at], 0.0)


def _score(heavy):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_held, grams_held = heavy.value
        row = TaskContext.get().partitionId() << 40
        for ids, data, starts, lengths, batch in chunks(batches, _CHUNK):
            words = Words(data, starts, lengths)
            is_heavy, value = _found(words_held, words.hash)
            base = np.bincount(words.doc, value, len(ids))
            known = np.bincount(words.doc, is_heavy, len(ids)).astype(np.int64)
            # distinct words of each text that are not held, with their counts
            rest = np.flatnonzero(~is_heavy)
            order = rest[np.lexsort((words.hash[rest], words.doc[rest]))]
            h, d = words.hash[order], words.doc[order]
            cut = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, int)
            # distinct grams of each text: a gram has 40 bits, the number of the text is below
            gram = _grams(*_padded(data, starts, lengths)) << U(24) | np.repeat(np.arange(len(ids), dtype=U), lengths)
            gram, times = _runs(gram)
            gram, of = gram >> U(24), (gram & U(0xFFFFFF)).astype(np.int64)
            is_held, value = _found(grams_held, gram)
            rest = ~is_held
            doc = np.concatenate((d[cut], of[rest]))
            order = np.argsort(doc, kind="stable")
            per_doc = np.bincount(doc, minlength=len(ids))
            kinds = np.repeat(np.array([WORD, GRAM], np.int8), [len(cut), rest.sum()])
            yield pa.record_batch(
                [
                    pa.array(row + np.arange(len(ids))),
                    pa.array(ids),
                    batch.column(batch.schema.names.index("_held")),
                    pa.array(words.counts.astype(np.int64) + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(np.bincount(of, value * times, len(ids)).astype(np.float64)),
                    list_array(kinds[order], per_doc),
                    list_array(as_long(np.concatenate((h[cut], gram[rest]))[order]), per_doc),
                    list_array(np.concatenate((np.diff(np.append(cut, len(h))), times[rest]))[order].astype(np.int32), per_doc),
                ],
                ["_row", "_id", "_held", "_tokens", "_known", "_base", "_score", "_kinds", "_rare", "_times"],
            )
            row += len(ids)

    return score


def _most_frequent(grams: DataFrame) -> int:
    """The count from which on grams are held: at most HELD have it."""
    powers = grams.filter("_c > 0").groupBy((F.length(F.bin("_c")) - 1).alias("_p")).agg(F.count("*").alias("_n")).collect()
    total, least = 0, 2**62
    for p, n in sorted(powers, reverse=True):
        total += n
        if total > HELD:
            break
        least = 2**p
    return least


def _sorted_table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.select("_key", "_log").toArrow()
    keys, logs = np.asarray(table["_key"]).view(U), np.asarray(table["_log"])
    order = np.argsort(keys)
    return keys[order], logs[order]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 of the model's chance of the text).

    Texts with crc32(doc_id as text) mod 10 = 0 are held out; all others train. Tokens are words, A-Z
    lower-cased, and one end. base_score is the sum over the tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))).

    A null or empty text has its end token only and score 0. A null id counts as the empty text in the hash and
    stays null. Repeated rows train and are scored each. Other columns are not read. Without
    training texts every bit is even. An empty table gives an empty result.
    """
    text = docs[text_col].cast("string")
    held = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % 10 == 0
    texts = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("_id"),
        held.alias("_held"),
        text.alias("_text"),
    )
    counts = saved(
        texts.mapInArrow(_count, "_kind int, _key long, _c long").groupBy("_kind", "_key").agg(F.sum("_c").alias("_c"))
    )
    vocabulary = counts.filter(f"_kind = {WORD}").select("_key", "_c")
    grams = counts.filter(f"_kind = {GRAM}").select("_key", "_c")
    v, n = vocabulary.agg(F.count("*"), F.coalesce(F.sum("_c"), F.lit(0))).first()
    least = 1
    if CONTEXTS is not None:
        least = max(1, -(-grams.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0] // CONTEXTS))
    chances = gram_logs(grams.select("_key"), weighted_nodes(grams.filter("_c > 0"), least))
    from_on = _most_frequent(grams)
    held_grams = chances.join(grams.filter(F.col("_c") >= from_on), "_key")
    norm = n + 0.1 * (v + 1)
    # at most HEAVY words have one in HEAVY of all tokens
    logs = vocabulary.select("_key", "_c", F.log10((F.col("_c") + 0.1) / F.lit(norm)).alias("_log"))
    tables = (_sorted_table(logs.filter(F.col("_c") * HEAVY >= n)), _sorted_table(held_grams))
    heavy = docs.sparkSession.sparkContext.broadcast(tables)
    scored = saved(
        texts.mapInArrow(
            _score(heavy),
            "_row long, _id long, _held boolean, _tokens long, _known long, _base double, _score double, "
            "_kinds array<tinyint>, _rare array<long>, _times array<int>",
        )
    )
    rare = scored.select("_row", F.explode(F.arrays_zip("_kinds", "_rare", "_times")).alias("_w")).select(
        "_row", F.col("_w._kinds").alias("_kind"), F.col("_w._rare").alias("_key"), F.col("_w._times").alias("_times")
    )
    light = logs.filter(F.col("_c") * HEAVY < n).select(F.lit(WORD).cast("tinyint").alias("_kind"), "_key", "_log")
    light = light.union(
        chances.join(grams.filter(F.col("_c") < from_on), "_key").select(F.lit(GRAM).cast("tinyint"), "_key", "_log")
    )
    new = float(np.log10(0.1 / norm))
    word = F.col("_kind") == WORD
    added = (
        rare.join(light, ["_kind", "_key"], "left")
        .groupBy("_row")
        .agg(
            F.sum(F.when(word, F.col("_times") * F.coalesce("_log", F.lit(new)))).alias("_more"),
            F.sum(F.when(word & F.col("_log").isNotNull(), F.col("_times"))).alias("_found"),
            F.sum(F.when(~word, F.col("_times") * F.col("_log"))).alias("_gram_logs"),
        )
    )
    ends = vocabulary.filter(F.col("_key") == int(END.view(np.int64))).select("_c").first()
    end = ends[0] if ends else 0
    return scored.join(added, "_row", "left").select(
        given_id().alias("doc_id"),
        F.col("_held").alias("held_out"),
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_found", F.lit(0)) + int(end > 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0)) + float(np.log10((end + 0.1) / norm))).alias("base_score"),
        (F.col("_score") + F.coalesce("_gram_logs", F.lit(0.0))).alias("score"),
    )
