"""Token counts: greedy longest-match word pieces by a linear automaton.

The pieces of a vocabulary make a trie over bytes. A failure link leads from a node to the
node where matching goes on once the longest pieces at the front of the read bytes are taken
off, and the number of pieces taken off is kept with it; so a word is counted in time linear
in its bytes, and no piece is ever built. Every single byte is a piece (byte fallback), so
each word can be cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import given_id, id_and_text

#: what a word starts with in the vocabulary
WORD_START = "▁".encode()
#: words whose counts a task remembers before it starts anew
REMEMBERED = 500_000


class Automaton:
    """``go``: (node * 256 + byte) -> node; ``fail`` and ``popped`` by node; node 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        self.go: dict[int, int] = {}
        parent, ends = [(0, 0)], {0: False}
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.go:
                    self.go[key] = len(parent)
                    parent.append((node, byte))
                    ends[len(parent) - 1] = False
                node = self.go[key]
            ends[node] = ends[node] or node != 0
        children: dict[int, list[int]] = {}
        for node in range(1, len(parent)):
            children.setdefault(parent[node][0], []).append(node)
        self.fail, self.popped = [0] * len(parent), [0] * len(parent)
        todo = deque(children.get(0, []))
        while todo:
            node = todo.popleft()
            todo.extend(children.get(node, []))
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            above, byte = parent[node]
            at, count = self.fail[above], self.popped[above]
            while at << 8 | byte not in self.go:
                count += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.go[at << 8 | byte], count

    def tables(self) -> tuple[dict[int, int], list[int], list[int]]:
        return self.go, self.fail, self.popped


def count_pieces(tables: tuple[dict[int, int], list[int], list[int]], word: bytes) -> int:
    """Pieces of ``word`` (which starts with its word-start mark)."""
    go, fail, popped = tables
    node = total = 0
    for byte in word:
        while (key := node << 8 | byte) not in go:
            total += popped[node]
            node = fail[node]
        node = go[key]
    while node:
        total += popped[node]
        node = fail[node]
    return total


def sentencepiece_pieces(path: str) -> list[bytes]:
    """The ordinary pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(k).encode()
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]


class _Counts(dict):
    def __init__(self, tables: tuple):
        super().__init__()
        self.tables = tables

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = count_pieces(self.tables, WORD_START + word)
        return n


def _count(broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(broadcast.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = []
            for k in range(batch.num_rows):
                text = texts[k].as_py() or b""
                words = text.split()  # bytes: ASCII white space only
                rows.append((len(text), len(words), sum(map(counts.__getitem__, words))))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                ["_id", "n_bytes", "n_words", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, n_bytes, n_words, n_tokens) for each row of ``docs``.

    ``vocabulary`` is the path of a sentencepiece model, read on the driver. Words are runs of
    other than ASCII white space; each is cut, with the word-start mark in front, into the
    longest pieces from left to right; a character without a piece counts one per byte.

    Null and empty texts have no tokens. Null ids stay null, repeated rows are counted each,
    other columns are not read, an empty table gives an empty result.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(sentencepiece_pieces(vocabulary)).tables())
    rows = id_and_text(docs, id_col, text_col).mapInArrow(
        _count(automaton), "_id long, n_bytes long, n_words long, n_tokens long"
    )
    return rows.select(given_id().alias("doc_id"), "n_bytes", "n_words", "n_tokens")
