"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a byte trie. A node that is no piece has a failure link: the node where the
match goes on once the pieces that are certain by then are popped; their number is known
beforehand. So a word's count needs one walk over its bytes, never goes back, and no piece is
built. Words of a batch walk side by side, one byte each at a time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from tandem.llm.frames import free_name, others, quoted, text_bytes
from tandem.llm.text import byte_arrays, slices, word_bounds, word_hashes

WORD_MARK = "▁".encode()  # begins every word in the vocabulary of this kind of tokenizer


@dataclass
class Automaton:
    """Edges as sorted keys node * 256 + byte, failure links and popped counts by node; `start` is
    the node after the word mark and the pieces popped on the way."""

    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    popped: np.ndarray
    start: tuple[int, int]

    def _walk(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next nodes, and pieces popped."""
        count = np.zeros(len(node), np.int64)
        result = np.zeros(len(node), np.int64)
        open_ = np.arange(len(node))
        node = node.copy()
        while len(open_):
            key = node[open_] * 256 + byte[open_]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            result[open_[hit]] = self.targets[at[hit]]
            open_ = open_[~hit]
            count[open_] += self.popped[node[open_]]
            node[open_] = self.fail[node[open_]]
        return result, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word `data[start:end]`."""
        order = np.argsort(starts - ends, kind="stable")  # the longest first: those still walking lead
        starts, lengths = starts[order], (ends - starts)[order]
        node = np.full(len(starts), self.start[0])
        total = np.full(len(starts), self.start[1])
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            node[:live], popped = self._walk(node[:live], data[starts[:live] + step].astype(np.int64))
            total[:live] += popped
        live = np.flatnonzero(node)
        while len(live):
            total[live] += self.popped[node[live]]
            node[live] = self.fail[node[live]]
            live = live[node[live] > 0]
        result = np.empty(len(starts), np.int64)
        result[order] = total
        return result


def build(vocabulary: Iterable[bytes], mark: bytes = WORD_MARK) -> Automaton:
    """Every single byte counts as a piece too (byte fallback), so no word is without pieces."""
    pieces = {p for p in vocabulary if p} | {bytes([b]) for b in range(256)}
    child: list[dict[int, int]] = [{}]
    is_piece = [False]
    for piece in sorted(pieces):
        node = 0
        for byte in piece:
            if byte not in child[node]:
                child[node][byte] = len(child)
                child.append({})
                is_piece.append(False)
            node = child[node][byte]
        is_piece[node] = True
    fail, popped = np.zeros(len(child), np.int64), np.zeros(len(child), np.int64)
    todo = deque([0])
    while todo:
        parent = todo.popleft()
        for byte, node in child[parent].items():
            todo.append(node)
            if is_piece[node]:
                popped[node] = 1
                continue
            # A node deeper than 1 here; the parent's failure link and its own lead back to the root at last.
            at, count = fail[parent], popped[parent]
            while byte not in child[at]:
                count += popped[at]
                at = fail[at]
            fail[node], popped[node] = child[at][byte], count
    edges = np.array([node * 256 + byte for node, own in enumerate(child) for byte in own], np.int64)
    targets = np.array([to for own in child for to in own.values()], np.int64)
    order = np.argsort(edges)
    automaton = Automaton(edges[order], targets[order], fail, popped, (0, 0))
    node, count = np.zeros(1, np.int64), 0
    for byte in mark:
        node, more = automaton._walk(node, np.array([byte]))
        count += int(more[0])
    automaton.start = (int(node[0]), count)
    return automaton


def piece_vocabulary(path: str) -> list[bytes]:
    """Ordinary pieces of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def with_token_count(
    docs: DataFrame, automaton: Automaton, text: str = "text", name: str = "n_tokens",
) -> DataFrame:
    """`docs` plus the number of greedy pieces of all words `[^\\x20\\x09-\\x0D]+`; 0 for null and empty texts.

    A column called `name` is replaced.

    The automaton's size is that of the vocabulary. Each different word of a batch walks once;
    words of any length are walked whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches, held):
            data, offsets = byte_arrays(batch.column(held))
            starts, ends, first = word_bounds(data, offsets)
            _, one, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            pieces = machine.counts(data, starts[one], ends[one])[back]
            total = np.concatenate([[0], np.cumsum(pieces)])
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total[first[1:]] - total[first[:-1]])], names)

    before, held = others(docs, name), free_name(docs, "__bytes")
    names = [*before, name]
    schema = StructType([*(docs.schema[c] for c in before), StructField(name, LongType())])
    return docs.select(*map(quoted, before), text_bytes(text).alias(held)).mapInArrow(count, schema)
