"""Substring removal by relative Lempel-Ziv parsing against reference blocks.

Texts that may share a passage meet in reference blocks (see `anchors`), where every segment is
indexed by its 50-word windows, the earliest document first. A segment is parsed greedily: where a
window starts that an earlier document has, the match is followed word by word to its end and
becomes a factor, and what no earlier document has is passed over. Windows over a factor's end are
looked up again, so a passage that one source begins and another ends is found; factors of 50
words or more are thus all there are, and they overlap where sources do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tandem.llm.anchors import merged, repeated_windows, runs_of, text_classes, with_classes
from tandem.llm.text import byte_arrays, grams, slices, whole, word_bounds, word_hashes

WINDOW = 50
GRAM = 8


@dataclass
class Block:
    """Segments of a block as words, and for every window the first window of an equal hash in a smaller owner's segment."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray    # each segment's first word, and the end
    earlier: np.ndarray  # by word: where the index has the window starting there, or -1

    @classmethod
    def index(cls, bodies: list[bytes], owners: np.ndarray, window: int) -> "Block":
        data, offsets = byte_arrays(pa.array(bodies, pa.binary()))
        starts, ends, first = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        earlier = np.full(int(first[-1]), -1)
        valid = np.flatnonzero(whole(first, window))
        if len(valid):
            value = grams(hashes, window)[valid]
            owner = np.repeat(owners, np.diff(first))[valid]
            order = np.lexsort((valid, owner, value))
            new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
            leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            later = owner[order] > owner[leader]
            earlier[valid[order[later]]] = valid[leader[later]]
        return cls(data.tobytes(), starts, ends, hashes, first, earlier)

    def words(self, a: int, n: int) -> list[bytes]:
        return self.raw[self.starts[a]:self.ends[a + n - 1]].split()

    def match(self, a: int, b: int, most: int) -> int:
        """Number of equal words from `a` and `b` on, at most `most`, by their hashes."""
        done, step = 0, 64
        while done < most:
            n = min(step, most - done)
            differs = self.hashes[a + done:a + done + n] != self.hashes[b + done:b + done + n]
            if differs.any():
                return done + int(differs.argmax())
            done, step = done + n, step * 2
        return most

    def factors(self, window: int) -> Iterator[tuple[int, int, int]]:
        """Greedy factors of all segments: first word, number of words and where the source starts.

        Each is as long as its source goes on equally, `window` words at least, and its words are
        those of the source, which is in a smaller owner's segment.
        """
        end_of = np.repeat(self.first[1:], np.diff(self.first))
        found = np.flatnonzero(self.earlier >= 0)
        k = 0
        while k < len(found):
            a, b = int(found[k]), int(self.earlier[found[k]])
            n = self.match(a, b, int(min(end_of[a] - a, end_of[b] - b)))
            if n >= window and self.words(a, n) != self.words(b, n):
                n = window if self.words(a, window) == self.words(b, window) else 0
            if n < window:  # a hash met by chance
                k += 1
                continue
            yield a, n, b
            # On to the first window over the factor's end.
            k = int(np.searchsorted(found, a + n - window + 1))


def _kernel(window: int):
    def kernel(bodies: list[bytes], counts: np.ndarray, owners: np.ndarray) -> list[list[int]]:
        block = Block.index(bodies, owners, window)
        covered = np.zeros(int(block.first[-1]), bool)
        for a, n, _ in block.factors(window):
            covered[a:a + n - window + 1] = True
        return runs_of(covered, block.first)

    return kernel


def without_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """By row of `docs`: doc_id, n_words, n_removed, kept_sha256 and kept (words joined by one space, UTF-8).

    A word `[^\\x20\\x09-\\x0D]+` goes if a `window`-word passage over it also starts in a row with
    a smaller id. A null id is larger than all others; rows with one id, or both without, take
    nothing from each other. Null texts have no words.
    """
    classes = text_classes(docs, text, key)
    rows = with_classes(docs, classes, text, key)
    spans = repeated_windows(rows, window, gram, True, _kernel(window))
    joined = rows.join(spans, "class_key", "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(4)]
            later = (batch.column("owner").to_numpy() > batch.column("first_id").fill_null((1 << 63) - 1).to_numpy()).tolist()
            for raw, listed, copy in zip(batch.column("text"), batch.column("spans"), later):
                words = raw.as_py().split()
                if copy and len(words) >= window:
                    gone = [(0, len(words))]
                else:
                    gone = merged(np.array(listed.as_py() or [], np.int64))
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rest = b" ".join(kept)
                for column, value in zip(columns, (len(words), len(words) - len(kept), sha256(rest).hexdigest(), rest)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.select("doc_id", "text", "owner", "first_id", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary")
