"""Substring removal by suffix arrays.

Texts that may share a window are dealt out in shards (see `anchors`). Each shard gets a suffix
array by Larsson-Sadakane refinement: suffixes are sorted by 7 symbols, then only groups still
tied are sorted again by the rank 7, 14, 28 ... symbols on. Kasai's common prefixes of
neighbours tell the classes of equal windows, and classes of different shards of a partition
are matched by binary search.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tandem.llm.anchors import merged, repeated_windows, runs_of, text_classes, with_classes
from tandem.llm.text import slices

WINDOW = 200
GRAM = 32
SHARD_BYTES = 1 << 20
_PACK = 7  # symbols of 9 bits in one sort key


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of all suffixes of `x` (symbols 0 to 511; a suffix that is a prefix of another comes first)."""
    n = len(x)
    padded = np.concatenate([x.astype(np.int64) + 1, np.zeros(_PACK, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(_PACK):
        key = key * 513 + padded[j:j + n]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    place, done = np.arange(n), _PACK
    while True:
        # Ranks are the place where a group begins, so refined groups keep their places.
        rank[sa[place]] = place[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))] if len(place) else place
        last = np.concatenate([new[1:], [True]]) if len(new) else new
        tied = ~(new & last)
        place = place[tied]
        if not len(place):
            return sa
        suffix = sa[place]
        after = suffix + done
        next_rank = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[suffix] * (n + 1) + next_rank
        order = np.argsort(both, kind="stable")
        sa[place] = suffix[order]
        both = both[order]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        done *= 2


def common_prefixes(x: np.ndarray, sa: np.ndarray, most: int, lane: int = 512) -> np.ndarray:
    """Kasai: for each place of `sa`, symbols shared with the suffix before it, at most `most`.

    The text is worked off in lanes side by side, each by the usual rule that a prefix shrinks by
    one at most from one position to the next.
    """
    n = len(x)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    found = np.zeros(n, np.int64)
    x = np.concatenate([x, [-1]])
    at = np.arange(0, n, lane)
    stop = np.minimum(at + lane, n)
    size = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        a, b = np.minimum(at + size, n), np.minimum(other + size, n)
        grows = (other >= 0) & (size < most) & (a < n) & (b < n) & (x[a] == x[b])
        ends = ~grows
        found[at[ends]] = size[ends]
        size = np.where(grows, size + 1, np.maximum(size - 1, 0))
        at = at + ends
        live = at < stop
        if not live.all():
            at, stop, size = at[live], stop[live], size[live]
    return found[sa]


@dataclass
class Shard:
    """One suffix array's classes of equal windows, in order."""

    text: np.ndarray
    first: np.ndarray       # start of each segment, and the end
    member: np.ndarray      # window starts, class after class
    class_of: np.ndarray    # class of each member
    leader: np.ndarray      # one window start of each class
    repeated: np.ndarray    # by class

    def windows(self, width: int) -> np.ndarray:
        """The classes' windows as fixed-length byte strings, which are in order."""
        rows = np.lib.stride_tricks.sliding_window_view(self.text, width)[self.leader]
        return np.ascontiguousarray(rows).view(f"S{width}")[:, 0]


def build_shard(bodies: list[bytes], counts: np.ndarray, width: int) -> Shard:
    """`counts`: how often each segment occurs."""
    lengths = np.array([len(b) for b in bodies])
    first = np.concatenate([[0], np.cumsum(lengths + 1)])  # a separator after each
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    x = text.astype(np.int64) + 1
    x[first[1:] - 1] = 0
    sa = suffix_array(x)
    shared = common_prefixes(x, sa, width)
    segment = np.repeat(np.arange(len(bodies)), lengths + 1)
    whole = np.arange(len(x)) + width < first[1:][segment]
    own = whole[sa]
    group = np.cumsum(shared < width)[own]  # windows that end in a separator are in no class
    member = sa[own]
    _, leader, class_of = np.unique(group, return_index=True, return_inverse=True)
    total = np.bincount(class_of, counts[segment[member]], minlength=len(leader))
    return Shard(text, first, member, class_of, member[leader], total > 1)


def match(a: Shard, b: Shard, width: int) -> None:
    """Mark the classes that both shards have, by binary search of one's windows in the other's."""
    if not len(a.leader) or not len(b.leader):
        return
    left, right = a.windows(width), b.windows(width)
    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
    same = left[at] == right
    a.repeated[at[same]] = True
    b.repeated[same] = True


def repeats_of(width: int, shard_bytes: int = SHARD_BYTES):
    """Kernel for `repeated_windows`: windows that occur at two places or more."""

    def kernel(bodies: list[bytes], counts: np.ndarray, owners: np.ndarray) -> list[list[int]]:
        total = np.cumsum([0] + [len(b) for b in bodies])
        shards, start = [], 0
        while start < len(bodies):
            stop = max(start + 1, int(np.searchsorted(total, total[start] + shard_bytes, "right")) - 1)
            shards.append(build_shard(bodies[start:stop], counts[start:stop], width))
            for earlier in shards[:-1]:
                match(earlier, shards[-1], width)
            start = stop
        result = []
        for shard in shards:
            flags = np.zeros(len(shard.text), bool)
            flags[shard.member] = shard.repeated[shard.class_of]
            result += runs_of(flags, shard.first)
        return result

    return kernel


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """By row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes).

    A byte goes if a `window`-byte string over it also starts at another place of any row,
    its own included. Null counts as empty; texts below the window are kept. Rows with equal
    texts lose all if they have a whole window. Matches never cross rows. Ids need not be unique.
    """
    classes = text_classes(docs, text, key)
    rows = with_classes(docs, classes, text, key)
    spans = repeated_windows(rows, window, gram, False, repeats_of(window))
    joined = rows.join(spans, "class_key", "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for raw, listed, copies in zip(batch.column("text"), batch.column("spans"), batch.column("copies")):
                body = raw.as_py()
                if copies.as_py() and len(body) >= window:
                    gone = [(0, len(body))]
                else:
                    gone = merged(np.array(listed.as_py() or [], np.int64))
                kept, at = [], 0
                for a, b in gone:
                    kept.append(body[at:a])
                    at = b
                rest = b"".join([*kept, body[at:]])
                for column, value in zip(columns, (len(body), len(body) - len(rest), len(gone), sha256(rest).hexdigest(), rest)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.select("doc_id", "text", "copies", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
