"""Vector compression to one byte a part, with a GNAT over the entries of each codebook.

Vectors become integers and are cut into parts; each part is coded as its nearest codebook entry.
The entries of a part stand in a geometric near-neighbour access tree: a node has split points,
every other entry belongs to its nearest one, and for each pair of split point and child the
range of distances between them is kept. A query's distances to the split points rule out a
whole child where they are outside its range by more than the best distance so far, and
by strictly more, so that ties survive. Ranges and distances are rounded outwards; which entry is
nearest, and ties to the lower index, is decided on integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.frames import quoted, stored

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
DEGREE, BUCKET = 8, 12  # split points of a node, and entries below which there is none
_OUTWARD = 1e-12  # far above the rounding of a square root
BATCH_ROWS = 4_096


def squares(q: np.ndarray, p: np.ndarray, exact: type) -> np.ndarray:
    """Squared distance of every row of `q` to every row of `p`, without rounding."""
    if exact is float:  # all sums stay below 2^53, so products in doubles are whole numbers
        q, p = q.astype(float), p.astype(float)
        return ((q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (q @ p.T)).astype(np.int64)
    return ((q[:, None, :] - p[None, :, :]) ** 2).sum(2)


def arithmetic(largest: int, width: int) -> type:
    """How squared distances between parts of components up to `largest` are exact."""
    bound = (2 * largest) ** 2 * width
    return float if 4 * bound < 2 ** 53 else np.int64 if bound < 2 ** 62 else object


@dataclass
class Node:
    """Split points (or, in a leaf, all entries), ascending, and the children's ranges of distances."""

    entries: np.ndarray
    children: list["Node | None"] = field(default_factory=list)
    near: np.ndarray | None = None  # by split point and child, rounded down
    far: np.ndarray | None = None   # rounded up


class Gnat:
    """Exact nearest entry of integer vectors, ties to the lower index."""

    def __init__(self, entries: np.ndarray, largest: int, degree: int = DEGREE, bucket: int = BUCKET):
        self.exact = arithmetic(largest, entries.shape[1])
        self.points = entries.astype(object if self.exact is object else np.int64)
        self.degree, self.bucket = degree, bucket
        self.met = 0  # distances that queries computed
        self.root = self._node(np.arange(len(entries)))

    def _squares(self, q: np.ndarray, of: np.ndarray) -> np.ndarray:
        return squares(q, self.points[of], self.exact)

    def _node(self, own: np.ndarray) -> Node:
        if len(own) <= max(self.bucket, self.degree) or self.exact is object:
            return Node(own)
        # Split points far from each other: each is the farthest from those before.
        picked, gap = [0], self._squares(self.points[own], own[:1])[:, 0]
        while len(picked) < self.degree and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, self._squares(self.points[own], own[picked[-1:]])[:, 0])
        if len(picked) == 1:  # all entries are equal
            return Node(own)
        split = np.sort(own[picked])
        rest = np.setdiff1d(own, split)
        apart = np.sqrt(self._squares(self.points[rest], split).astype(float))
        belongs = apart.argmin(1)
        node = Node(split, near=np.zeros((len(split), len(split))), far=np.zeros((len(split), len(split))))
        for j in range(len(split)):
            inside = belongs == j
            node.children.append(self._node(rest[inside]) if inside.any() else None)
            if inside.any():
                node.near[:, j] = apart[inside].min(0) * (1 - _OUTWARD)
                node.far[:, j] = apart[inside].max(0) * (1 + _OUTWARD)
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each row."""
        q = q.astype(self.points.dtype)
        best = np.full(len(q), -1, q.dtype)
        index = np.full(len(q), len(self.points))
        if len(q):
            self._visit(self.root, q, np.arange(len(q)), best, index)
        return index, best

    def _visit(self, node: Node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        found = self._squares(q[rows], node.entries)
        self.met += found.size
        first = found.argmin(1)  # entries ascend, so this is the lowest index of the nearest
        distance, entry = found[np.arange(len(rows)), first], node.entries[first]
        better = (best[rows] < 0) | (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = distance[better], entry[better]
        if node.near is None:
            return
        apart = np.sqrt(found.astype(float))
        low, high = apart * (1 - _OUTWARD), apart * (1 + _OUTWARD)
        for own in (True, False):  # the child of the nearest split point first: it brings the best bound
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                chosen = np.flatnonzero((first == j) == own)
                bound = np.sqrt(best[rows[chosen]].astype(float)) * (1 + _OUTWARD)
                out = (low[chosen] - node.far[:, j] > bound[:, None]) | (node.near[:, j] - high[chosen] > bound[:, None])
                alive = rows[chosen[~out.any(1)]]
                if len(alive):
                    self._visit(child, q, alive, best, index)


@dataclass
class Codebooks:
    """By part, the entries as rows of integers (Python's own, of any size)."""

    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all components, by part, entry and position within the part."""
        return sha256(",".join(str(int(x)) for part in self.parts for x in part.reshape(-1)).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        entries = (int(code[2 * p:2 * p + 2], 16) for p in range(len(self.parts)))
        return [int(x) for part, e in zip(self.parts, entries) for x in part[e]]

    def coders(self, largest: int) -> list[Gnat]:
        return [Gnat(part, max([largest, *(abs(int(x)) for x in part.reshape(-1))])) for part in self.parts]


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64 bits where they fit with room to spare, else Python's."""
    if np.abs(values).max(initial=0) < 2.0 ** 53:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int = PARTS) -> DataFrame:
    """Columns id, label and v (1024 times each component, not yet floored), stored.

    Rows whose vector is null or holds a null, NaN or infinite component go (also one that
    1024 makes infinite), and so do those of another length than the most frequent one that `parts`
    divides (the smaller of two as frequent).
    """
    scaled = F.transform(F.col(quoted(vector)), lambda x: x.cast("double") * SCALE)
    rows = vectors.select(F.col(quoted(key)).alias("id"), (F.col(quoted(label)) if label else F.lit(None).cast("string")).alias("label"),
                          scaled.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite & (F.size("v") > 0) & (F.size("v") % parts == 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return stored(rows.where(F.size("v") == (lengths[0]["n"] if lengths else -1)), "codes-vectors")


def _matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH_ROWS):
            batch = whole.slice(start, BATCH_ROWS)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            yield batch, integers(np.floor(flat.reshape(batch.num_rows, -1)))


def _parts(matrix: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(matrix, parts, axis=1)


def _largest(matrix: np.ndarray) -> int:
    return int(np.abs(matrix).max()) if matrix.size else 0


def _coders(books: Codebooks, cache: dict, matrix: np.ndarray) -> list[Gnat]:
    """Trees whose arithmetic holds for this batch; made once for each kind of arithmetic."""
    largest = 1 << max(20, _largest(matrix).bit_length())
    if largest not in cache:
        cache[largest] = books.coders(largest)
    return cache[largest]


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of `kept` (see `kept_vectors`): the rows with the smallest ids, then `rounds` rounds of
    assigning all rows and replacing each entry by the floor of its rows' mean.

    Entries without rows stay. Null ids are larger than all others; of rows with one id the
    smaller vector comes first. A round sends one row a task, part and entry; only the codebooks
    come to the driver.
    """
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codebooks([])
    books = Codebooks(_parts(integers(np.floor(np.array([r["v"] for r in first], float))).astype(object), parts))
    for _ in range(rounds):

        def sums(batches: Iterable[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            cache: dict = {}
            counts = [np.zeros(len(part), np.int64) for part in books.parts]
            totals = [np.zeros(part.shape, object) for part in books.parts]
            for _, matrix in _matrices(batches):
                for p, (coder, own) in enumerate(zip(_coders(books, cache, matrix), _parts(matrix, parts))):
                    index, _ = coder.nearest(own)
                    order = np.argsort(index, kind="stable")
                    used, begin, n = np.unique(index[order], return_index=True, return_counts=True)
                    counts[p][used] += n
                    totals[p][used] += np.add.reduceat(own[order], begin, axis=0).astype(object)
            rows = [(p, e, int(counts[p][e]), [str(x) for x in totals[p][e]])
                    for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                ["part", "entry", "n", "total"])

        def mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            n = sum(table.column("n").to_pylist())
            columns = zip(*table.column("total").to_pylist())
            return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [
                pa.array([[str(sum(map(int, c)) // n) for c in columns]], pa.list_(pa.string()))], names=["part", "entry", "c"])

        tallied = kept.select("v").mapInArrow(sums, "part int, entry int, n long, total array<string>")
        moved = tallied.groupBy("part", "entry").applyInArrow(mean, "part int, entry int, c array<string>").collect()
        books = Codebooks([part.copy() for part in books.parts])
        for row in moved:
            books.parts[row["part"]][row["entry"]] = [int(x) for x in row["c"]]
    return books


def coded(kept: DataFrame, books: Codebooks) -> DataFrame:
    """Columns id, label, code (two hex digits a part) and error (squared distance; null beyond 64 bits)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch, matrix in _matrices(batches):
            found = [coder.nearest(own) for coder, own in zip(_coders(books, cache, matrix), _parts(matrix, len(books.parts)))]
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(index.tolist() for index, _ in found))]
            errors = [sum(row) for row in zip(*(best.tolist() for _, best in found))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(codes, pa.string()),
                 pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())], ["id", "label", "code", "error"])

    return kept.select("id", "label", "v").mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """By kept row of `vectors`: id, label, code, error, label_error (errors of equal labels summed, nulls
    together) and codebooks_sha256.

    See `kept_vectors` for the rows that go and `fit` for the codebooks; `entries` is 256 at
    most. Fewer rows than that make fewer entries. Rows with one id are rows like others. Sums that need
    more than 64 bits are null, and so is the sum over a null error. An empty table has no rows.
    """
    kept = kept_vectors(vectors, key, vector, label, parts)
    books = fit(kept, parts, entries, rounds)
    rows = stored(coded(kept, books), "codes")
    whole: Column = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    sums = stored(rows.groupBy("label").agg(whole.alias("label_error")), "codes-labels").withColumnRenamed("label", "of")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
