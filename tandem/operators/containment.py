"""Which texts contain which names or passages, as plain case-sensitive substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.operators.joins import spread_join
from tandem.session import settle

# Names per catalogue row: bounds the array each text is tested against at once.
NAMES_PER_ROW = 256

# Lengths in bytes of the pieces that items are looked up by; an item's is the longest that fits.
PIECES = (8, 4, 2, 1)

# Counters of the sketch: rows and counters a row. Estimates only choose keys, they lose nothing.
SKETCH_ROWS, SKETCH_CELLS = 3, 1 << 18

PART_ROWS = 1_000  # surroundings of keys in one batch
PART_BYTES = 4 << 20  # and their bytes, one longer one aside

# Bytes looked at together: numpy holds some 60 for each of them, whatever Arrow puts into one batch.
SLICE_BYTES = 1 << 20

# Bits of the key filter: so many an item, up to 32 MB; a key sets several.
BITS_PER_KEY, MOST_BITS, HASHES = 32, 1 << 28, 6


def table_mentions(
    texts: DataFrame, catalogue: DataFrame, text: str = "sql", db: str = "db_id",
    name: str = "table_name", ordinal: str = "ordinal",
) -> DataFrame:
    """Tables of each text's database that occur in it, in catalogue order.

    The catalogue is packed to arrays of bounded length, so a text meets a few rows of
    its database and tests the names inside the row; no text/name pair is emitted that
    does not match. Short names over-match by design.
    """
    packed = catalogue.groupBy(
        db, F.floor(F.col(ordinal) / F.lit(NAMES_PER_ROW)).alias("_pack")
    ).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(name).alias("t")))).alias("_names"))
    found = F.filter("_names", lambda n: F.contains(F.col(text), n["t"]))
    return (
        texts.join(packed, db)
        .withColumn("_hit", F.explode(found))
        .select(*texts.columns, F.col("_hit.o").alias(ordinal), F.col("_hit.t").alias(name))
    )


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each row begins (one more entry than rows)."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `SLICE_BYTES` in the binary column `name`, or of one longer row; their bytes and beginnings."""
    for batch in batches:
        _, offsets = _bytes_of(batch.column(name))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
            own = batch.slice(begin, end - begin)
            yield own, *_bytes_of(own.column(name))
            begin = end


def _windows(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`_pieces` of a long row in several turns."""
    for begin in range(0, max(len(data) - size + 1, 0), SLICE_BYTES):
        end = min(begin + SLICE_BYTES + size - 1, len(data))
        value, at = _pieces(data[begin:end], np.clip(offsets, begin, end) - begin, size)
        yield value, at + begin


def _pieces(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every window of `size` within one row as a number, and where it starts."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + size <= ends)
    return value[at], at


def _scattered(value: np.ndarray, turn: int) -> np.ndarray:
    """One of several independent hashes of numbers."""
    x = (value + np.uint64(2 * turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sketch(texts: DataFrame, size: int, cells: int) -> np.ndarray:
    """Count-min sketch of all pieces of `size` bytes; a task sends each counter once, whatever its texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, cells), np.int64)
        for _, data, offsets in _slices(batches, "text"):
            for value, _ in _windows(data, offsets, size):
                for turn in range(SKETCH_ROWS):
                    counts[turn] += np.bincount((_scattered(value, turn) % np.uint64(cells)).astype(np.int64), minlength=cells)
        flat = counts.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["cell", "n"])

    total = np.zeros(SKETCH_ROWS * cells, np.int64)
    counted = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in counted.collect():  # as many as the sketch has counters
        total[row["cell"]] = row["n"]
    return total.reshape(SKETCH_ROWS, cells)


def _keys(items: DataFrame, size: int, counts: np.ndarray, kind: str) -> DataFrame:
    """Columns item_id, item and key: each item's piece of `size` bytes that is rarest in the texts by the sketch."""
    cells = np.uint64(counts.shape[1])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _slices(batches, "item"):
            value, at = _pieces(data, offsets, size)
            often = np.min([counts[t][(_scattered(value, t) % cells).astype(np.int64)] for t in range(SKETCH_ROWS)], axis=0)
            row = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((at, often, row))
            _, first = np.unique(row[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value[order[first]].view(np.int64))], ["item_id", "item", "key"])

    return items.mapInArrow(choose, f"item_id {kind}, item binary, key long")


def _filter_of(keyed: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the keys as bytes of 0 and 1 bits; its size is bounded, whatever the number of items."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy().view(np.uint64)
            found = [_scattered(value, SKETCH_ROWS + t) % np.uint64(bits) for t in range(HASHES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int64))], ["at"])

    at = keyed.select("key").mapInArrow(places, "at long")
    words = at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("bits"))
    result = np.zeros(-(-bits // 32), np.uint32)
    for row in words.collect():
        result[row["word"]] = row["bits"]
    return result


def _candidates(texts: DataFrame, size: int, reach: int, bits: np.ndarray, n_bits: int, kind: str) -> DataFrame:
    """Columns text_id, key and part for each text and each of its pieces that may be some item's key.

    `part` is the text around all places of the key, `reach` bytes to both sides, so that an item
    of at most that length is in it if it is in the text at its key.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _slices(batches, "text"):
            passed = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for value, at in _windows(data, offsets, size):
                for turn in range(HASHES):
                    place = _scattered(value, SKETCH_ROWS + turn) % np.uint64(n_bits)
                    set_ = (bits[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                    value, at = value[set_ == 1], at[set_ == 1]
                passed.append((value, at))
            value, at = (np.concatenate(found) for found in zip(*passed))
            row = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((at, value, row))
            value, at, row = value[order], at[order], row[order]
            new = np.ones(len(at), bool)
            new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[: len(first)] - 1
            start = np.maximum(at[first] - reach, offsets[row[first]])
            end = np.minimum(at[last] + size + reach, offsets[row[first] + 1])
            raw = data.tobytes()
            # Few rows and bytes a batch: parts of long texts would fill one.
            total, begin = np.concatenate([[0], np.cumsum(end - start)]), 0
            while begin < len(first):
                most = max(begin + 1, int(np.searchsorted(total, total[begin] + PART_BYTES, "right")) - 1)
                own = slice(begin, min(most, begin + PART_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id").take(pa.array(row[first[own]])), pa.array(value[first[own]].view(np.int64)),
                     pa.array([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())], pa.binary())],
                    ["text_id", "key", "part"])
                begin = own.stop

    return texts.mapInArrow(look, f"text_id {kind}, key long, part binary")


def contain_join(
    texts: DataFrame, text_id: str, text: str, items: DataFrame, item_id: str, item: str,
    cells: int = SKETCH_CELLS, most_bits: int = MOST_BITS,
) -> DataFrame:
    """All (text_id, item_id) where the text contains the item; ids must be unique.

    Every item is keyed by the piece of its bytes that is rarest in the texts, as a sketch of all
    their pieces tells. Texts are scanned for these keys behind a filter, and only what surrounds a key is
    joined with the items of that key and tested. So frequent words cost nothing, no text is
    compared with every item, and nothing is missed or capped: an estimate that is off, or
    a filter that lets other pieces through, only makes more candidates. Sketch and filter are
    bounded, and one plan serves any number of items. Empty items are in every text; null texts and
    items in none.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((texts, text_id), (items, item_id))]
    named = items.where(F.col(item).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item).cast("binary").alias("item"))
    known = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("text_id"), F.col(text).cast("binary").alias("text"))
    length = F.octet_length("item")
    size = F.coalesce(*[F.when(length >= s, s) for s in PIECES], F.lit(0))
    sized = settle(named.withColumn("size", size))
    found = None
    for row in sized.groupBy("size").agg(F.count("*").alias("n"), F.max(length).alias("reach")).orderBy("size").collect():
        own = sized.where(F.col("size") == row["size"]).select("item_id", "item")
        if row["size"] == 0:
            pairs = known.select("text_id").crossJoin(own.select("item_id"))
        else:
            keyed = settle(_keys(own, row["size"], _sketch(known.select("text"), row["size"], cells), kinds[1]))
            n_bits = int(min(most_bits, 1 << (row["n"] * BITS_PER_KEY - 1).bit_length()))
            near = _candidates(known, row["size"], row["reach"], _filter_of(keyed, n_bits), n_bits, kinds[0])
            pairs = spread_join(near, keyed, ["key"]).where(F.contains("part", "item")).select("text_id", "item_id")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = known.limit(0).select("text_id").crossJoin(named.limit(0).select("item_id"))
    return found.select(F.col("text_id").alias(text_id), F.col("item_id").alias(item_id))
