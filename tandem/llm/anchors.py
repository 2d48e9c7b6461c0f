"""Bring together all places where two texts may share a long passage.

Every window of a text has a smallest k-gram hash, its anchor; equal windows have equal
anchors wherever they stand. A text is cut into segments, runs of windows with one anchor.
Only segments whose anchor occurs elsewhere are kept; equal segments are merged, with how often
they occur and the smallest owner; and the rest is dealt out by anchor, so that every two equal
windows meet in one partition of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.frames import discard, small_enough, stored, text_bytes, text_key
from tandem.llm.text import anchored_runs, byte_arrays, byte_hashes, slices, word_bounds, word_hashes

PARTITION_BYTES = 1 << 20  # of segments dealt to one partition, on average
OUTPUT_BYTES, OUTPUT_ROWS = 4 << 20, 50_000  # of segments in one Arrow batch
LAST_OWNER = (1 << 63) - 1  # owner of texts without an id

# Finds repeats in one partition: takes bodies, counts and owners of its different segments and
# gives, for each, the repeated windows as [first, number, first, number, ...].
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[int]]]


def _units(batch: pa.RecordBatch, words: bool):
    data, offsets = byte_arrays(batch.column("text"))
    if not words:
        return data, byte_hashes(data), offsets, None
    starts, ends, first = word_bounds(data, offsets)
    return data, word_hashes(data, starts, ends), first, (starts, ends)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def text_classes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Texts that occur more than once: `class_key`, `copies`, `first_id` (null ids count as last)."""
    owner = F.coalesce(F.col(key), F.lit(LAST_OWNER)).cast("long")
    counted = docs.select(text_key(text).alias("class_key"), owner.alias("owner")).groupBy("class_key").agg(
        F.count("*").alias("copies"), F.min("owner").alias("first_id"))
    return stored(counted.where("copies > 1"), "repeat-classes")


def with_classes(docs: DataFrame, classes: DataFrame, text: str, key: str) -> DataFrame:
    """Columns doc_id, class_key, text (bytes), owner, copies and first_id (both null for single texts)."""
    rows = docs.select(F.col(key).alias("doc_id"), text_key(text).alias("class_key"), text_bytes(text).alias("text"),
                       F.coalesce(F.col(key), F.lit(LAST_OWNER)).cast("long").alias("owner"))
    return rows.join(small_enough(classes, 32), "class_key", "left")


def repeated_windows(rows: DataFrame, window: int, gram: int, words: bool, kernel: Kernel) -> DataFrame:
    """`class_key` and `spans` (flat list of unit ranges [from, to)) of texts with repeated windows.

    `rows` as of `with_classes`; of copies one text is looked at. Lists are bounded by one text.
    """
    one = rows.where(F.col("copies").isNull() | (F.col("owner") == F.col("first_id"))).select("class_key", "owner", "text")

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, units, first, _ = _units(batch, words)
            values, starts, _ = anchored_runs(units, first, window, gram)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_key"), _lists(values.view(np.int64), np.searchsorted(starts, first), pa.int64())],
                ["class_key", "anchors"])

    found = stored(one.select("class_key", "text").mapInArrow(anchors, "class_key binary, anchors array<long>"), "repeat-anchors")
    each = found.select("class_key", F.posexplode("anchors").alias("no", "anchor"))
    shared = stored(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-shared")
    wanted = stored(each.join(shared, "anchor", "left_semi").groupBy("class_key").agg(F.collect_list("no").alias("nos")), "repeat-wanted")
    discard(found, shared)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, units, first, bounds = _units(batch, words)
            values, starts, counts = anchored_runs(units, first, window, gram)
            run = np.searchsorted(starts, first)
            nos = batch.column("nos")
            sizes = np.diff(np.asarray(nos.offsets))
            picked = np.repeat(run[:-1], sizes) + nos.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            raw = data.tobytes()
            keys: list[bytes] = []
            bodies: list[bytes | None] = []
            seen: set[tuple[int, bytes]] = set()
            begun = held = 0
            for i, (r, a, n) in enumerate(zip(row.tolist(), starts[picked].tolist(), counts[picked].tolist())):
                b = a + n + window - 1
                body = b" ".join(raw[bounds[0][a]:bounds[1][b - 1]].split()) if words else raw[a:b]
                key = md5(body).digest()
                keys.append(key)
                # One body of each kind a text: in text of a short period the same few come again and again.
                bodies.append(None if (r, key) in seen else body)
                seen.add((r, key))
                held += len(body) if bodies[-1] is not None else 0
                if held > OUTPUT_BYTES or len(keys) == OUTPUT_ROWS or i + 1 == len(row):
                    at = slice(begun, i + 1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("class_key").take(pa.array(row[at])), batch.column("owner").take(pa.array(row[at])),
                         pa.array((starts[picked] - first[row])[at], pa.int64()), pa.array(counts[picked][at], pa.int64()),
                         pa.array(values[picked].view(np.int64)[at]), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())],
                        ["class_key", "owner", "start", "windows", "anchor", "segment", "body"])
                    keys, bodies, begun, held = [], [], i + 1, 0

    width = F.lit(32) + 4 * F.size("nos")
    cut = one.join(small_enough(wanted, width), "class_key").select("class_key", "owner", "text", "nos").mapInArrow(
        segments, "class_key binary, owner long, start long, windows long, anchor long, segment binary, body binary")
    cut = stored(cut, "repeat-segments")
    discard(wanted)
    different = cut.groupBy("segment", "anchor").agg(
        F.count("*").alias("n"), F.min("owner").alias("owner"), F.first("body", ignorenulls=True).alias("body"))
    different = stored(different, "repeat-different")

    def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = [b for b in batches if b.num_rows]  # bounded by how segments are dealt out
        if not dealt:
            return
        table = pa.Table.from_batches(dealt)
        bodies = table.column("body").to_pylist()
        n, owner = table.column("n").to_numpy(), table.column("owner").to_numpy()
        runs = kernel(bodies, n, owner)
        kept = [i for i, r in enumerate(runs) if r or n[i] > 1]
        small = table.select(["segment", "owner"]).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()
        for batch in small:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([runs[i] for i in kept], pa.list_(pa.int32()))], ["segment", "first_owner", "runs"])

    total = different.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(1, -(-total // PARTITION_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = stored(different.repartition(parts, "anchor").select("segment", "n", "owner", "body").mapInArrow(
        repeats, "segment binary, first_owner long, runs array<int>"), "repeat-runs")
    discard(different)
    # What grows with the shared text is joined as Spark's own size rule has it.
    places = cut.select("segment", "class_key", "owner", "start", "windows").join(facts, "segment")
    # A later owner's segment that equals an earlier one is repeated whole.
    runs = F.when(F.col("owner") > F.col("first_owner"), F.array(F.lit(0), F.col("windows").cast("int"))).otherwise(F.col("runs"))
    spans = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")), lambda i: F.struct(
        (F.col("start") + F.get("runs", 2 * i)).alias("from"),
        (F.col("start") + F.get("runs", 2 * i) + F.get("runs", 2 * i + 1) + window - 1).alias("to")))
    places = places.withColumn("runs", runs).where(F.size("runs") > 0).select("class_key", F.explode(spans).alias("s"))
    listed = places.groupBy("class_key").agg(F.flatten(F.sort_array(F.collect_list(F.array("s.from", "s.to")))).alias("spans"))
    found = stored(listed, "repeat-spans")
    discard(cut, facts)
    return found


def runs_of(flags: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Flags over the concatenation, as [first, number, ...] by row."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    # A run never crosses rows where each row ends with windows that can't be flagged.
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(first, begin, "right") - 1
    result: list[list[int]] = [[] for _ in range(len(first) - 1)]
    for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist()):
        result[r] += [a - int(first[r]), b - a]
    return result


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Union of sorted ranges given as a flat list; touching ones join."""
    result: list[tuple[int, int]] = []
    for a, b in spans.reshape(-1, 2).tolist():
        if result and a <= result[-1][1]:
            result[-1] = (result[-1][0], max(result[-1][1], b))
        else:
            result.append((a, b))
    return result
