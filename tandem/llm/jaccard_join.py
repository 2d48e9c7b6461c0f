"""Jaccard join of word n-grams by adaptive multi-match prefixes.

Shingles are ordered by hash. If two sets overlap enough, the first |x| - required + m of one
and of the other share m shingles at least. A document starts with m = 1; each shingle of its
prefix that costs too many candidates (many documents have it) lengthens the prefix by one and
raises m by one, so that a partner must also share a cheap shingle: only those are joined.
Documents whose prefix stays dear (groups of very many near copies) are collapsed by hubs; those
that may still lack a link are ordered by rarity among themselves and joined on what is rare.
Parity bitmaps bound the difference of two sets before the sets themselves are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.anchors import LAST_OWNER
from tandem.llm.components import components
from tandem.llm.frames import discard, free_name, quoted, small_enough, stored, text_bytes, text_key
from tandem.llm.packing import packed, range_starts, rising, risen, unpacked
from tandem.llm.text import byte_arrays, grams, lowered, mix, slices, whole, word_bounds, word_hashes

SHINGLE = 3      # words of a shingle, and
PERCENT = 90     # least similarity, where the caller gives none
DEAR = 32        # documents with a shingle in their prefix from which the shingle is not joined on
LONGEST = 24     # most shingles by which a prefix is lengthened
HUBS = (1, 4)    # hubs per dear shingle, by round
BLOCK = 1_000    # bitmaps compared at once
PARITY_SERVES = 256  # shingles up to which the bitmap of 1,024 bits tells sets apart
_PARITY_LONGS = 16
CHUNK_BYTES = 8 << 20      # of prefixes or dense texts that are kept together
RANGE_SHINGLES = 1 << 20   # of their shingles for each range of hashes, at most


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each row in ascending order, and where each row begins.

    A row with fewer words than `size` has its whole word sequence as one shingle, a row
    without words none.
    """
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    valid = np.flatnonzero(whole(first, size))
    parts, rows = [grams(hashes, size)[valid]], [row_of[valid]]
    counts = np.diff(first)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        at = first[:-1][short]
        value = hashes[at] + np.uint64(n)
        for j in range(1, n):
            value = mix(value) + hashes[at + j]
        parts.append(mix(value))
        rows.append(short)
    value, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def _required(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def _extra(n, percent: int):
    """By how many shingles the prefix of a set of n can be lengthened at most."""
    return np.minimum(LONGEST, np.maximum(_required(n, percent) - 1, 0))


def _signatures(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, owner, text_key, n and sig (128 bits of the whole set)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(*byte_arrays(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("owner"), batch.column("text_key"), pa.array(np.diff(first)), _sigs(mix(value), first),
            ], ["doc_id", "owner", "text_key", "n", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "owner", "text_key", "text").mapInArrow(sign, f"doc_id {kind}, owner long, text_key binary, n long, sig binary")


def _sigs(spread: np.ndarray, first: np.ndarray) -> pa.Array:
    """128 bits of each whole set; `spread`: its mixed shingles."""
    n = np.diff(first)
    sums = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        sums[some, 0] = np.add.reduceat(spread, first[:-1][some])
        sums[some, 1] = np.add.reduceat(mix(spread + np.uint64(1)), first[:-1][some]) + n[some].astype(np.uint64)
    return pa.array([s.tobytes() for s in sums], pa.binary())


def _profiles(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """owner, text_key, n, sig, prefix (at its longest, eight bytes a shingle) and parity."""

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(*byte_arrays(batch.column("text")), size)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            spread = mix(value)
            bits = np.bincount(row * 1024 + (spread & np.uint64(1023)).astype(np.int64), minlength=1024 * len(n)) & 1
            parity = np.packbits(bits.astype(np.uint8)).view(np.int64)
            length = np.minimum(n, n - _required(n, percent) + 1 + _extra(n, percent))
            yield pa.RecordBatch.from_arrays([
                batch.column("owner"), batch.column("text_key"), pa.array(n), _sigs(spread, first),
                pa.array([value[a:a + k].tobytes() for a, k in zip(first.tolist(), length.tolist())], pa.binary()),
                pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * _PARITY_LONGS).astype(np.int32)), pa.array(parity)),
            ], ["owner", "text_key", "n", "sig", "prefix", "parity"])

    return rows.select("owner", "text_key", "text").mapInArrow(
        profile, "owner long, text_key binary, n long, sig binary, prefix binary, parity array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rid and set (all shingles) of the sets in `wanted` (rid, sig, owner), from their texts."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(*byte_arrays(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([
                _sigs(mix(value), first),
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))], ["sig", "set"])

    owners = wanted.select("owner").distinct()
    texts = rows.join(small_enough(owners, 8), "owner", "left_semi").select("text")
    found = texts.mapInArrow(read, "sig binary, set array<long>")
    return found.join(small_enough(wanted.select("rid", "sig"), 32), "sig").select("rid", "set")


def _wide_parity(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rid and wide: parity bitmaps of 4 to 8 bits a shingle, for the sets in `wanted` (rid, sig, owner)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first = shingle_sets(*byte_arrays(batch.column("text")), size)
            spread, n = mix(value), np.diff(first)
            long = np.flatnonzero(n > PARITY_SERVES)
            sigs, maps = [], []
            for a, b in zip(first[long].tolist(), first[long + 1].tolist()):
                own = spread[a:b]
                width = 1 << int(4 * (b - a) - 1).bit_length()
                bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                sigs.append(_signature(own))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(maps, pa.list_(pa.int64()))], ["sig", "wide"])

    owners = wanted.select("owner").distinct()
    texts = rows.join(small_enough(owners, 8), "owner", "left_semi").select("text")
    found = texts.mapInArrow(read, "sig binary, wide array<long>")
    return found.join(small_enough(wanted.select("rid", "sig"), 32), "sig").select("rid", "wide").dropDuplicates(["rid"])


def _signature(spread: np.ndarray) -> bytes:
    """128 bits of one whole set, as `_sigs` has them."""
    sums = np.array([spread.sum(dtype=np.uint64), mix(spread + np.uint64(1)).sum(dtype=np.uint64)], np.uint64)
    sums[1] += np.uint64(len(spread))
    return sums.tobytes()


def _difference(a: str, b: str) -> Column:
    """At most the number of shingles in one set only."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that sizes and parity allow, with the bound `apart`. `facts`: rid, n, parity."""
    for side in ("u", "v"):
        own = facts.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"p_{side}"))
        pairs = pairs.join(own, side)
    both = F.col("n_u") + F.col("n_v")
    # 100 I >= P U with I = (both - d) / 2 and U = (both + d) / 2.
    return pairs.withColumn("apart", _difference("p_u", "p_v")).where(
        (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        & ((100 + percent) * F.col("apart") <= (100 - percent) * both)).select("u", "v", "apart")


class _Linker:
    """Confirms pairs on their whole sets; keeps all links found so far and their components."""

    def __init__(self, rows: DataFrame, classes: DataFrame, size: int, percent: int):
        self.rows, self.classes, self.size, self.percent = rows, classes, size, percent
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("rid").alias(side), F.col("set").alias(f"set_{side}")), side)
        shared = F.size(F.array_intersect("set_u", "set_v"))
        union = F.size("set_u") + F.size("set_v") - shared
        return pairs.where(100 * shared >= self.percent * union).select("u", "v")

    def _wanted(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
        return stored(self.classes.join(ends, "rid", "left_semi").select("rid", "sig", "owner", "n"), "near-wanted")

    def _told_apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs that bitmaps in proportion to the sets allow too; these are far shorter than the sets."""
        wanted = self._wanted(pairs)
        wide = stored(_wide_parity(self.rows, wanted.where(F.col("n") > PARITY_SERVES), self.size), "near-wide")
        sizes = self.classes.select("rid", "n")
        for side in ("u", "v"):
            own = wide.select(F.col("rid").alias(side), F.col("wide").alias(f"w_{side}"))
            pairs = pairs.join(own, side, "left").join(sizes.select(F.col("rid").alias(side), F.col("n").alias(f"n_{side}")), side)
        # Widths are powers of two; the wider one folds onto the other as linked sets are of like size.
        both, narrow = F.col("w_u").isNotNull() & F.col("w_v").isNotNull(), F.least(F.size("w_u"), F.size("w_v"))
        for side in ("u", "v"):
            w = F.col(f"w_{side}")
            folded = F.zip_with(F.slice(w, F.lit(1), narrow), F.slice(w, narrow + 1, narrow), lambda x, y: x.bitwiseXOR(y))
            pairs = pairs.withColumn(f"f_{side}", F.when(both & (F.size(w) > narrow), folded).otherwise(w))
        apart = F.greatest("apart", F.when(both, _difference("f_u", "f_v")))
        pairs = pairs.select("u", "v", "n_u", "n_v", apart.alias("apart"))
        possible = (100 + self.percent) * F.col("apart") <= (100 - self.percent) * (F.col("n_u") + F.col("n_v"))
        told = stored(pairs.where(possible).select("u", "v", "apart"), "near-told")
        discard(wanted, wide)
        return told

    def _add(self, links: DataFrame) -> None:
        links = stored(links, "near-links")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.roots = components(self.links)

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        if self.roots is None:
            return pairs
        for side in ("u", "v"):
            own = self.roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
            pairs = pairs.join(own, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        return pairs.where("root_u <> root_v").drop("root_u", "root_v")

    def add(self, pairs: DataFrame) -> None:
        """Links among `pairs` (u, v, apart): for each v its nearest u first, then what that did not join."""
        pairs = stored(pairs, "near-pairs")
        if pairs.isEmpty():
            return
        told = self._told_apart(pairs)
        wanted = self._wanted(told)
        sets = stored(_sets(self.rows, wanted, self.size).dropDuplicates(["rid"]), "near-sets")
        nearest = told.groupBy("v").agg(F.min(F.struct("apart", "u")).alias("best")).select("best.u", "v")
        self._add(self._confirmed(nearest, sets))
        rest = stored(self.across(told).select("u", "v"), "near-rest")
        if not rest.isEmpty():
            self._add(self._confirmed(rest, sets))
        discard(pairs, told, wanted, sets, rest)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _meetings(cheap: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs u < v that meet at shingles of `cheap` (rid, tokens), how often (`met`), as far as sizes and
    folded parity bitmaps allow. Each shingle has at most `DEAR` documents there."""
    folded = F.array(*(F.col("parity")[i].bitwiseXOR(F.col("parity")[i + 4]).bitwiseXOR(F.col("parity")[i + 8])
                       .bitwiseXOR(F.col("parity")[i + 12]) for i in range(4)))
    rows = cheap.join(facts.select("rid", "n", folded.alias("bits")), "rid").select(F.explode("tokens").alias("token"), "rid", "n", "bits")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for token, rid, n, bits in _whole_tokens(batches):
            # Row i against row i + step of the same shingle, for all shingles of the batch at once.
            step, live = 1, np.arange(len(token) - 1)
            while len(live):
                live = live[live + step < len(token)]
                live = live[token[live] == token[live + step]]
                other = live + step
                both, apart = n[live] + n[other], np.bitwise_count((bits[live] ^ bits[other]).view(np.uint64)).sum(1).astype(np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * both
                ok &= 100 * np.minimum(n[live], n[other]) >= percent * np.maximum(n[live], n[other])
                found.append(np.sort(np.column_stack([rid[live[ok]], rid[other[ok]]]), 1))
                size += len(found[-1])
                step += 1
                if size > 100_000:
                    yield _pair_counts(found)
                    found, size = [], 0
        if found:
            yield _pair_counts(found)

    met = rows.repartition("token").sortWithinPartitions("token").mapInArrow(
        meet, "u long, v long, met long")
    return met.groupBy("u", "v").agg(F.sum("met").alias("met"))


def _pair_counts(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs, counts = np.unique(np.concatenate(found), axis=0, return_counts=True)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(counts)], ["u", "v", "met"])


def _whole_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of batches sorted by token, cut so that no token is split."""
    held = None
    for batch in batches:
        now = [batch.column(c).to_numpy() for c in ("token", "rid", "n")]
        now.append(batch.column("bits").flatten().to_numpy().reshape(-1, 4))
        held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
        cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        if cut:
            yield tuple(h[:cut] for h in held)
            held = [h[cut:] for h in held]
    if held is not None:
        yield tuple(held)


def _link_dense(rows: DataFrame, classes: DataFrame, left: DataFrame, facts: DataFrame, linker: _Linker) -> None:
    """Links between documents whose prefix is dear at any permitted length; `left`: their dear shingles.

    Hubs come first: each dear shingle's documents are compared with a few of them, which makes
    most groups of near copies one component at the cost of a pair or two a document. Only of
    documents that may still lack a link the whole sets are ordered by rarity among themselves:
    where the basic prefix is cheap in that order, it is joined. What is left are texts nearly
    all of whose shingles are common, such as near copies of one text that are no near copies of
    each other; these are compared by parity bitmaps in blocks of like size.
    """
    facts = stored(facts.join(left.select("rid").distinct(), "rid", "left_semi"), "near-dense-facts")
    for hubs in HUBS:
        left = _unsettled(left, linker)
        if left.isEmpty():
            return
        # The fullest of each bucket: a text that the others were copied from has the most shared shingles.
        hub = left.groupBy("token", F.pmod(F.xxhash64("rid"), F.lit(hubs)).alias("bucket")).agg(
            F.max(F.struct("n_dear", "rid")).alias("hub")).select("token", F.col("hub.rid").alias("hub"))
        pairs = left.select("token", "rid").join(hub, "token").where("rid <> hub").select(*_ordered("rid", "hub")).distinct()
        linker.add(_plausible(linker.across(pairs), facts, linker.percent))
    left = _unsettled(left, linker)
    if left.isEmpty():
        return

    prefixes = _rare_prefixes(rows, classes.join(left.select("rid").distinct(), "rid", "left_semi"), linker.size, linker.percent)
    cheap = prefixes.where("token IS NOT NULL").groupBy("rid").agg(F.collect_set("token").alias("tokens"))
    linker.add(_plausible(_meetings(cheap, facts, linker.percent).select("u", "v"), facts, linker.percent))

    central = prefixes.where("token IS NULL").select("rid").distinct()
    left = _unsettled(left.join(central, "rid", "left_semi"), linker)
    left = left.groupBy("rid").agg(F.first("root").alias("root")).join(facts, "rid")
    linker.add(_in_blocks(left, linker.percent))


_CHUNK = "chunk binary, size long, rids array<long>, sizes binary, lengths binary, tokens binary, at binary"


def _chunk(rids: pa.Array, sizes: np.ndarray, lengths: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """One row for several sets (of so many shingles) with `lengths` shingles each of them in `value`.

    These are numbered by ascending hash: `tokens` are the different ones, `at` has their numbers.
    """
    tokens, at = np.unique(value, return_inverse=True)
    cells = packed(sizes.astype(np.uint32)), packed(lengths.astype(np.uint32)), rising(tokens), packed(at.astype(np.uint32))
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid4().bytes], pa.binary()), pa.array([len(value)], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(rids)], pa.int32()), rids), *(pa.array([c], pa.binary()) for c in cells)],
        ["chunk", "size", "rids", "sizes", "lengths", "tokens", "at"])


def _with_counts(chunks: DataFrame, most: int | None, found: Callable[..., pa.Table], schema: str, name: str) -> DataFrame:
    """`found(rids, sizes, lengths, tokens, docs)` of every chunk, stored; `chunks` are removed.

    tokens and docs are aligned with the chunk's shingles, set by set: the hash and how many sets of all
    chunks have it. Hashes are given of shingles that 2 to `most` sets have; the others' are 0. No
    shingle moves with its set: a chunk asks for the counts of its different shingles, packed by
    ranges of hashes, and the answer names those that are wanted.
    """
    total = chunks.agg(F.sum("size"), F.count("*")).first()
    ranges = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total[0] or 0) // RANGE_SHINGLES))
    starts = range_starts(ranges)

    def wanted(n: np.ndarray) -> np.ndarray:
        return (n > 1) & (n <= most) if most else n > 1

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, tokens, at in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tokens", "at"))):
                tokens = risen(tokens)
                n = np.bincount(unpacked(at, np.uint32), minlength=len(tokens)).astype(np.uint32)
                cut = [*np.searchsorted(tokens, starts).tolist(), len(tokens)]
                own = [(i, rising(tokens[a:b]), packed(n[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(own), pa.binary()), *(pa.array([o[k] for o in own], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                    ["chunk", "place", "tokens", "n"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tokens = [risen(t) for t in table.column("tokens").to_pylist()]
        kinds, at = np.unique(np.concatenate(tokens), return_inverse=True)
        docs = np.bincount(at, np.concatenate([unpacked(n, np.uint32) for n in table.column("n").to_pylist()]), len(kinds)).astype(np.uint64)
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        own = [docs[at[b - len(t):b]] for t, b in zip(tokens, ends)]
        named = [rising(t[wanted(n)]) for t, n in zip(tokens, own)]
        return pa.table([table.column("chunk"), table.column("place"), pa.array([packed(n) for n in own], pa.binary()), pa.array(named, pa.binary())],
                        names=["chunk", "place", "docs", "named"])

    asked = chunks.select("chunk", "tokens", "at").mapInArrow(ask, "chunk binary, place long, tokens binary, n binary")
    answers = stored(asked.repartition(ranges, "place").groupBy("place").applyInArrow(
        answer, "chunk binary, place long, docs binary, named binary"), f"{name}-counts")

    def read(chunk: pa.Table, got: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        at = unpacked(row["at"], np.uint32)
        parts = sorted(got.select(["place", "docs", "named"]).to_pylist(), key=lambda r: r["place"])
        docs = np.concatenate([np.zeros(0, np.int64), *(unpacked(p["docs"], np.uint64).astype(np.int64) for p in parts)])
        tokens = np.zeros(len(docs), np.uint64)
        tokens[wanted(docs)] = np.concatenate([np.zeros(0, np.uint64), *(risen(p["named"]) for p in parts)])
        sizes, lengths = (unpacked(row[c], np.uint32).astype(np.int64) for c in ("sizes", "lengths"))
        return found(np.array(row["rids"], np.int64), sizes, lengths, tokens[at], docs[at])

    parts = max(1, -(-total[1] // 4))
    kept = chunks.select("chunk", "rids", "sizes", "lengths", "at")
    met = kept.repartition(parts, "chunk").groupBy("chunk").cogroup(answers.repartition(parts, "chunk").groupBy("chunk"))
    result = stored(met.applyInArrow(read, schema), name)
    discard(chunks, answers)
    return result


def _prefix_chunks(able: DataFrame) -> DataFrame:
    """The longest prefixes of `able` (rid, n, prefix)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "prefix", CHUNK_BYTES):
            data, offsets = byte_arrays(batch.column("prefix"))
            value = np.frombuffer(data.tobytes(), np.uint64)
            yield _chunk(batch.column("rid"), batch.column("n").to_numpy(), np.diff(offsets) // 8, value)

    return stored(able.select("rid", "n", "prefix").mapInArrow(cut, _CHUNK), "near-chunks")


def _matches(chunks: DataFrame, percent: int) -> DataFrame:
    """Sets of `chunks` that share a shingle of their longest prefix with another one.

    longer: by how many shingles the prefix is lengthened, one for each dear one in it. dense: that is more than
    the smallest possible partner's can be (`reach`). dear: all dear shingles of the longest prefix;
    tokens: the cheap ones up to where the prefix ends, of dense sets all.
    """
    most, longest = DEAR, LONGEST

    def match(rids: np.ndarray, n: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, docs: np.ndarray) -> pa.Table:
        ends = np.cumsum(lengths)
        of, place = np.repeat(np.arange(len(n)), lengths), np.arange(len(docs)) - np.repeat(ends - lengths, lengths)
        required = _required(n, percent)
        basic, reach = n - required + 1, np.minimum(longest, _required(required, percent) - 1)
        is_dear = docs > most
        before = np.concatenate([[0], np.cumsum(is_dear)])
        rank = before[:-1] - np.repeat(before[ends - lengths], lengths)
        longer = np.bincount(of[is_dear & (place - rank < basic[of])], minlength=len(n))
        dense = longer > reach
        is_cheap = (docs > 1) & ~is_dear & (dense[of] | (place < (basic + longer)[of]))
        some = np.bincount(of[docs > 1], minlength=len(n)) > 0

        def lists(mask: np.ndarray) -> pa.Array:
            first = np.concatenate([[0], np.cumsum(np.bincount(of[mask], minlength=len(n)))])
            return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens[mask].view(np.int64)))

        return pa.table([
            pa.array(rids), pa.array(n), pa.array(dense), pa.array(longer), pa.array(np.bincount(of[is_dear], minlength=len(n))),
            pa.array(reach), pa.array(np.minimum(longest, required - 1)), lists(is_dear), lists(is_cheap),
        ], names=["rid", "n", "dense", "longer", "n_dear", "reach", "extra", "dear", "tokens"]).filter(pa.array(some))

    return _with_counts(chunks, None, match, "rid long, n long, dense boolean, longer long, n_dear long, reach long, extra long, "
                        "dear array<long>, tokens array<long>", "near-matches")


def _rare_prefixes(rows: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """Basic prefixes of the sets in `wanted` (rid, owner, text_key), shingles ordered by how many of these sets have them.

    Rows token and rid for each shingle of a prefix that 2 to `DEAR` of the sets have, and one of a null
    token and rid where the last one has more. A set whose text stands in several equal rows may be
    counted more than once, which is an order like any other.
    """
    most = DEAR
    keys = stored(wanted.select("owner", "text_key", "rid"), "near-dense")
    texts = rows.select("owner", "text_key", "text").join(small_enough(keys, 40), ["owner", "text_key"]).select("rid", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=CHUNK_BYTES):
            value, first = shingle_sets(*byte_arrays(batch.column("text")), size)
            yield _chunk(batch.column("rid"), np.diff(first), np.diff(first), value)

    def prefix(rids: np.ndarray, n: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, docs: np.ndarray) -> pa.Table:
        of = np.repeat(np.arange(len(n)), n)
        # A set's shingles ascend, so ties go the same way everywhere.
        order = np.lexsort((np.arange(len(docs)), docs, of))
        tokens, docs, basic = tokens[order], docs[order], n - _required(n, percent) + 1
        place = np.arange(len(docs)) - np.repeat(np.cumsum(n) - n, n)
        joined = np.flatnonzero((place < basic[of]) & (docs > 1) & (docs <= most))
        dear = np.flatnonzero((place == basic[of] - 1) & (docs > most))
        found = pa.array(tokens[joined].view(np.int64))
        return pa.table([pa.concat_arrays([found, pa.nulls(len(dear), pa.int64())]), pa.array(rids[of[np.concatenate([joined, dear])]])], names=["token", "rid"])

    chunks = stored(texts.mapInArrow(cut, _CHUNK), "near-dense-chunks")
    prefixes = _with_counts(chunks, most, prefix, "token long, rid long", "near-dense-prefixes")
    discard(keys)
    return prefixes


def _unsettled(left: DataFrame, linker: _Linker) -> DataFrame:
    """Rows (token, rid, n_dear, reach, root) of documents that may lack a link.

    A shingle is open while its documents are not one component. Two dense documents that are
    linked and have not been compared share more than `reach` dear shingles, all of them open, so
    a document with no more open ones is settled.
    """
    left = left.drop("root")
    if linker.roots is None:
        left = left.withColumn("root", F.col("rid"))
    else:
        roots = linker.roots.select(F.col("id").alias("rid"), "root")
        left = left.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    left = stored(left, "near-members")
    for _ in range(2):  # settled documents may leave shingles of one component behind
        open_ = left.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
        still = stored(left.join(open_, "token", "left_semi"), "near-open")
        able = still.groupBy("rid").agg(F.count("*").alias("open"), F.first("reach").alias("least")).where("open > least").select("rid")
        kept = stored(still.join(able, "rid", "left_semi"), "near-unsettled")
        discard(left, still)
        left = kept
    return left


def _in_blocks(left: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (u, v, apart) of different components among rows (rid, root, n, parity).

    Rows are packed in blocks by size class (a factor of `percent` each), so a partner is in the same
    class or the next; only pairs that the bitmaps allow leave the comparison of two blocks.
    """
    left = left.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / -np.log(percent / 100)))
    sizes = left.groupBy("level").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    left = left.join(sizes, "level").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    packed = stored(left.groupBy("level", "block").agg(
        F.collect_list(F.struct("rid", "root", "n", "parity")).alias("rows")), "near-blocks")
    a = packed.select(F.col("level").alias("la"), F.col("block").alias("ba"), F.col("rows").alias("a"), F.explode(
        F.array(F.col("level"), F.col("level") + 1)).alias("level"))
    b = packed.withColumnsRenamed({"block": "bb", "rows": "b"})
    met = a.join(b, "level").where((F.col("la") < F.col("level")) | (F.col("ba") <= F.col("bb"))).select("a", "b")

    def arrays(cell: pa.StructScalar) -> tuple[np.ndarray, ...]:
        values = cell.values
        rid, root, n = (values.field(f).to_numpy() for f in ("rid", "root", "n"))
        return rid, root, n, values.field("parity").flatten().to_numpy().reshape(len(rid), _PARITY_LONGS)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b")):
                rid, root, n, parity = arrays(a)
                rid_b, root_b, n_b, parity_b = arrays(b)
                for i in range(len(rid)):
                    apart = np.bitwise_count((parity[i] ^ parity_b).view(np.uint64)).sum(1)
                    ok = ((100 + percent) * apart.astype(np.int64) <= (100 - percent) * (n[i] + n_b)) & (root[i] != root_b)
                    ok &= 100 * np.minimum(n[i], n_b) >= percent * np.maximum(n[i], n_b)
                    if ok.any():
                        yield pa.record_batch([
                            pa.array(np.minimum(rid[i], rid_b[ok])), pa.array(np.maximum(rid[i], rid_b[ok])),
                            pa.array(apart[ok].astype(np.int64))], ["u", "v", "apart"])

    return met.repartition(F.xxhash64("a.rid", "b.rid")).mapInArrow(compare, "u long, v long, apart long").distinct()


def near_components(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """By row: doc_id, n_shingles, component_id, owner (the id, or a last one for null), text_key and
    group_key (one for all linked rows, null without words).

    Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles of `size` words; two rows are linked
    where 100 times the shared shingles is at least `percent` (50 to 99) times all. component_id is the smallest id reachable; a null
    id counts as larger than all and stays null where no row has one. Rows without words are
    linked with nothing. Equal sets are one class, so copies cost no pairs, and no link between
    different sets is lost.
    """
    if size < 1 or not 50 <= percent <= 99:  # a bitmap is folded once at most, so no partner has more than twice the shingles
        raise ValueError("size is 1 or more, percent 50 to 99")
    owner = F.coalesce(F.col(key), F.lit(LAST_OWNER)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), owner.alias("owner"), text_key(text).alias("text_key"), text_bytes(text).alias("text"))
    # Prefixes and bitmaps are wide: of the rows only keys stay, and of the classes no prefix once it is taken apart.
    profiles = stored(_signatures(rows, size), "near-profiles")
    classes = _profiles(rows, size, percent).where("n > 0").groupBy("sig").agg(
        F.min(F.struct("owner", "text_key")).alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    classes = classes.select("sig", "one.*", "copies", "n", "prefix", "parity")
    whole_classes = stored(classes.withColumn("rid", F.monotonically_increasing_id()), "near-whole-classes")
    classes = stored(whole_classes.drop("prefix"), "near-classes")

    # n shingles of n + 1 are the nearest that sets can be without being equal: 100 n >= P (n + 1), at 90 from 9 on.
    able = whole_classes.where(F.col("n") * (100 - percent) >= percent)
    chunks = _prefix_chunks(able)
    discard(whole_classes)
    matches = _matches(chunks, percent)

    # Cheap shingles have few documents, compared by bitmap. A prefix ends where its cheap shingles suffice.
    facts = classes.select("rid", "n", "parity")
    pairs = _meetings(matches.where(F.size("tokens") > 0).select("rid", "tokens"), facts, percent)
    for side in ("u", "v"):
        pairs = pairs.join(matches.select(
            F.col("rid").alias(side), F.when(F.col("dense"), F.col("extra")).otherwise(F.col("longer")).alias(f"more_{side}"),
            F.when(F.col("longer") > 0, F.col("dear")).alias(f"dear_{side}")), side)
    dear_met = F.coalesce(F.size(F.array_intersect("dear_u", "dear_v")), F.lit(0))
    enough = (F.least("more_u", "more_v") == 0) | (F.col("met") + F.greatest(dear_met, F.lit(0)) > F.least("more_u", "more_v", F.lit(LONGEST)))
    linker = _Linker(rows, classes, size, percent)
    linker.add(_plausible(pairs.where(enough).select("u", "v"), facts, percent))

    central = stored(matches.where("dense").select(F.explode("dear").alias("token"), "rid", "n_dear", "reach"), "near-central")
    discard(matches)
    if not central.isEmpty():
        _link_dense(rows, classes, central, facts, linker)

    named = classes.select("rid", "sig", "owner", "copies")
    if linker.roots is not None:
        named = named.join(linker.roots.select(F.col("id").alias("rid"), "root"), "rid", "left")
    else:
        named = named.withColumn("root", F.lit(None).cast("long"))
    named = named.withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(
        F.min("owner").alias("component"), F.min("sig").alias("group_key"), F.sum("copies").alias("size"))
    groups = named.join(least.where("size > 1"), "root").select("sig", "component", "group_key")
    groups = stored(groups, "near-groups")
    result = profiles.select("doc_id", "owner", "text_key", "n", "sig").join(small_enough(groups, 48), "sig", "left")
    component = F.coalesce("component", "owner")
    kind = docs.schema[key].dataType
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(component < LAST_OWNER, component).cast(kind).alias("component_id"),
        "owner", "text_key", F.when(F.col("n") > 0, F.coalesce("group_key", "sig")).alias("group_key"))


def one_of_each(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT,
) -> DataFrame:
    """`docs` with one row of each group of linked rows: the smallest id, then the smallest text key.

    Columns stay as they are. Rows without words are groups of their own. Of rows equal in id
    and text one stays.
    """
    found = stored(near_components(docs, text, key, size, percent).where("group_key IS NOT NULL").select("owner", "text_key", "group_key"), "near-found")
    one = F.struct("owner", "text_key")
    best = found.groupBy("group_key").agg(F.min(one).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    marked = stored(found.join(best, "group_key").select("owner", "text_key", (one == F.col("best")).alias("stays")), "near-marked")
    gone = stored(marked.where("NOT stays").select("owner", "text_key").distinct(), "near-gone")
    twins = stored(marked.where("stays").groupBy("owner", "text_key").count().where("count > 1").select("owner", "text_key"), "near-twins")
    names = [free_name(docs, "__owner"), free_name(docs, "__text_key")]
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(key), F.lit(LAST_OWNER)).cast("long"), names[1]: text_key(text)})
    gone, twins = (small_enough(t.toDF(*names), 24) for t in (gone, twins))
    single = keyed.join(gone, names, "left_anti").join(twins, names, "left_anti")
    twice = keyed.join(twins, names, "left_semi").dropDuplicates(names)
    return single.unionByName(twice).select(*map(quoted, docs.columns))
