"""Exact nearest neighbours over balls: blocks of near vectors with a centre and a radius.

Vectors of a group are split, again and again, by the nearest of a few dozen sampled centres until a
cell is a block. A query ball first meets the one document ball whose centre is nearest, which bounds
the distance of its queries' neighbours; by the triangle inequality a ball all of whose
vectors must be farther away than that bound is never met at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.plans.retrieval import BLOCK_ROWS, best_in_block, k_best, matrix_of, usable_vectors
from tandem.session import settle

FAN = 48           # centres that an overfull cell is split by, about
HEADS = 1024       # centres of balls in one block when balls are compared
BUNDLE_ROWS = 4096  # vectors, about, of the balls that go to a task together
_OUTWARD = 1e-9    # far above the rounding of a distance


@dataclass
class Found:
    """`rows`: query_id, rank, doc_id, distance. Pairs of query and document balls that were met, and in all."""

    rows: DataFrame
    pairs_met: int
    pairs_all: int


def _spread(ids: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each id, the same everywhere."""
    x = ids.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of all rows, tight up to rounding."""
    na, nb = (a * a).sum(1), (b * b).sum(1)
    rough = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    return np.maximum(rough - 1e-12 * (na[:, None] + nb[None, :]), 0.0)


def _packs(rows: DataFrame, block_rows: int) -> DataFrame:
    """Vectors packed by group into blocks by a hash of their ids: grp, cell, ids, flat."""
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("blocks"))
    packed = rows.join(sizes, "grp").groupBy("grp", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select("grp", F.lit("").alias("cell"), F.transform("r", lambda r: r["id"]).alias("ids"),
                         F.flatten(F.transform("r", lambda r: r["v"])).cast("array<double>").alias("flat"))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each pack's other columns, ids and vectors."""
    for batch in batches:
        ids, flat = batch.column("ids"), batch.column("flat")
        rest = [n for n in batch.schema.names if n not in ("ids", "flat")]
        for at in range(batch.num_rows):
            yield {n: batch.column(n)[at].as_py() for n in rest}, *matrix_of(ids, flat, at)


def _gathered(pieces: DataFrame, parts: str) -> DataFrame:
    """Pieces of a cell put together to as many packs as `parts` says: grp, cell, part, ids, flat."""
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("ids"), F.col(parts)))
    return dealt.groupBy("grp", "cell", "part").agg(F.collect_list(F.struct("ids", "flat")).alias("p")).select(
        "grp", "cell", "part", F.flatten("p.ids").alias("ids"), F.flatten("p.flat").alias("flat"))


def _split(packs: DataFrame, big: DataFrame, block_rows: int, kind: str) -> DataFrame:
    """Packs of overfull cells (`big`: grp, cell, n), cut by the nearest of their cell's sampled centres."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, vectors in _rows_of(batches):
            # Copies of one id have one hash, so that the rows taken stay few.
            place = _spread(ids)
            wanted = min(FAN, 2 * -(-row["n"] // block_rows))
            picked = np.flatnonzero(place < wanted / row["n"])
            yield pa.RecordBatch.from_pylist(
                [{"grp": row["grp"], "cell": row["cell"], "place": float(place[i]), "v": vectors[i].tolist()} for i in picked], schema=sampled)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, vectors in _rows_of(batches):
            centres = np.array(row["centres"], np.float64)
            nearest = _squares(vectors, centres).argmin(1)
            parts = [(c, np.flatnonzero(nearest == c)) for c in np.unique(nearest)]
            yield pa.RecordBatch.from_pylist(
                [{"grp": row["grp"], "cell": f"{row['cell']}.{c}", "ids": ids[own], "flat": vectors[own].reshape(-1)} for c, own in parts],
                schema=pieces)

    group = packs.schema["grp"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    grp = ("grp", to_arrow_type(group))
    sampled = pa.schema([grp, ("cell", pa.string()), ("place", pa.float64()), ("v", pa.list_(pa.float64()))])
    pieces = pa.schema([grp, ("cell", pa.string()), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(pa.float64()))])
    own = packs.join(big, ["grp", "cell"])
    centres = own.mapInArrow(sample, f"grp {kind}, cell string, place double, v array<double>")
    centres = centres.groupBy("grp", "cell", "place").agg(F.min("v").alias("v"))
    centres = centres.groupBy("grp", "cell").agg(F.array_sort(F.collect_list("v")).alias("centres"))
    # A cell whose sample came out empty is left as it is.
    return own.join(centres, ["grp", "cell"]).select("grp", "cell", "ids", "flat", "centres").mapInArrow(
        cut, f"grp {kind}, cell string, ids array<long>, flat array<double>").unionByName(
        own.join(centres, ["grp", "cell"], "left_anti").select("grp", F.concat("cell", F.lit(".x")).alias("cell"), "ids", "flat"))


def balls(df: DataFrame, group: str, row: str, vector: str, block_rows: int = BLOCK_ROWS, rounds: int = 5) -> DataFrame:
    """Balls of about `block_rows` vectors at most: grp, ball, n, centre, radius, ids, flat; stored.

    Every usable vector is in one ball of its group. A group never gathers in one task: it is dealt
    out in packs by id, packs are cut by their cell's centres, and only the pieces of a finished
    cell meet. Cells that no centre can split, such as copies of one vector, are cut by pack.
    """
    rows = usable_vectors(df, group, row, vector)
    kind = rows.schema["grp"].dataType.simpleString()
    packs, done = settle(_packs(rows, block_rows)), []
    for _ in range(rounds):
        sizes = settle(packs.groupBy("grp", "cell").agg(F.sum(F.size("ids")).alias("n")))
        big = sizes.where(F.col("n") > block_rows)
        if big.isEmpty():
            break
        done.append(packs.join(big, ["grp", "cell"], "left_anti"))
        if len(done) > 1:  # else a pack is cut into ever smaller pieces, and each meets all centres of its cell
            parts = packs.join(big.withColumn("parts", F.ceil(F.col("n") / F.lit(block_rows))), ["grp", "cell"])
            packs = settle(_gathered(parts, "parts").drop("part"))
        packs = settle(_split(packs, big, block_rows, kind))
    done.append(packs)
    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    sizes = cells.groupBy("grp", "cell").agg(F.ceil(F.sum(F.size("ids")) / F.lit(block_rows)).alias("parts"))
    whole = _gathered(cells.join(sizes, ["grp", "cell"]), "parts").select(
        "grp", F.xxhash64("grp", "cell", "part").alias("ball"), "ids", "flat")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for at in range(batch.num_rows):
                _, vectors = matrix_of(batch.column("ids"), batch.column("flat"), at)
                centre = vectors.mean(0)
                centres.append(centre.tolist())
                radii.append(float(np.sqrt(((vectors - centre) ** 2).sum(1)).max()) * (1 + _OUTWARD))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                [*batch.schema.names, "centre", "radius"])

    measured = whole.mapInArrow(measure, f"grp {kind}, ball long, ids array<long>, flat array<double>, centre array<double>, radius double")
    return settle(measured.withColumn("n", F.size("ids").cast("long")))


def _bundled(of: DataFrame) -> DataFrame:
    """Adds `bundle`: balls of one group and together some `BUNDLE_ROWS` vectors share it."""
    sizes = of.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(BUNDLE_ROWS)).alias("bundles"))
    number = F.pmod(F.xxhash64("ball"), F.col("bundles"))
    return of.join(sizes, "grp").withColumn("bundle", F.xxhash64("grp", number)).drop("bundles")


def _bundles(of: DataFrame, side: str, *more: str) -> DataFrame:
    """One row a bundle: its balls, their sizes, and ids, flat and the columns `more` of all of them, in one order."""
    packed = of.groupBy(F.col("bundle").alias(f"{side}_bundle")).agg(F.collect_list(F.struct("ball", "ids", "flat", *more)).alias("b"))
    flat = [F.flatten(F.col("b")[c]).alias(f"{side}_{c}") for c in ("ids", "flat", *more)]
    return packed.select(
        f"{side}_bundle", F.col("b")["ball"].alias(f"{side}_balls"),
        F.transform("b", lambda b: F.size(b["ids"])).alias(f"{side}_sizes"), *flat)


def _heads(of: DataFrame, *more: str, by: str = "ball") -> DataFrame:
    """Balls without their vectors, packed by group into blocks of about `HEADS`; equal `by` shares a block."""
    heads = of.select("grp", "ball", "n", "centre", "radius", *more)
    sizes = heads.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(HEADS)).alias("blocks"))
    named = heads.join(sizes, "grp").groupBy("grp", F.pmod(F.xxhash64(by), F.col("blocks")).alias("block"))
    return named.agg(F.collect_list(F.struct("ball", "n", "centre", "radius", *more)).alias("balls")).drop("block")


def _compared(q: DataFrame, d: DataFrame, judge, schema: str) -> DataFrame:
    """`judge(query heads, document heads, distances)` for all pairs of head blocks of one group."""
    pairs = q.select("grp", F.col("balls").alias("q")).join(d.select("grp", F.col("balls").alias("d")), "grp").select("q", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, other = (pa.Table.from_pylist(batch.column(c)[at].as_py()) for c in (0, 1))
                a, b = (np.array(t.column("centre").to_pylist(), np.float64) for t in (own, other))
                yield judge(own, other, np.sqrt(_squares(a, b)))

    return pairs.mapInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _merged(q: np.ndarray, d: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, by query, and their places (from 0)."""
    order = np.lexsort((d, apart, q))
    q, d, apart = q[order], d[order], apart[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    keep = place < k
    return q[keep], d[keep], apart[keep], place[keep]


def _best_of_bundles(
    q: np.ndarray, bounds: np.ndarray, d_ids: np.ndarray, d: np.ndarray, starts: np.ndarray,
    meets: np.ndarray, low: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most k candidates of each query, all its true neighbours among them: place of the query, id, distance.

    `meets` says which query meets which ball and `low` how near that can be at least; `starts` are
    the balls' first rows, and one more. Bounds fall as balls are met.
    """
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bounds, q_norm = bounds.copy(), (q * q).sum(1)
    for ball in np.flatnonzero(meets.any(0)):
        alive = np.flatnonzero(meets[:, ball] & (low[:, ball] <= bounds * (1 + _OUTWARD)))
        if not len(alive):
            continue
        own = d[starts[ball] : starts[ball + 1]]
        d_norm = (own * own).sum(1)
        # The product form only shortlists, with a margin wide enough to keep every true neighbour and tie.
        margin = 1e-9 * (q_norm[alive] + d_norm.max(initial=0.0) + 1.0)
        rough = q_norm[alive][:, None] + d_norm[None, :] - 2.0 * (q[alive] @ own.T)
        rows, cols = np.nonzero(rough <= (bounds[alive] ** 2 * (1 + _OUTWARD) + margin)[:, None])
        if not len(rows):
            continue
        exact = np.sqrt(((q[alive[rows]] - own[cols]) ** 2).sum(axis=1))
        new = alive[rows], d_ids[starts[ball] + cols], exact
        *best, place = _merged(*(np.concatenate(x) for x in zip(best, new)), k)
        last = place == k - 1
        bounds[best[0][last]] = np.minimum(bounds[best[0][last]], best[2][last])
    return tuple(best)


def nearest_by_balls(queries: DataFrame, corpus: DataFrame, k: int = 1) -> Found:
    """Exact k nearest vectors of each query within its group, both sides given as `balls`.

    The same rows as `retrieval.nearest`; ids of queries are taken to be unique. Balls are stored
    tables, so that one index of the corpus serves many searches. A query ball's first
    document ball is the nearest one with at least k vectors; without any, all balls of the group are met.
    What is left to be met after that is met bundle by bundle: many balls of both sides travel
    together, once, with the list of those of them that meet.
    """
    corpus = settle(_bundled(corpus))
    q_heads, d_heads = settle(_heads(queries)), settle(_heads(corpus, "bundle", by="bundle"))
    sizes = [df.groupBy("grp").agg(F.sum(F.size("balls")).alias(n)) for df, n in ((q_heads, "q"), (d_heads, "d"))]
    pairs_all = sizes[0].join(sizes[1], "grp").agg(F.sum(F.col("q") * F.col("d"))).first()[0] or 0

    def closest(own: pa.Table, other: pa.Table, apart: np.ndarray) -> pa.RecordBatch:
        full = _column(other, "n") >= k
        apart = np.where(full[None, :], apart, np.inf)
        best = apart.argmin(1)
        ok = np.flatnonzero(full[best])
        return pa.RecordBatch.from_arrays(
            [pa.array(_column(own, "ball")[ok]), pa.array(_column(other, "ball")[best[ok]]), pa.array(apart[ok, best[ok]])],
            ["q_ball", "d_ball", "apart"])

    first = _compared(q_heads, d_heads, closest, "q_ball long, d_ball long, apart double").groupBy("q_ball").agg(
        F.min(F.struct("apart", "d_ball"))["d_ball"].alias("d_ball"))
    first = settle(first)
    q = queries.select(F.col("ball").alias("q_ball"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    d = corpus.select(F.col("ball").alias("d_ball"), F.col("ids").alias("d_ids"), F.col("flat").alias("d_flat"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q_ids, q_own = matrix_of(batch.column("q_ids"), batch.column("q_flat"), at)
                found = list(best_in_block(np.arange(len(q_ids)), q_own, *matrix_of(batch.column("d_ids"), batch.column("d_flat"), at), k))
                own, doc, apart = (np.concatenate([f[i] for f in found]) for i in range(3))
                bounds = np.full(len(q_ids), -np.inf)
                np.maximum.at(bounds, own, apart)
                yield pa.RecordBatch.from_pylist([{
                    "q_ball": batch.column("q_ball")[at].as_py(), "queries": q_ids[own], "docs": doc, "apart": apart, "bounds": bounds}],
                    schema=begun)

    lists = [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    begun = pa.schema([("q_ball", pa.int64()), *zip(("queries", "docs", "apart", "bounds"), lists)])
    met = q.join(first, "q_ball").join(d, "d_ball")
    start = settle(met.select("q_ball", "q_ids", "q_flat", "d_ids", "d_flat").mapInArrow(
        begin, "q_ball long, queries array<long>, docs array<long>, apart array<double>, bounds array<double>"))
    none = F.lit(float("inf"))
    met_first = start.join(first, "q_ball").select(F.col("q_ball").alias("ball"), "bounds", F.col("d_ball").alias("first"))
    bounded = settle(_bundled(queries).join(met_first, "ball", "left").withColumns({
        "bounds": F.coalesce("bounds", F.transform("ids", lambda _: none)), "bound": F.coalesce(F.array_max("bounds"), none),
        "begun": F.col("first").isNotNull(), "first": F.coalesce("first", F.lit(0).cast("long"))}))

    def survivors(own: pa.Table, other: pa.Table, apart: np.ndarray) -> pa.RecordBatch:
        low = apart - _column(own, "radius")[:, None] - _column(other, "radius")[None, :]
        left = low <= (_column(own, "bound") * (1 + _OUTWARD))[:, None]
        left &= ~(_column(own, "begun").astype(bool)[:, None] & (_column(own, "first")[:, None] == _column(other, "ball")[None, :]))
        i, j = np.nonzero(left)
        a, b = _column(own, "bundle")[i], _column(other, "bundle")[j]
        order = np.lexsort((b, a))
        i, j, a, b = i[order], j[order], a[order], b[order]
        begins = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(i) else np.zeros(0, np.int64)
        ends = pa.array(np.append(begins, len(i)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(a[begins]), pa.array(b[begins]), *(pa.ListArray.from_arrays(ends, pa.array(_column(t, "ball")[x])) for t, x in ((own, i), (other, j)))],
            ["q_bundle", "d_bundle", "q_meet", "d_meet"])

    left = settle(_compared(_heads(bounded, "bound", "bundle", "begun", "first", by="bundle"), d_heads, survivors,
                            "q_bundle long, d_bundle long, q_meet array<long>, d_meet array<long>"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = lambda name: batch.column(name)[at].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                q_ids, q_own = matrix_of(batch.column("q_ids"), batch.column("q_flat"), at)
                d_ids, d_own = matrix_of(batch.column("d_ids"), batch.column("d_flat"), at)
                meets = np.zeros((len(one("q_balls")), len(one("d_balls"))), bool)
                places = []
                for balls_of, meet in (("q_balls", "q_meet"), ("d_balls", "d_meet")):
                    order = np.argsort(one(balls_of))
                    places.append(order[np.searchsorted(one(balls_of), one(meet), sorter=order)])
                meets[places[0], places[1]] = True
                low = np.sqrt(_squares(q_own, one("d_centre").reshape(len(one("d_balls")), -1))) - one("d_radius")[None, :]
                row, doc, apart = _best_of_bundles(
                    q_own, one("q_bounds"), d_ids, d_own, np.append(0, np.cumsum(one("d_sizes"))),
                    np.repeat(meets, one("q_sizes"), axis=0), low, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row]), pa.array(doc), pa.array(apart)], ["query_id", "doc_id", "distance"])

    own = corpus.withColumn("radius", F.array("radius"))
    rest = left.join(_bundles(bounded, "q", "bounds"), "q_bundle").join(_bundles(own, "d", "centre", "radius"), "d_bundle").drop(
        "q_bundle", "d_bundle").mapInArrow(finish, "query_id long, doc_id long, distance double")
    begun_rows = start.select(F.explode(F.arrays_zip("queries", "docs", "apart")).alias("z")).select(
        F.col("z.queries").alias("query_id"), F.col("z.docs").alias("doc_id"), F.col("z.apart").alias("distance"))
    pairs_left = left.agg(F.sum(F.size("q_meet"))).first()[0] or 0
    return Found(k_best(begun_rows.unionByName(rest), k), first.count() + pairs_left, int(pairs_all))
