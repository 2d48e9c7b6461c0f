"""Merkle manifest of a table, with octopus multiproofs.

Every row is a leaf, the leaves of a source form a tree of 16 children a node, and the trees'
roots form one more. Leaves are numbered by a range sort, and nodes are made in blocks of 4,096
leaves, which are whole subtrees, so that no task ever holds a source.

A proof of many leaves shares its nodes: each block of wanted leaves works out the smallest set of
node coordinates that its own leaves do not give, fetches these in one join, derives the inner
nodes that its leaves share, and expands the single proofs where they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.frames import quoted, stored
from tandem.operators.ordering import number_rows

ARITY = 16
BLOCK_LEVELS = 3
BLOCK = ARITY ** BLOCK_LEVELS  # leaves of a block
TOP = -1  # number of the tree of all sources' roots

Coordinate = tuple[int, int]  # level (0: leaves) and place in the level
Proof = list[tuple[bytes, bytes]]  # by level, hex digests left and right of the path


def digest(*parts: bytes) -> bytes:
    """SHA-256 of hex digests one after the other, as hex."""
    return sha256(b"".join(parts)).hexdigest().encode()


def level_sizes(leaves: int) -> list[int]:
    """Number of nodes on each level, from the leaves to the one node that remains."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def missing(known: Iterable[int], leaves: int) -> list[Coordinate]:
    """The octopus: nodes that the proofs of the `known` leaves need and that these do not give.

    On each level the brothers of what is known, but for those known themselves; the parents
    are known then.
    """
    result, have = [], sorted(set(known))
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        own, runs = set(have), sorted({i // ARITY for i in have})
        result += [(level, i) for run in runs for i in range(run * ARITY, min((run + 1) * ARITY, size)) if i not in own]
        have = runs
    return result


def derived(nodes: dict[Coordinate, bytes], known: Iterable[int], leaves: int) -> None:
    """Add to `nodes` (leaves and fetched ones) every inner node on the paths of the `known` leaves."""
    have = sorted(set(known))
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        have = sorted({i // ARITY for i in have})
        for run in have:
            nodes[level + 1, run] = digest(*(nodes[level, i] for i in range(run * ARITY, min((run + 1) * ARITY, size))))


def brothers(nodes: dict[Coordinate, bytes], level: int, place: int, leaves: int) -> Proof:
    """From a node up: on each level what stands left and right of its path in their run."""
    result = []
    for at, size in enumerate(level_sizes(leaves)[level:-1], level):
        first = place - place % ARITY
        end = min(first + ARITY, size)
        result.append((b"".join(nodes[at, i] for i in range(first, place)), b"".join(nodes[at, i] for i in range(place + 1, end))))
        place //= ARITY
    return result


def fold(leaf: bytes, proof: Proof) -> bytes:
    """The root that a leaf and its proof lead to."""
    for left, right in proof:
        leaf = digest(left, leaf, right)
    return leaf


def leaf_digest(docs: DataFrame, columns: Iterable[str], texts: dict[str, Column] | None = None) -> Column:
    """Digest of a row: each column's value as `-` if null, else byte count, `:` and value."""
    parts = []
    for name in columns:
        value = (texts or {}).get(name, F.col(quoted(name))).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


@dataclass
class Manifest:
    """`leaves`: own (struct of the kept columns), leaf, tree, place. `trees`: tree, source, leaves, subroot.
    `nodes`: tree, level, place, digest, of all levels from 1 on and of level 0 of the top tree."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    root: bytes
    sources: int


def _inner_nodes(leaves: DataFrame) -> DataFrame:
    """Rows tree, level, place and digest of all nodes above `leaves` (tree, place, digest, size: leaves of the tree).

    One round makes three levels, in blocks that are whole subtrees; the rounds grow with the
    logarithm of the largest tree.
    """

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, base = table.column("size")[0].as_py(), table.column("level")[0].as_py()
        row = {p: d.hex().encode() for p, d in zip(table.column("place").to_pylist(), table.column("digest").to_pylist())}
        out: list[tuple[int, int, bytes]] = []
        for level in range(base, base + BLOCK_LEVELS):
            if size == 1:
                break
            runs = defaultdict(list)
            for place in sorted(row):
                runs[place // ARITY].append(row[place])
            row = {run: digest(*children) for run, children in runs.items()}
            out += [(level + 1, run, d) for run, d in row.items()]
            size = -(-size // ARITY)
        tree = table.column("tree")[0].as_py()
        return pa.table([
            pa.array([tree] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int32()),
            pa.array([o[1] for o in out], pa.int64()), pa.array([bytes.fromhex(o[2].decode()) for o in out], pa.binary())],
            names=["tree", "level", "place", "digest"])

    made, now, base = [], leaves.select("tree", "place", "digest", "size", F.lit(0).alias("level")), 0
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        block = F.floor(F.col("place") / BLOCK).alias("block")
        level = now.where("size > 1").groupBy("tree", block).applyInArrow(make, "tree long, level int, place long, digest binary")
        made.append(stored(level, "merkle-nodes"))
        base, largest = base + BLOCK_LEVELS, -(-largest // BLOCK)
        if largest > 1:
            counts = now.where("size > 1").select("tree", "size").distinct()
            upper = made[-1].where(F.col("level") == base).join(counts, "tree")
            now = upper.withColumn("size", F.ceil(F.col("size") / BLOCK))
    empty = leaves.select("tree", F.lit(0).alias("level"), "place", "digest").limit(0)
    return reduce(DataFrame.unionByName, made, empty)


def build(
    docs: DataFrame, columns: Iterable[str], source: str = "source", key: str = "doc_id", tampered: Column | None = None,
) -> Manifest:
    """Leaves, trees and nodes of `docs`, all stored.

    `columns` make the leaf, in this order; `tampered` is a further leaf digest to be carried
    along (null where there is none). Leaves of a source ascend by `key`, null first, and equal
    keys by leaf; rows equal in both are interchangeable. Null is a source of its own, first in
    order. The trees' number is that of the sources; only one digest comes to the driver.
    """
    rows = docs.select(
        F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(key)).alias("id"), leaf_digest(docs, columns).alias("leaf"),
        (F.lit(None).cast("binary") if tampered is None else tampered).alias("tampered"), F.monotonically_increasing_id().alias("nth"))
    # One more key than needed: equal rows of any number are dealt out too.
    ranged, _ = number_rows(rows, [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("nth")])
    spans = stored(ranged.groupBy("source").agg(F.min("position").alias("first"), F.count("*").alias("size")), "merkle-sources")
    trees, sources = number_rows(spans, [F.col("first")], "tree")
    trees = stored(trees, "merkle-trees")
    near = trees.select(F.col("source").alias("own"), "first", "size", "tree")
    placed = ranged.join(near, F.col("source").eqNullSafe(F.col("own"))).select(
        "id", "leaf", "tampered", "tree", (F.col("position") - F.col("first")).alias("place"), "size")
    placed = stored(placed, "merkle-leaves")
    nodes = _inner_nodes(placed.select("tree", "place", F.col("leaf").alias("digest"), "size"))
    # The subroot is the node of the highest level; a lone leaf is its own.
    every = nodes.unionByName(placed.where("size = 1").select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest")))
    roots = every.where("place = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("subroot"))
    trees = stored(trees.select("tree", "source", "size").join(roots, "tree"), "merkle-subroots")
    tops = trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("digest"),
                        F.lit(sources).cast("long").alias("size"))
    upper = stored(_inner_nodes(tops), "merkle-top")
    top = upper.where("place = 0").unionByName(
        tops.select("tree", F.lit(0).alias("level"), "place", "digest").where("place = 0")).orderBy(F.col("level").desc()).first()
    nodes = nodes.unionByName(upper).unionByName(tops.select("tree", F.lit(0).alias("level"), "place", "digest"))
    return Manifest(placed, trees, nodes, bytes(top["digest"]) if top else sha256().digest(), sources)


def prove(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """Proofs of `wanted` leaves (rows of `manifest.leaves`, all or some): id, leaf, subroot, root,
    proof_sha256 and folded_root, digests as binary.

    `proof_sha256` is the digest of all brothers, level by level from the leaf via the subroot to
    the root, left to right; `folded_root` is what the tampered leaf, where there is one, and
    these brothers lead to. A block is at most 4,096 leaves and fetches at most 15 nodes a level
    and leaf run that it does not have itself.
    """
    kind, root, sources = wanted.schema["id"].dataType.simpleString(), manifest.root, manifest.sources
    blocked = wanted.withColumn("block", F.floor(F.col("place") / BLOCK))

    def coordinates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        found = [(tree, *c) for c in missing(table.column("place").to_pylist(), table.column("size")[0].as_py())]
        found += [(TOP, *c) for c in missing([tree], sources)]
        return pa.table([
            pa.array([tree] * len(found), pa.int64()), pa.array([block] * len(found), pa.int64()),
            *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64())))],
            names=["for_tree", "for_block", "tree", "level", "place"])

    needed = stored(blocked.select("tree", "block", "place", "size").groupBy("tree", "block").applyInArrow(
        coordinates, "for_tree long, for_block long, tree long, level int, place long"), "merkle-needed")
    have = manifest.nodes
    if not needed.where((F.col("level") == 0) & (F.col("tree") != TOP)).isEmpty():  # blocks that lack some of their leaves
        have = have.unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest")))
    fetched = stored(needed.join(have, ["tree", "level", "place"]), "merkle-fetched")

    def expand(key: tuple[pa.Scalar, ...], own: pa.Table, got: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        places, leaves, changed = (own.column(c).to_pylist() for c in ("place", "leaf", "tampered"))
        size = own.column("size")[0].as_py()
        nodes = {(0, p): leaf.hex().encode() for p, leaf in zip(places, leaves)}
        top: dict[Coordinate, bytes] = {}
        for of, level, place, value in zip(*(got.column(c).to_pylist() for c in ("tree", "level", "place", "digest"))):
            (top if of == TOP else nodes)[level, place] = value.hex().encode()
        derived(nodes, places, size)
        subroot = top[0, tree] = nodes[len(level_sizes(size)) - 1, 0]
        derived(top, [tree], sources)
        above = brothers(top, 0, tree, sources)
        proofs, folded = [], []
        shared: dict[int, tuple[Proof, bytes]] = {}  # what lies above a run is the same for all its leaves
        for place, other in zip(places, changed):
            run = place // ARITY
            if run not in shared:
                upper = brothers(nodes, 1, run, size) + above
                shared[run] = upper, b"".join(side for level in upper for side in level)
            upper, joined = shared[run]
            own_run = [(b"".join(nodes[0, i] for i in range(run * ARITY, place)),
                        b"".join(nodes[0, i] for i in range(place + 1, min((run + 1) * ARITY, size))))] if size > 1 else []
            proofs.append(sha256(b"".join(side for level in own_run for side in level) + joined).digest())
            leaf = nodes[0, place] if other is None else other.hex().encode()
            folded.append(bytes.fromhex(fold(leaf, own_run + upper).decode()))
        same = [bytes.fromhex(subroot.decode())] * len(places), [root] * len(places)
        return pa.table([own.column("id"), own.column("leaf"), *(pa.array(c, pa.binary()) for c in (*same, proofs, folded))],
                        names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    packed = blocked.select("tree", "block", "place", "size", "id", "leaf", "tampered").groupBy("tree", "block")
    return packed.cogroup(fetched.groupBy("for_tree", "for_block")).applyInArrow(
        expand, f"id {kind}, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary")


def with_proofs(
    docs: DataFrame, columns: Iterable[str], tampered: Column | None = None, source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """By row of `docs`: id, leaf, subroot, root, proof_sha256, folded_root (lowercase hex) and verified.

    See `build` for the order of leaves and `prove` for the proofs. Where `tampered` is null the
    root is folded from the leaf itself. An empty table has no rows.
    """
    manifest = build(docs, columns, source, key, tampered)
    proofs = prove(manifest, manifest.leaves)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return proofs.select("id", *(F.lower(F.hex(c)).alias(c) for c in names), (F.col("folded_root") == F.col("root")).alias("verified"))
