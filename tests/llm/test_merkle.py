"""Manifest and proofs against a plain tree."""

from collections import Counter, defaultdict
from hashlib import sha256
from random import Random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tandem.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(level):
    """All levels of a tree, lists of digests."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, place):
    for level in levels[:-1]:
        run = place // 16 * 16
        yield level[run:place], level[place + 1:run + 16]
        place //= 16


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    for tree, s in enumerate(order):
        for place, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            proof = [*path(trees[s], place), *path(top, tree)]
            folded = leaf
            if crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0:
                folded = leaf_of((*row[:4], lowered(row[4])))
            for left, right in proof:
                folded = h(*left, folded, *right)
            yield (row[0], leaf, trees[s][-1][0], top[-1][0], h(*(d for level in proof for side in level for d in side)),
                   folded, folded == top[-1][0])


def proofs(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    tampered = F.when(hit, merkle.leaf_digest(docs, COLUMNS, {"text": lower}))
    return merkle.with_proofs(docs, COLUMNS, tampered)


def odd_rows():
    rng = Random(2)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(290)]
    rows += [(i, rng.choice(["a", "é", "B", "", None]), None if i % 7 == 0 else "en", None if i % 5 == 0 else i, rng.choice(["É Ä x", "", None, "Q" * 5000]))
             for i in range(300, 400)]
    rows += [(None, "a", None, None, None), (None, "a", "en", 1, "Z"), (5, "hot", "en", 5, "other"), (1, "lone", "en", 1, "A")]
    return rows + [(7, "hot", "en", 7, "Text 7")] * 20


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], odd_rows()[:16], odd_rows()[:17], [(i, f"s{i:03}", "", 0, "T") for i in range(300)]])
def test_proofs(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(map(tuple, proofs(docs).collect())) == Counter(expected(rows))


def test_a_source_of_several_blocks(spark):
    """Three rounds of blocks for one source, and leaf blocks that fetch nodes of levels above their own."""
    rows = [(i, "big" if i % 3 else "small", "en", i, f"T{i}") for i in range(9_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, proofs(docs).collect())) == Counter(expected(rows))


def test_proofs_of_some_leaves(spark):
    rows = [(i, "s" if i % 4 else None, "en", i, f"T{i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = merkle.build(docs, COLUMNS)
    some = manifest.leaves.where("id % 97 = 5 OR id BETWEEN 40 AND 60")
    want = {r[0]: r[1:5] for r in expected(rows)}
    got = merkle.prove(manifest, some).collect()
    assert len(got) == some.count()
    for r in got:
        assert tuple(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_sha256")) == want[r["id"]]
        assert r["folded_root"] == r["root"]


def test_the_octopus_is_minimal():
    rng = Random(1)
    for leaves in (1, 2, 16, 17, 257, 5000):
        levels = climb([h(str(i)) for i in range(leaves)])
        known = rng.sample(range(leaves), min(leaves, 9)) + list(range(min(leaves, 20)))
        need = merkle.missing(known, leaves)
        nodes = {c: levels[c[0]][c[1]].encode() for c in need} | {(0, i): levels[0][i].encode() for i in known}
        given = dict(nodes)
        merkle.derived(nodes, known, leaves)
        assert nodes[len(levels) - 1, 0].decode() == levels[-1][0]
        assert not set(need) & {(k, i // 16 ** k) for i in known for k in range(len(levels))}  # nothing that could be derived
        for i in known:
            assert merkle.fold(given[0, i], merkle.brothers(nodes, 0, i, leaves)).decode() == levels[-1][0]
    assert merkle.missing(range(4096, 8192), 20_000) == [(3, 0), (3, 2), (3, 3), (3, 4)]


def test_any_change_shows(spark):
    rows = [(i, "s", "en", i, "Upper" if i % 2 else "lower") for i in range(100)]
    got = {r["id"]: r["verified"] for r in proofs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: not (i % 2 and crc32(str(i).encode()) % 5 == 0) for i in range(100)}


def test_empty_and_clashing(spark):
    assert proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    more = "tree long, place long, size long, leaf string, id string, `first` long, position long, nth long"
    rows = odd_rows()[:40]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", 4, 5, 6) for r in rows], f"{SCHEMA}, {more}")
    assert Counter(map(tuple, proofs(docs).collect())) == Counter(expected(rows))
