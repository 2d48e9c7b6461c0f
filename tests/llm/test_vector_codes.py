"""Vector codes against every part met with every entry, in Python's own integers."""

import math
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tandem.llm import vector_codes
from tandem.llm.vector_codes import Gnat


def brute(q, entries):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)), i) for i, e in enumerate(entries)) for row in q]


@pytest.mark.parametrize("largest", [300, 1 << 27, 1 << 40])
@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "equal"])
def test_nearest_is_exact(largest, kind):
    """In all three kinds of arithmetic, with many ties and with entries that are equal."""
    rng = np.random.default_rng(7)
    entries = rng.integers(-largest, largest, (120, 3))
    if kind == "clustered":
        entries = (entries // 8) + (rng.integers(0, 6, 120)[:, None] - 3) * (largest // 4)
    if kind == "ties":
        entries = rng.integers(-2, 3, (120, 3))
    if kind == "equal":
        entries[:] = entries[5]
    q = np.concatenate([rng.integers(-largest, largest, (150, 3)), entries[:40]]) if kind != "ties" else rng.integers(-3, 4, (200, 3))
    tree = Gnat(entries, largest, degree=4, bucket=5)
    index, best = tree.nearest(q)
    assert [(int(d), int(i)) for d, i in zip(best, index)] == brute(q, entries)


def test_subtrees_are_ruled_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 16))
    entries = (centres[rng.integers(0, 16, 256)] + rng.integers(-60, 60, (256, 16)))
    q = entries[rng.integers(0, 256, 2000)] + rng.integers(-40, 40, (2000, 16))
    tree = Gnat(entries, 5000)
    index, best = tree.nearest(q)
    d = ((q[:, None] - entries[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (index == d.argmin(1)).all()
    assert tree.met < 0.4 * d.size


def expected(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    sizes = Counter(len(v) for _, v, _ in kept)
    size = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e12 else 1024 * int(x) for x in v], label) for i, v, label in kept if len(v) == size]
    if not kept:
        return []
    cut = lambda v: [v[p * size // parts:(p + 1) * size // parts] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [list(c) for c in zip(*(cut(v) for _, v, _ in first))]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for (_, v, _), (_, e) in zip(kept, brute([cut(v)[p] for _, v, _ in kept], books[p])):
                own[e].append(cut(v)[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else old for e, old in enumerate(books[p])]
    digest = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [brute([cut(v)[p] for _, v, _ in kept], books[p]) for p in range(parts)]
    errors = [sum(f[i][0] for f in found) for i in range(len(kept))]
    errors = [e if e < 1 << 63 else None for e in errors]
    labels = defaultdict(list)
    for (_, _, label), e in zip(kept, errors):
        labels[label].append(e)
    sums = {label: None if None in own or sum(own) >= 1 << 63 else sum(own) for label, own in labels.items()}
    return [(i, "".join(f"{f[n][1]:02x}" for f in found), errors[n], sums[label], digest) for n, (i, _, label) in enumerate(kept)]


def rows_of(n, seed, size=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, size)], int(i % 3) if i % 4 else None) for i in range(n)]


def odd_rows():
    rows = rows_of(90, 1)
    rows += [(900, None, 1), (901, [0.1, None] * 4, 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] + [0.0] * 7, 0), (904, [], 0),
             (905, [0.5] * 12, 1), (906, [0.5] * 7, 1), (None, [0.25] * 8, None), (None, [-0.25] * 8, 2), (5, [0.3] * 8, 2), (5, [0.3] * 8, 2)]
    return rows + [(-1 - i, [-0.001] * 8, 1) for i in range(30)]


HUGE = rows_of(40, 2) + [(50, [1e30, -1e30] * 4, 1), (51, [3e38] * 8, 2), (52, [70_000.5] * 8, 7)]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("rows, entries", [(odd_rows(), 256), (odd_rows(), 20), (rows_of(300, 4), 64), (odd_rows()[90:91], 256), (HUGE, 16)])
def test_codes(spark, rows, entries):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cells = [r if r[1] is None else (r[0], [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows]
    got = vector_codes.with_codes(vectors, entries=entries)
    assert got.columns == ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.drop("label").collect())) == Counter(expected(cells, entries=entries))


def test_names_and_empty(spark):
    assert vector_codes.with_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = rows_of(30, 5)
    odd = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], f"{SCHEMA}, v string, code string, n string, `of` string")
    assert Counter(map(tuple, vector_codes.with_codes(odd).drop("label").collect())) == Counter(expected(rows))
    alone = vector_codes.with_codes(odd, label=None).collect()
    assert {r["label_error"] for r in alone} == {sum(r["error"] for r in alone)}


def test_a_code_stands_for_its_vector(spark):
    kept = vector_codes.kept_vectors(spark.createDataFrame(rows_of(60, 6), SCHEMA), "vec_id", "embedding", "label")
    books = vector_codes.fit(kept, entries=256)
    for r in vector_codes.coded(kept, books).join(kept.select("id", "v"), "id").collect():
        assert sum((math.floor(x) - y) ** 2 for x, y in zip(r["v"], books.decoded(r["code"]))) == r["error"]
