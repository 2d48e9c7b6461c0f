"""Substring removal and near duplicates against brute force."""

import itertools
import random
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tandem.llm import jaccard_join, lz_dedup, suffix_dedup
from tandem.llm.anchors import LAST_OWNER, merged
from tandem.llm.components import components
from tandem.llm.text import anchored_runs, byte_hashes, grams, sliding_min


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def spans_removed(units, flags, width):
    gone = set()
    for i, flag in enumerate(flags):
        if flag:
            gone.update(range(i, i + width))
    return [u for i, u in enumerate(units) if i not in gone], gone


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n, k in ((0, 2), (1, 2), (50, 2), (700, 3), (900, 250)):
        x = rng.integers(0, k, n)
        if n > 600:
            x[300:600] = x[:300]
        sa = suffix_dedup.suffix_array(x)
        text = [tuple(x[i:]) for i in range(n)]
        assert sa.tolist() == sorted(range(n), key=lambda i: text[i])
        got = suffix_dedup.common_prefixes(x, sa, 40, lane=64).tolist()
        for at in range(1, n):
            a, b = text[sa[at - 1]], text[sa[at]]
            same = next((j for j, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert got[at] == min(same, 40)


def test_shards_are_matched_by_binary_search():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"\x00\xffab") for _ in range(30)) for _ in range(12)]
    bodies = [b"".join(rng.sample(parts, 4)) for _ in range(20)]
    windows = Counter(b[i:i + 20] for b in bodies for i in range(len(b) - 19))
    want = [[windows[b[i:i + 20]] > 1 for i in range(len(b) - 19)] for b in bodies]
    for size in (130, 400, 1 << 20):
        runs = suffix_dedup.repeats_of(20, size)(bodies, np.ones(20, int), np.zeros(20, int))
        got = [[False] * (len(b) - 19) for b in bodies]
        for row, listed in zip(got, runs):
            for a, n in zip(listed[::2], listed[1::2]):
                row[a:a + n] = [True] * n
        assert got == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    first = np.array([0, 1500, 1500, 4000])
    values, starts, counts = anchored_runs(byte_hashes(data), first, 60, 8)
    anchor = {int(s) + i: int(v) for v, s, n in zip(values, starts, counts) for i in range(n)}
    assert sorted(anchor) == [i for i in range(3941) if i + 60 <= 1500 or i >= 1500]
    for i in range(241):
        assert anchor[2000 + i] == anchor[100 + i]
    g = grams(byte_hashes(data), 8)
    assert sliding_min(g, 53)[7] == g[7:60].min()


def test_merged_ranges():
    assert merged(np.array([0, 5, 5, 7, 6, 9, 12, 13])) == [(0, 9), (12, 13)]
    assert merged(np.array([], int)) == []


def test_repeated_bytes(mixed_docs, mixed_rows):
    texts = [(i, (t or "").encode()) for i, t in mixed_rows]
    seen = Counter(t[j:j + 200] for _, t in texts for j in range(len(t) - 199))
    want = Counter()
    for i, t in texts:
        kept, gone = spans_removed(t, [seen[t[j:j + 200]] > 1 for j in range(len(t) - 199)], 200)
        runs = sum(1 for j in gone if j - 1 not in gone)
        want[i, len(t), len(gone), runs, sha256(bytes(kept)).hexdigest()] += 1
    got = suffix_dedup.without_repeats(mixed_docs)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeated_passages(mixed_docs, mixed_rows):
    texts = [(LAST_OWNER if i is None else i, (t or "").encode().split()) for i, t in mixed_rows]
    least = {}
    for i, w in texts:
        for j in range(len(w) - 49):
            key = tuple(w[j:j + 50])
            least[key] = min(least.get(key, i), i)
    want = Counter()
    for i, w in texts:
        kept, gone = spans_removed(w, [least[tuple(w[j:j + 50])] < i for j in range(len(w) - 49)], 50)
        want[None if i == LAST_OWNER else i, len(w), len(gone), sha256(b" ".join(kept)).hexdigest()] += 1
    assert bag(lz_dedup.without_passages(mixed_docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_a_passage_begun_by_one_source_and_ended_by_another():
    words = [b"w%d" % i for i in range(200)]
    bodies = [b" ".join(words[:100]), b" ".join(words[40:160]), b" ".join(words[10:150])]
    block = lz_dedup.Block.index(bodies, np.array([1, 2, 3]), 50)
    # The second takes 60 words of the first; the third all of the first's end, then what the second goes on with.
    assert list(block.factors(50)) == [(100, 60, 40), (220, 90, 10), (220 + 41, 99, 100 + 11)]


def test_factors_are_greedy_and_cover_what_repeats():
    """Every factor is as long as its source goes on, and together they cover just the windows that an earlier owner has."""
    rng = random.Random(9)
    pool = [b" ".join(b"%d.%d" % (p, j) for j in range(rng.randint(3, 30))) for p in range(12)]
    bodies = [b" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    owners = np.array([rng.randrange(25) for _ in bodies])
    block = lz_dedup.Block.index(bodies, owners, 10)
    texts, segment = [b.split() for b in bodies], np.repeat(np.arange(60), np.diff(block.first))
    flat = [w for t in texts for w in t]
    least = {}
    for t, owner in zip(texts, owners):
        for j in range(len(t) - 9):
            least[tuple(t[j:j + 10])] = min(least.get(tuple(t[j:j + 10]), 99), owner)
    want = {int(block.first[i]) + j for i, t in enumerate(texts) for j in range(len(t) - 9) if least[tuple(t[j:j + 10])] < owners[i]}
    covered, last = set(), (-1, 0)
    for a, n, b in block.factors(10):
        assert n >= 10 and flat[a:a + n] == flat[b:b + n] and owners[segment[b]] < owners[segment[a]]
        assert len({*segment[a:a + n]}) == len({*segment[b:b + n]}) == 1
        ends = a + n == block.first[segment[a] + 1] or b + n == block.first[segment[b] + 1]
        assert ends or flat[a + n] != flat[b + n]
        assert a > last[0] and a + n > last[1]
        covered |= set(range(a, a + n - 9))
        last = a, a + n
    assert covered == want and len(want) > 100


def test_words_decide_not_hashes(monkeypatch):
    """All words of one length share a hash: no factor comes of that."""
    monkeypatch.setattr(lz_dedup, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    bodies = [b"aa bb cc dd ee ff", b"xx bb cc dd yy zz", b"aa bb cc dd ee gg"]
    found = list(lz_dedup.Block.index(bodies, np.array([1, 2, 3]), 3).factors(3))
    assert all(bodies[0].split()[b:b + n] == [w for x in bodies for w in x.split()][a:a + n] for a, n, b in found)
    assert {(a, b) for a, _, b in found} <= {(7, 1), (12, 0), (13, 1), (14, 2)} and found


def components_of(rows, size=3, percent=90):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: LAST_OWNER)
    for (i, _), g in zip(rows, group):
        least[g] = min(least[g], LAST_OWNER if i is None else i)
    return sets, group, least


@pytest.mark.parametrize("dear, longest", [(1000, 24), (2, 1)])
def test_near_components(mixed_docs, mixed_rows, monkeypatch, dear, longest):
    monkeypatch.setattr(jaccard_join, "DEAR", dear)
    monkeypatch.setattr(jaccard_join, "LONGEST", longest)
    monkeypatch.setattr(jaccard_join, "PARITY_SERVES", 16 if dear < 32 else 256)
    sets, group, least = components_of(mixed_rows)
    want = Counter((i, len(s), None if least[g] == LAST_OWNER else least[g]) for (i, _), s, g in zip(mixed_rows, sets, group))
    assert bag(jaccard_join.near_components(mixed_docs), "doc_id", "n_shingles", "component_id") == want


@pytest.fixture(scope="session")
def short_rows():
    """Texts of 8 to 11 three-word shingles with one word more at an end or at both, and a chain through them."""
    rows = []
    for n in range(6, 14):
        own = [f"s{n}w{j}" for j in range(n)]
        for extra in ([], ["after"], ["before"], ["before", "after"]):
            rows.append((len(rows), " ".join(["x"] * ("before" in extra) + own + ["y"] * ("after" in extra))))
    return rows + [(100 + i, " ".join(f"chain{j}" for j in range(i, 11 + i + k))) for i in range(3) for k in range(2)]


@pytest.mark.parametrize("dear, longest", [(1000, 24), (2, 1)])
def test_near_components_of_short_texts(spark, short_rows, monkeypatch, dear, longest):
    monkeypatch.setattr(jaccard_join, "DEAR", dear)
    monkeypatch.setattr(jaccard_join, "LONGEST", longest)
    sets, group, least = components_of(short_rows)
    assert {len(s) for s in sets} >= {8, 9, 10, 11} and len(set(group)) < len(short_rows)
    want = Counter((i, len(s), least[g]) for (i, _), s, g in zip(short_rows, sets, group))
    docs = spark.createDataFrame(short_rows, "doc_id long, text string")
    assert bag(jaccard_join.near_components(docs), "doc_id", "n_shingles", "component_id") == want


@pytest.fixture(scope="session")
def five_word_rows(mixed_rows, short_rows):
    """Also 100 words of which 0 to 4 are changed apart from each other, and texts of 1 to 9 words."""
    words = [f"u{j}" for j in range(100)]
    rows = [(200 + k, " ".join("new%d.%d" % (k, j) if j % 20 == 10 and j // 20 < k else w for j, w in enumerate(words))) for k in range(5)]
    rows += [(300 + n, " ".join(f"few{j}" for j in range(n))) for n in range(1, 10)]
    return mixed_rows + [(i if i is None else 1000 + i, t) for i, t in short_rows] + rows


@pytest.mark.parametrize("dear, longest", [(1000, 24), (2, 1)])
def test_near_components_of_five_words(spark, five_word_rows, monkeypatch, dear, longest):
    monkeypatch.setattr(jaccard_join, "DEAR", dear)
    monkeypatch.setattr(jaccard_join, "LONGEST", longest)
    monkeypatch.setattr(jaccard_join, "PARITY_SERVES", 16 if dear < 32 else 256)
    sets, group, least = components_of(five_word_rows, 5, 80)
    want = Counter((i, len(s), None if least[g] == LAST_OWNER else least[g]) for (i, _), s, g in zip(five_word_rows, sets, group))
    docs = spark.createDataFrame(five_word_rows, "doc_id long, text string")
    assert bag(jaccard_join.near_components(docs, size=5, percent=80), "doc_id", "n_shingles", "component_id") == want


def test_stage_of_near_duplicates(spark, five_word_rows):
    sets, group, least = components_of(five_word_rows, 5, 80)
    docs = spark.createDataFrame(five_word_rows, "doc_id long, text string")
    rows = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert {200, 201, 202} & {i for i, _ in rows} == {200}
    groups = Counter(group[five_word_rows.index(r)] for r in rows if (r[1] or "").split())
    assert set(groups.values()) == {1} and set(groups) == {g for g, s in zip(group, sets) if s}
    assert all(LAST_OWNER if i is None else i == least[group[five_word_rows.index((i, t))]] for i, t in rows if (t or "").split())
    assert sum(not (t or "").split() for _, t in rows) == sum(not s for s in sets)


def test_one_of_each(mixed_docs, mixed_rows):
    sets, group, _ = components_of(mixed_rows)
    kept = jaccard_join.one_of_each(mixed_docs)
    assert kept.columns == mixed_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = Counter(group[mixed_rows.index(r)] for r in rows if (r[1] or "").split())
    assert set(groups.values()) == {1} and set(groups) == {g for g, s in zip(group, sets) if s}
    assert sum(not (t or "").split() for _, t in rows) == sum(not s for s in sets)


def test_prefixes_move_packed(spark, monkeypatch):
    """No step before the pairs are known shuffles much more than the eight bytes of each shingle of the longest prefixes."""
    rng, rows = random.Random(11), []
    for i in range(150):
        words = [f"{i}.{j}" for j in range(500)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(f"new{j}" if rng.random() < 0.002 * (i % 40) else w for j, w in enumerate(words))))
    folders = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    written, keep = {}, jaccard_join.stored

    def stored(df, name):
        before = {f for d in folders for f in d.rglob("shuffle_*.data")}
        result = keep(df, name)
        new = {f for d in folders for f in d.rglob("shuffle_*.data")} - before
        written[name] = max(written.get(name, 0), sum(f.stat().st_size for f in new))
        return result

    monkeypatch.setattr(jaccard_join, "stored", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bag(jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    _, group, least = components_of(rows)
    assert got == Counter((i, least[g]) for (i, _), g in zip(rows, group)) and 150 < len(set(group)) < 300
    shingles = 300 * (498 - 449 + 1 + jaccard_join.LONGEST)
    early = [n for _, n in itertools.takewhile(lambda step: step[0] != "near-pairs", written.items())]
    assert 4 * shingles < max(early) < 14 * shingles


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    chain = [(i + 1, i) for i in range(20)] + [(50, 40), (60, 40), (61, 60), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long"), few).collect()}
    assert got == {(i, 0) for i in range(1, 21)} | {(50, 40), (60, 40), (61, 40)}


def test_empty_tables(no_docs):
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    assert lz_dedup.without_passages(no_docs).count() == 0
    assert jaccard_join.near_components(no_docs).count() == 0
    assert jaccard_join.one_of_each(no_docs).count() == 0
