"""Classifiers, quality rules, token counts, mixing, sharding and decontamination on small tables."""

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import decontamination, labelled, mixing, quality_cnn, quality_rules, resharding, token_counts, toxicity


def test_mixing_targets(spark):
    sizes = [("a", 10), ("a", 90), ("b", 400), (None, 50), ("z", 0)]
    got = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    # Weights 5, 2, 1, 5; 825 words in all; a and null stop at twice their size, b takes the rest.
    assert [got[s]["target"] for s in ("a", "b", "z", None)] == [200, 525, 0, 100]
    assert got["z"]["rate"] == 0 and got["b"]["rate"] == 525 / 400


def test_mixing_copies(mixed_docs, no_docs):
    docs = mixed_docs.withColumnRenamed("spans", "source")
    first, again = (sorted(map(str, mixing.mixed(docs).select("doc_id", "text").collect())) for _ in range(2))
    assert first == again and mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(no_docs.withColumnRenamed("spans", "source")).count() == 0


def mix_rows(ids):
    """4,000 texts of three sources, a third of them copies of one."""
    rng = random.Random(6)
    sources = ["a"] * 2000 + ["b"] * 1200 + [None] * 800
    texts = [" ".join(["w"] * rng.randint(1, 60)) + f" {i}" if i % 3 else "the same text " * 10 for i in range(4000)]
    return [(ids(i), t, s) for i, (t, s) in enumerate(zip(texts, sources))]


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: None, lambda i: 7, lambda i: i if i % 2 else 0])
@pytest.mark.parametrize("block_rows", [50, 2_000])
def test_mixing_comes_near_its_targets_whatever_the_ids(spark, monkeypatch, ids, block_rows):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rows = mix_rows(ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    counted = mixing.with_copies(docs).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in counted) == Counter(rows)
    for source in ("a", "b", None):
        own = [r["mix"] for r in counted if r["source"] == source]
        assert abs(sum(m["size"] * m["copies"] for m in own) / own[0]["target"] - 1) < 0.05
        assert {m["copies"] for m in own} <= {int(own[0]["rate"]), int(own[0]["rate"]) + 1}
    again = Counter(map(tuple, mixing.mixed(docs.repartition(5)).collect()))
    assert again == Counter({k: n for k, n in Counter(
        (r["doc_id"], r["text"], r["source"]) for r in counted for _ in range(r["mix"]["copies"])).items()})


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(20):
        m, n = rng.randint(1, 5), rng.randint(1, 6)
        old = [rng.randint(0, 50) for _ in range(m)]
        new = resharding.even_capacities(sum(old), n)
        moves = resharding.flow(old, new)
        assert [sum(b for (i, _), b in moves.items() if i == k) for k in range(m)] == old
        assert all(sum(b for (_, j), b in moves.items() if j == k) <= new[k] for k in range(n))
        assert sum(b for (i, j), b in moves.items() if i != j) == sum(old) - sum(map(min, old, new))
    with pytest.raises(ValueError):
        resharding.flow([5], [4])


def test_reshard(mixed_docs, mixed_rows, no_docs, tmp_path, spark):
    from pyspark.sql import functions as F
    old = F.pmod(F.xxhash64("text"), F.lit(3))
    placed = resharding.reshard(mixed_docs, old, 3, 4)
    rows = placed.select("doc_id", "text", "place.*").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(mixed_rows)
    assert all(r["size"] == 8 + len((r["text"] or "").encode()) for r in rows)
    for shard in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in rows if r["shard"] == s) - total / 4) <= 3 * largest for s in range(4))
    touched = resharding.rewrite(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert 3 in touched and back.count() == sum(r["shard"] in touched for r in rows)
    assert resharding.reshard(no_docs, old, 3, 4).count() == 0


def test_a_crowd_of_equal_rows_is_many_blocks(spark, monkeypatch):
    """Small blocks, the same placement of the same rows in every run, and shards as even as without copies."""
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 40)
    monkeypatch.setattr(resharding, "CROWD_ROWS", 100)
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(600)] + [(7, "again")] * 900 + [(None, None)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = F.pmod(F.xxhash64("text"), F.lit(2))
    blocks = resharding._with_blocks(docs.select(F.struct(
        old.cast("int").alias("old"), F.xxhash64("doc_id", "text").alias("order"), F.lit(0).alias("block"), F.monotonically_increasing_id().alias("nth"),
        "doc_id").alias("place")))
    sizes = blocks.where("block.part >= 0").groupBy("old", "block").count().collect()
    assert sum(r["count"] for r in sizes) == 1200 and max(r["count"] for r in sizes) < 100
    runs = []
    for parts in (1, 5):
        placed = resharding.reshard(docs.repartition(parts), old, 2, 3).collect()
        runs.append(Counter((r["doc_id"], r["text"], r["place"]) for r in placed))
        total = sum(r["place"]["size"] for r in placed)
        for shard in range(3):
            own = [r["place"] for r in placed if r["place"]["shard"] == shard]
            assert sorted(p["slot"] for p in own) == list(range(len(own)))
            assert abs(sum(p["size"] for p in own) - total / 3) <= 2 * 70
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)


@pytest.mark.parametrize("shards, emptied", [(3, None), (5, 1), (6, 4)])
def test_rewrite_over_the_old_layout(mixed_docs, mixed_rows, tmp_path, spark, shards, emptied):
    """Fewer shards, and shards of capacity 0: every document is there once, in its new shard."""
    path = str(tmp_path / "layout")
    mixed_docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(5)).alias("shard")).write.partitionBy("shard").parquet(path)
    total = sum(8 + len((t or "").encode()) for _, t in mixed_rows)
    capacities = None if emptied is None else resharding.even_capacities(total, shards - 1)
    if capacities:
        capacities.insert(emptied, 0)
    placed = resharding.reshard(spark.read.parquet(path), F.col("shard"), 5, shards, keep=["doc_id", "text"], capacities=capacities)
    want = Counter((r["doc_id"], r["text"], r["place"]["shard"]) for r in placed.collect())
    touched = resharding.rewrite(placed, path)
    back = Counter((r["doc_id"], r["text"], r["shard"]) for r in spark.read.parquet(path).select("doc_id", "text", "shard").collect())
    assert back == want and Counter(k[:2] for k in back.elements()) == Counter(mixed_rows)
    assert set(touched) >= ({3, 4} if emptied is None else {emptied})


def test_token_counts_are_greedy(mixed_docs, mixed_rows, no_docs):
    mark = token_counts.WORD_MARK
    pieces = {mark, mark + b"a", b"ab", b"abc", b"abcde", b"bc", "é".encode(), b"dd", mark + b"aab", b"cd"} | {bytes([b]) for b in range(256)}
    machine = token_counts.build(pieces)

    def greedy(word):
        word, at, n = mark + word, 0, 0
        while at < len(word):
            at += next(size for size in range(len(word) - at, 0, -1) if word[at:at + size] in pieces)
            n += 1
        return n

    want = Counter((i, sum(map(greedy, (t or "").encode().split()))) for i, t in mixed_rows)
    counted = token_counts.with_token_count(mixed_docs, machine)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == want
    assert token_counts.with_token_count(no_docs, machine).count() == 0


def test_repeated_words():
    rng = random.Random(4)
    for n in (0, 7, 9, 30, 200):
        for kinds in (1, 2, 40):
            ids = [rng.randrange(kinds) for _ in range(n)]
            windows = Counter(tuple(ids[i:i + 8]) for i in range(n - 7))
            want = {j for i in range(n - 7) if windows[tuple(ids[i:i + 8])] > 1 for j in range(i, i + 8)}
            assert quality_rules.repeated_words(np.array(ids, int)) == len(want)


def test_quality_rules(mixed_docs, mixed_rows, no_docs):
    got = Counter(tuple(r)[:7] for r in quality_rules.quality_rules(mixed_docs).select("doc_id", "rules.*").collect())
    want = Counter()
    for i, t in mixed_rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [line for line in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        windows = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        repeated = len({k for j in range(len(w) - 7) if windows[tuple(w[j:j + 8])] > 1 for k in range(j, j + 8)})
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed] += 1
    assert got == want
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_js_distance():
    q = np.array([1.0, 1.0, 0.0])
    assert quality_rules.js_distance(np.array([[2, 2, 0], [0, 0, 5], [0, 0, 0]]), q).tolist() == [0, 1, 1]


def test_strange_characters_are_not_kept(spark):
    plain = "the cat and the dog of that house in the town is a friend of the man and it was on the hill " * 3
    rows = [(i, " ".join(random.Random(i).sample(plain.split(), 60))) for i in range(40)] + [(99, "9@7^ ~~{}[] " * 3 + " ".join(f"{i}=^{i}~" for i in range(80)))]
    kept = {r["doc_id"]: r["rules"]["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not kept[99] and all(kept[i] for i in range(40))


def texts(n, bad, seed):
    rng = random.Random(seed)
    return [(rng.choice(["scummy ", "zorg "]) if bad else "", rng) and
            (" ".join(["zorg" if bad and rng.random() < 0.1 else rng.choice("one two three four five six".split()) for _ in range(40)]).encode(), int(bad))
            for _ in range(n)]


def test_toxicity_learns_and_composes():
    model = toxicity.train(texts(60, True, 1) + texts(60, False, 2))
    score = lambda *t: model.probabilities(np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0] + [len(x.encode()) for x in t]))
    bad, good, empty = score("one zorg two zorg. three zorg", "one two three", "")
    assert bad > 0.5 > good and 0 <= empty < 0.5
    machine = toxicity.grammar()
    plain, denied, told, aimed = (toxicity.clause_strength(machine, s, [1.0] * len(s)) for s in ("ooi", "noi", "rooooooi", "yi"))
    assert denied < plain < aimed and told < plain
    assert toxicity.train([]).probabilities(np.zeros(0, np.uint8), np.array([0, 0])).tolist()[0] < 0.5


def test_training_sample_has_one_text_of_an_id(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(40)] + [(i, f"more {i} {j}") for i in range(0, 40, 5) for j in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    free = [i for i in range(40) if crc32(str(i).encode()) % 5]
    assert any(i % 5 == 0 for i in free)
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(collect(df)) or collected[-1])
    for most in (10, 100):
        collected.clear()
        sample = labelled.training_sample(docs, labels, "toxic", most)
        ids = [int(t.split()[1]) for t, _ in sample]
        assert len(ids) == len(set(ids)) == min(most, len(free)) and set(ids) <= set(free)
        assert all(y == i % 2 for i, (_, y) in zip(ids, sample)) and sum(map(len, collected)) <= most


def test_network_gradients_and_learning():
    rng = random.Random(3)
    sample = [(b"aaaa " * 60, 0) if i % 2 else (" ".join(rng.choice(["the", "cat", "sat", "mat", "dog"]) for _ in range(90)).encode(), 1) for i in range(60)]
    net = quality_cnn.train(sample, steps=60)
    data = np.frombuffer(b"".join(t for t, _ in sample), np.uint8)
    p = quality_cnn.probabilities(net, data, np.cumsum([0] + [len(t) for t, _ in sample]))
    assert ((p > 0.5) == np.array([y for _, y in sample])).mean() > 0.95
    assert quality_cnn.probabilities(quality_cnn.train([]), data, np.array([0, 0, 100])).tolist() == [0.5, 0.5]


def test_chunks_cover_whole_texts():
    offsets = np.array([0, 0, 10, 5000, 5512])
    starts, first = quality_cnn.chunks_of(np.zeros(5512, np.uint8), offsets)
    for i in range(4):
        own = starts[first[i]:first[i + 1]]
        assert own[0] == offsets[i] and own[-1] + quality_cnn.CHUNK >= offsets[i + 1]
        assert (np.diff(own) == quality_cnn.STEP).all()


def test_scores_of_odd_rows(mixed_docs, no_docs):
    for scored in (quality_cnn.with_score(mixed_docs, quality_cnn.new_network()), toxicity.with_toxicity(mixed_docs, toxicity.train([]))):
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.columns[:-1] == mixed_docs.columns
    assert quality_cnn.with_score(no_docs, quality_cnn.new_network()).count() == 0


def test_contamination(spark, mixed_docs, mixed_rows, no_docs):
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long_text = dict(mixed_rows[:5])[4]
    items = [(1, " ".join(long_text.split()[5:40])), (2, "A b"), (3, None), (4, ""), (10, "a"), (None, long_text), (1, long_text[:300])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, t in items:
        words = w(t)
        size = min(13, len(words))
        windows += [(str(i) if i is not None else "", tuple(words[j:j + size])) for j in range(len(words) - size + 1) if words]
    want = Counter()
    for i, t in mixed_rows:
        words, hit, found = w(t), set(), set()
        places = {}
        for size in {len(win) for _, win in windows}:
            for j in range(len(words) - size + 1):
                places.setdefault(tuple(words[j:j + size]), []).append(j)
        for item, win in windows:
            for j in places.get(win, []):
                hit.update(range(j, j + len(win)))
                found.add(item)
        want[i, len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(),
             bool(hit) and 20 * len(hit) >= len(words)] += 1
    got = decontamination.contamination(mixed_docs, benchmark).select("doc_id", "leak.*").drop("leak_key")
    assert Counter(tuple(r) for r in got.collect()) == want
    clean = decontamination.decontaminated(mixed_docs, benchmark)
    assert clean.columns == mixed_docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontamination.contamination(no_docs, benchmark).count() == 0
    assert decontamination.decontaminated(mixed_docs, benchmark.limit(0)).count() == len(mixed_rows)
