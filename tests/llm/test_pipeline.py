"""The stages of the pipeline, each written and read again and compared with brute force on its own input."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F
from test_dedup import components_of

import corpus_pipeline
from tandem.llm import quality_cnn, resharding
from tandem.llm.anchors import LAST_OWNER

COLUMNS = "doc_id long, text string, source string"


def tables():
    """Documents, labels and benchmark items; every tenth document is of bad quality."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    plain = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        bad = i % 10 == 0
        text = " ".join("#@~%d" % rng.randrange(9) * 3 for _ in range(60)) if bad else plain(rng.randint(40, 120))
        docs.append((i, text, rng.choice("abc")))
        labels.append((i, int(not bad), 0))
    for i in range(12):  # 100 words with k changed apart from each other, 5-word similarity from 0.9 to 0.5
        base = plain(100).split()
        docs.append((200 + 10 * i, " ".join(base), "a"))
        for k in range(1, 5):
            docs.append((200 + 10 * i + k, " ".join(f"new{j}" if j % 20 == 10 and j // 20 < k else w for j, w in enumerate(base)), "b"))
    items = [(i, plain(20)) for i in range(6)] + [(6, "short benchmark item")]
    docs += [(400 + i, f"{plain(30)} {t} {plain(10)}", "c") for i, (_, t) in enumerate(items)]
    docs += [(500, None, "a"), (501, "", None), (None, plain(50), None), (3, plain(60), "b"), docs[5], docs[5]]
    return docs, labels, items


def quality_kept(docs, net):
    kept = []
    for row in docs:
        data = np.frombuffer((row[1] or "").encode(), np.uint8)
        score = quality_cnn.probabilities(net, data, np.array([0, len(data)]))[0]
        assert abs(score - 0.3) > 1e-6
        if score >= 0.3:
            kept.append(row)
    return kept


def one_of_each(docs):
    sets, group, _ = components_of([r[:2] for r in docs], 5, 80)
    best = {}
    for row, s, g in zip(docs, sets, group):
        order = (LAST_OWNER if row[0] is None else row[0], md5((row[1] or "").encode()).digest())
        if s and (g not in best or order < best[g][0]):
            best[g] = order, row
    return [row for row, s in zip(docs, sets) if not s] + [row for _, row in best.values()]


def clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for _, t in items:
        w = words(t)
        size = min(13, len(w))
        windows |= {tuple(w[j:j + size]) for j in range(len(w) - size + 1)}
    kept = []
    for row in docs:
        w, hit = words(row[1]), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j:j + size]) in windows:
                    hit.update(range(j, j + size))
        if not hit or 20 * len(hit) < len(w):
            kept.append(row)
    return kept


def copies(docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), Fraction(3, 2) * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in full or free:
            target[s] = Fraction(2 * sizes[s]) if full else level * weight[s]
        rest -= sum(target[s] for s in full or free)
        free -= full or free
    result, seen = [], Counter()
    for row in docs:
        seen[row] += 1
        rate = target[row[2]] / sizes[row[2]] if sizes[row[2]] else Fraction(0)
        own = ("" if row[0] is None else row[0], "-" if row[2] is None else "=" + row[2], md5((row[1] or "").encode()).hexdigest())
        drawn = "8:{}:{}:{}::{}".format(*own, seen[row])
        draw = Fraction(int(md5(drawn.encode()).hexdigest()[:13], 16), 16**13)
        result += [row] * (int(rate) + (draw < rate - int(rate)))
    return result


def check_shards(docs, placed, old_of):
    assert Counter(r[:3] for r in placed) == Counter(docs)
    assert all(size == 8 + len((t or "").encode()) for _, t, _, size, _, _ in placed)
    old, new = [0] * corpus_pipeline.OLD_SHARDS, [0] * corpus_pipeline.SHARDS
    slots = defaultdict(list)
    for _, text, _, size, shard, slot in placed:
        old[old_of[text]] += size
        new[shard] += size
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    capacities, largest = resharding.even_capacities(sum(old), len(new)), max(r[3] for r in placed)
    moves = resharding.flow(old, capacities)
    for shard, size in enumerate(new):
        assert abs(size - capacities[shard]) <= largest * sum(j == shard for _, j in moves)
    moved = sum(r[3] for r in placed if r[4] != old_of[r[1]])
    assert moved <= sum(b for (i, j), b in moves.items() if i != j) + largest * len(moves)


def test_stages(spark, tmp_path):
    docs, labels, items = tables()
    spark.createDataFrame(docs, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    path, kept = str(tmp_path / "documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = spark.read.parquet(path)
        rows = [tuple(r) for r in given.collect()]
        kept.append(len(rows))
        path = str(tmp_path / f"stage{k}")
        stage(spark, given, str(tmp_path)).write.parquet(path)
        got = [tuple(r) for r in spark.read.parquet(path).collect()]
        if k == 0:
            want = quality_kept(rows, quality_cnn.fit(given, spark.read.parquet(str(tmp_path / "labels.parquet"))))
        elif k == 4:
            old_of = {r[0]: r[1] for r in given.select("text", corpus_pipeline.old_shard().alias("s")).distinct().collect()}
            check_shards(rows, got, old_of)
            continue
        else:
            want = [one_of_each, lambda r: clean(r, items), copies][k - 1](rows)
        assert Counter(got) == Counter(want), corpus_pipeline.STAGES[k][0]
    assert kept[0] > kept[1] > kept[2] > kept[3] < kept[4]  # every stage has something to do
